"""Retrieval for a table of questions: vectors, over-fetched search, demotion of bibliographies, floor, ranking, summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions import text as tx
from askloom.operators import index, vectorize
from askloom.schemas import DEFAULT, Config
from askloom.sources import storage


def validate(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): 1 to 2000 characters and not blank; top_k, where given, 1 to 20."""
    top_k = F.col("top_k") if "top_k" in questions.columns else F.lit(None).cast("int")
    text = F.coalesce("question", F.lit(""))
    bad = (tx.strip(text) == "") | (F.length(text) > 2000) | F.coalesce(~top_k.between(1, 20), F.lit(False))
    rejects = questions.filter(bad).select("question_id", F.lit("invalid_question").alias("code"))
    return questions.filter(~bad), rejects


def demoted(score: Column, is_reference: Column, config: Config = DEFAULT) -> Column:
    """Score to four places; a bibliography's counts less."""
    return F.round(F.when(is_reference, score * config.reference_penalty).otherwise(score), 4)


def rerank(hits: DataFrame, config: Config = DEFAULT, top_k: int | None = None) -> DataFrame:
    """hits(question_id, chunk_id, score, is_reference, ...) -> raw_score, score, rank: demote, floor, best first, cut.

    Ties of the rounded score go to the higher raw score, then to the smaller chunk_id.
    """
    k = F.coalesce("top_k", F.lit(top_k or config.top_k)) if "top_k" in hits.columns else F.lit(top_k or config.top_k)
    scored = hits.withColumn("raw_score", F.col("score")).withColumn("score", demoted(F.col("score"), F.coalesce("is_reference", F.lit(False)), config))
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("raw_score"), "chunk_id")
    return scored.filter(F.col("score") >= config.min_similarity).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def retrieve(questions: DataFrame, vectors: DataFrame | None, config: Config = DEFAULT, model: Callable = vectorize.HashingModel, chunks: DataFrame | None = None) -> DataFrame:
    """questions(question_id, question, top_k?, document_id?) x vectors -> ranked hits with snippet and token estimate.

    Without vectors, those of the titles and texts of `chunks`, a stored table, are made in the tasks that search them, and
    never written; the hits' other columns are read from `chunks`."""
    asked, k = vectorize.embed(questions, "question", model), config.top_k * config.candidate_multiplier
    if vectors is None:
        titled = chunks.withColumn("embed_text", vectorize.title_aware(F.col("text"), F.col("filename")))
        hits = index.knn(titled, asked, k, document="doc_id", model=model)
    else:
        hits = index.knn(vectors, asked, k, document="doc_id")
    columns = [c for c in ("question", "top_k") if c in questions.columns]
    if chunks is not None:
        hits = storage.materialize(hits, "hits")
    joined = hits.drop("rank").join(vectors.drop("embedding", "embedding_model") if chunks is None else chunks, "chunk_id").join(questions.select("question_id", *columns), "question_id")
    return rerank(joined, config).withColumn("snippet", tx.snippet(F.col("text"))).withColumn("token_estimate", tx.estimate_tokens(F.col("text"))).withColumn("distance", F.round("distance", 4))


def summary(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per question: hits, best, mean score and the margin of the best over the mean of the rest; zeros without hits."""
    per = retrieved.groupBy("question_id").agg(
        F.count(F.lit(1)).cast("int").alias("returned"),
        F.max("score").alias("top_score"),
        F.round(F.avg("score"), 4).alias("average_score"),
        margin().alias("margin"),
    )
    zero = {"returned": 0, "top_score": 0.0, "average_score": 0.0, "margin": 0.0}
    return questions.select("question_id").join(per, "question_id", "left").fillna(zero)


def margin() -> Column:
    """Best score minus the mean of the others (the best itself, if it is alone)."""
    rest = F.try_divide(F.sum("score") - F.max("score"), F.count(F.lit(1)) - 1)
    return F.max("score") - F.coalesce(rest, F.lit(0.0))
