"""Grounding and answers: context, coverage, confidence, gate, extractive answers, citations and prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions import text as tx
from askloom.operators import retrieve
from askloom.schemas import DEFAULT, EMPTY_CORPUS, INSTRUCTION, NO_ANSWER, SOURCE, Config


def flags(page: Column, is_reference: Column) -> Column:
    paged = F.when(page.isNotNull(), F.concat(F.lit(" | page "), page.cast("string"))).otherwise(F.lit(""))
    return F.concat(paged, F.when(is_reference, F.lit(" | bibliography")).otherwise(F.lit("")))


def context_block(rank: Column, filename: Column, chunk_index: Column, page: Column, is_reference: Column, text: Column) -> Column:
    head = F.format_string("[Source %d] file: %s | chunk %d", rank, filename, chunk_index)
    return F.concat(head, flags(page, is_reference), F.lit("\n"), tx.strip(text))


def contexts(retrieved: DataFrame) -> DataFrame:
    """Per question: the numbered context, and the text that coverage is measured on (name, page and body of each hit)."""
    block = context_block(F.col("rank"), F.col("filename"), F.col("chunk_index"), F.col("page"), F.col("is_reference"), F.col("text"))
    cover = F.trim(F.concat_ws(" ", F.col("filename"), F.coalesce(F.col("page").cast("string"), F.lit("")), F.col("text")))
    return retrieved.withColumn("block", block).withColumn("cover", cover).groupBy("question_id").agg(
        F.expr("listagg(block, '\n\n') WITHIN GROUP (ORDER BY rank)").alias("context"),
        F.expr("listagg(cover, ' ') WITHIN GROUP (ORDER BY rank)").alias("coverage_text"),
    )


def prompts(answers: DataFrame) -> DataFrame:
    """answers(question, context) with what to give to a model: its instruction (`system`), the task (`user`), both in one
    text (`prompt`), and the beginning of the task to show to people (`preview`)."""
    user = F.concat(F.lit("Context:\n"), F.col("context"), F.lit("\n\nQuestion:\n"), tx.strip(F.col("question")), F.lit("\n\nAnswer:"))
    out = answers.withColumn("system", F.lit(INSTRUCTION)).withColumn("user", user)
    return out.withColumn("prompt", F.concat("system", "user")).withColumn("preview", tx.truncate(F.col("user"), DEFAULT.preview_chars))


def citations(retrieved: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per question: the first distinct (document, chunk) hits in rank order."""
    key = Window.partitionBy("question_id", "doc_id", "chunk_index").orderBy("rank")
    first = retrieved.withColumn("_again", F.row_number().over(key)).filter("_again = 1")
    order = Window.partitionBy("question_id").orderBy("rank")
    few = first.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= config.max_sources)
    source = F.struct(
        "rank", F.col("doc_id").alias("document_id"), "filename", "chunk_index", "page",
        tx.snippet(F.col("text"), config.source_snippet_chars).alias("snippet"), "score",
    )
    in_order = F.array_sort(F.collect_list(source))
    return few.groupBy("question_id").agg(F.transform(in_order, lambda s: s.dropFields("rank")).alias("sources"))


def confidence(similarity: Column, coverage: Column, margin: Column) -> tuple[Column, Column]:
    """(confidence, its rounded parts). Weights and ceilings are fixed values."""
    parts = F.struct(
        F.round(tx.clamp01(similarity / 0.75), 4).alias("similarity"),
        F.round(tx.clamp01(coverage), 4).alias("coverage"),
        F.round(tx.clamp01(margin / 0.25), 4).alias("margin"),
    )
    blended = 0.45 * parts["similarity"] + 0.35 * parts["coverage"] + 0.20 * parts["margin"]
    return F.round(tx.clamp01(blended), 4), parts


def reason(corpus_size: Column, returned: Column, coverage: Column, config: Config = DEFAULT) -> Column:
    """Why a question is not answered, or `answered`."""
    return (
        F.when(corpus_size == 0, "empty corpus").when(returned == 0, "no relevant chunks")
        .when(coverage < config.grounding_threshold, "context did not cover the question").otherwise("answered")
    )


# --- extractive answers ---------------------------------------------------------------------------------------------


def prose(text: Column) -> Column:
    """Lines of a hit joined to prose: blank and rule lines out, headings ended by a full stop."""
    lines = F.filter(F.transform(F.split(text, "\n"), tx.strip), lambda x: (x != "") & ~x.rlike(r"^[-=_*~]{3,}$"))
    return F.array_join(F.transform(lines, lambda x: F.when(tx.is_heading(x), F.concat(x, F.lit("."))).otherwise(x)), " ")


def sentence_rows(retrieved: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(question_id, question, rank, pos, sentence, filename) of the hits that are not bibliographies."""
    split = F.transform(tx.sentences(prose(F.col("text"))), tx.strip)
    rows = retrieved.filter(~F.coalesce("is_reference", F.lit(False))).select("question_id", "question", "rank", "filename", F.posexplode(split).alias("pos", "sentence"))
    return rows.filter(F.length("sentence") > config.min_sentence_chars)


def distinct_sentences(rows: Column) -> Column:
    """Of an ordered array of sentences with their token sets, those that neither hold nor are held by an earlier one."""
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    known = lambda kept, row: F.exists(kept, lambda k: within(row["tokens"], k["tokens"]) | within(k["tokens"], row["tokens"]))
    return F.aggregate(
        F.filter(rows, lambda r: F.size(r["tokens"]) > 0),
        F.filter(rows, lambda r: F.lit(False)),
        lambda kept, row: F.when(known(kept, row), kept).otherwise(F.concat(kept, F.array(row))),
    )


def sentence_score(terms: Column, body: Column, label: Column) -> Column:
    """Question terms in the sentence, half as much for those that only the label has, and their density."""
    overlap = F.size(F.array_intersect(terms, body))
    by_label = F.size(F.array_intersect(F.array_except(terms, body), label))
    return overlap + 0.5 * by_label + overlap / F.greatest(F.size(body), F.lit(1))


def within_budget(text: Column, limit: int) -> Column:
    """Whole sentences up to a number of characters; the first always, and a hard cut if it is alone too long."""
    fold = F.aggregate(
        tx.sentences(text),
        F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept")),
        lambda s, part: F.when(s["full"] | ((s["used"] > 0) & (s["used"] + F.length(part) + 1 > limit)), F.struct(s["used"].alias("used"), F.lit(True).alias("full"), s["kept"].alias("kept"))).otherwise(
            F.struct((s["used"] + F.length(part) + 1).alias("used"), F.lit(False).alias("full"), F.concat(s["kept"], F.array(part)).alias("kept"))
        ),
    )
    joined = F.array_join(fold["kept"], " ")
    return F.when(F.length(text) <= limit, text).when(joined != "", joined).otherwise(F.substring(text, 1, limit))


def extract(retrieved: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(question_id, answer): the best sentences in their order, or the no-answer message."""
    tokens = F.array_distinct(tx.tokens(F.col("sentence")))
    row = F.struct("rank", "pos", "sentence", tokens.alias("tokens"), tx.content_terms(F.col("sentence")).alias("body"), tx.content_terms(F.col("filename")).alias("label"))
    per = sentence_rows(retrieved, config).groupBy("question_id").agg(F.any_value("question").alias("question"), F.array_sort(F.collect_list(row)).alias("rows"))
    terms = tx.content_terms(F.col("question"))
    unique = per.withColumn("terms", terms).withColumn("rows", distinct_sentences(F.col("rows")))
    scored = F.transform("rows", lambda r, i: F.struct((-sentence_score(F.col("terms"), r["body"], r["label"])).alias("by"), i.alias("place"), r["sentence"].alias("sentence")))
    best = F.slice(F.array_sort(F.filter(scored, lambda r: r["by"] < 0)), 1, config.max_sentences)
    text = F.array_join(F.transform(F.array_sort(F.transform(best, lambda r: F.struct(r["place"].alias("place"), r["sentence"].alias("sentence")))), lambda r: r["sentence"]), " ")
    out = unique.withColumn("text", text)
    return out.select("question_id", F.when(F.col("text") == "", F.lit(NO_ANSWER)).otherwise(within_budget(F.col("text"), config.max_answer_chars)).alias("answer"))


def generate(prompted: DataFrame, model: Callable[[], Callable[[list[str]], list[str]]], batch: int = 32) -> DataFrame:
    """(question_id, answer) by a model over the prompt table; `model` makes it once in each task."""

    def run(batches):
        use = model()
        for part in batches:
            part["answer"] = [a for k in range(0, len(part), batch) for a in use(part["prompt"][k : k + batch].tolist())]
            yield part[["question_id", "answer"]]

    schema = T.StructType([prompted.schema["question_id"], T.StructField("answer", T.StringType())])
    return prompted.select("question_id", "prompt").mapInPandas(run, schema)


# --- the job --------------------------------------------------------------------------------------------------------


def grounding(questions: DataFrame, retrieved: DataFrame, corpus_size: int, config: Config = DEFAULT) -> DataFrame:
    """Per question: summary, context, coverage, confidence and the gate's reason. Questions without hits stay."""
    facts = retrieve.summary(questions, retrieved).join(contexts(retrieved), "question_id", "left").join(questions.select("question_id", "question"), "question_id")
    covered = F.when(F.col("returned") == 0, F.lit(0.0)).otherwise(tx.coverage(tx.content_terms(F.col("question")), tx.content_terms(F.col("coverage_text"))))
    out = facts.withColumn("raw_coverage", covered).withColumn("coverage", F.round("raw_coverage", 4))
    value, parts = confidence(F.col("top_score"), F.col("raw_coverage"), F.col("margin"))
    return out.withColumn("confidence", F.when(F.col("returned") == 0, F.lit(0.0)).otherwise(value)).withColumn("confidence_breakdown", parts).withColumn("reason", reason(F.lit(corpus_size), F.col("returned"), F.col("raw_coverage"), config))


def answer(questions: DataFrame, retrieved: DataFrame, corpus_size: int, config: Config = DEFAULT, model: Callable | None = None) -> DataFrame:
    """One row a question: answer, whether it is grounded, confidence, citations. Gated questions are not generated."""
    facts = grounding(questions, retrieved, corpus_size, config)
    passed = facts.filter("reason = 'answered'").select("question_id", "question", "context")
    made = generate(prompts(passed), model) if model else extract(retrieved.join(passed.select("question_id"), "question_id", "left_semi"), config)
    message = F.when(F.col("reason") == "empty corpus", F.lit(EMPTY_CORPUS)).when(F.col("reason") != "answered", F.lit(NO_ANSWER)).otherwise(F.coalesce(F.nullif(tx.strip(F.col("made")), F.lit("")), F.lit(NO_ANSWER)))
    joined = facts.join(made.withColumnRenamed("answer", "made"), "question_id", "left").join(citations(retrieved, config), "question_id", "left").withColumn("answer", message)
    abstained = (F.col("reason") != "answered") | F.lower("answer").contains(NO_ANSWER.lower())
    out = joined.withColumn("abstained", abstained).withColumn("grounded", ~F.col("abstained"))
    out = out.withColumn("confidence", F.when(F.col("abstained"), F.round(F.col("confidence") * 0.5, 4)).otherwise(F.col("confidence")))
    return out.select(
        "question_id", "question", "answer", "grounded", "abstained", "reason", "confidence", tx.confidence_label(F.col("confidence"), F.col("grounded")).alias("confidence_label"),
        "confidence_breakdown", "coverage", "returned", "top_score", "average_score",
        F.when(F.col("grounded"), F.col("sources")).otherwise(F.filter("sources", lambda s: F.lit(False))).alias("sources"),
    )


def history_rows(answers: DataFrame, created_at: Column, llm_model: Column, response_time_ms: Column) -> DataFrame:
    """Answers as entries of the history; append them with readers.append_history."""
    entry = tx.generated_id("ans_", F.col("question_id").cast("string"), created_at.cast("string"))
    return answers.select(
        entry.alias("id"), "question", "answer", "confidence", "confidence_label", response_time_ms.cast("double").alias("response_time_ms"), created_at.alias("created_at"),
        llm_model.alias("llm_model"), "top_score", F.transform(F.coalesce("sources", F.array()), lambda s: s.cast(SOURCE)).alias("sources"),
    )
