"""Operator 1: mixing sources to target weights, as DataFrame operations only.

Every row has a uniform hash key. Within a source the keys are cut into equal key ranges (about the square root of the
source's rows), the ranges' token sums are added up in order, and the budget ends in one range of each source: only that
range's rows are put in order and added up one by one. A source whose budget exceeds its tokens gives whole epochs first.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; equal rows are told apart by
nothing and each counts; an empty table gives an empty result. The document in which a budget ends is taken in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.llm._shared import WORD, hash60, materialize, spread

SALT = "mix"


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """totals(source, source_size, n) -> with target: share * all sizes dealt by weight, at most epochs * source_size.

    Sources take the weights in turn by code point, null last. A source is at its cap exactly if its cap per weight is no
    more than what the budget left by all sources with a smaller cap per weight gives per weight, so one ordered pass over
    the sources (one row each) replaces repeated resharing.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("per_weight", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        totals.withColumn("turn", (F.row_number().over(by_name) - 1) % len(weights))
        .withColumn("weight", F.element_at(turn, F.col("turn") + 1))
        .withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("per_weight", F.col("cap") / F.col("weight"))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(after))
        .withColumn("capped", F.col("cap") * F.col("weight_left") <= F.col("left") * F.col("weight"))
    )
    # Beyond the last capped source all share one rate: that of the first source which is not at its cap.
    rate = F.min(F.when(~F.col("capped"), F.struct("per_weight", F.col("source").isNull(), "source", "left", "weight_left"))).over(everything)
    return (
        ranked.withColumn("rate", rate)
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("rate.left") / F.col("rate.weight_left")))
        .select("source", "source_size", "n", "target")
    )


def cuts(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """sized(source, size, mix_key) -> one row a source: target, whole epochs, and the key range where the budget ends."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = materialize(
        targets(totals, weights, share, epochs)
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("source_size"))
        .withColumn("ranges", F.ceil(F.sqrt(F.col("n"))).cast("long")),
        "mix-plan",
    )
    key = F.col("source").eqNullSafe(F.col("p_source"))
    named = plan.withColumnRenamed("source", "p_source")
    sums = (
        sized.join(named.select("p_source", "ranges"), key)
        .groupBy("source", spread(F.col("mix_key"), F.col("ranges")).alias("range"))
        .agg(F.sum("size").alias("range_size"))
    )
    w = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        sums.withColumn("through", F.sum("range_size").over(w))
        .join(named.select("p_source", "rest"), key)
        .filter((F.col("through") > F.col("rest")) & (F.col("through") - F.col("range_size") <= F.col("rest")))
        .groupBy("source")
        .agg(F.min(F.struct("range", (F.col("rest") - F.col("through") + F.col("range_size")).alias("room"))).alias("end"))
    )
    return materialize(
        named.join(ends, key, "left").select("p_source", "source_size", "target", "whole", "ranges", F.col("end.range").alias("end_range"), F.col("end.room").alias("room")),
        "mix-cuts",
    )


def keyed(docs: DataFrame) -> DataFrame:
    """Adds size and mix_key to rows with doc_id, text and source."""
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("mix_key", hash60("doc_id", SALT))


def taken(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and taken to rows of (doc_id, source, size, mix_key, anything else)."""
    kept = sized.columns
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    placed = joined.withColumn("range", spread(F.col("mix_key"), F.col("ranges")))
    at_end = F.coalesce(F.col("range") == F.col("end_range"), F.lit(False))
    rest = placed.filter(~at_end).withColumn("taken", F.col("size") * (F.col("whole") + F.when(F.col("range") < F.col("end_range"), 1).otherwise(0)))
    w = Window.partitionBy("source").orderBy("mix_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        placed.filter(at_end)
        .withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
        .withColumn("taken", F.col("size") * F.col("whole") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - F.col("before"))))
    )
    names = [*kept, "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return rest.select(*names).unionByName(edge.select(*names))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, source, size, source_size, target, taken: words that the mix takes."""
    sized = materialize(keyed(docs.select("doc_id", "text", "source")).select("doc_id", "source", "size", "mix_key"), "mix-sizes")
    return taken(sized, cuts(sized, weights, share, epochs)).drop("mix_key")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each epoch of a document; the one at a budget's end is cut."""
    names = docs.columns
    clash = [c for c in ("size", "mix_key", "source_size", "target", "taken", "p_source", "whole", "ranges", "end_range", "room", "range", "before", "copy") if c in names]
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "text", "source") if clash else docs.withColumn("row", F.struct(*[F.col(f"`{c}`") for c in names])).select("row", "doc_id", "text", "source")
    sizes = materialize(keyed(docs.select("doc_id", "text", "source")).select("source", "size", "mix_key"), "mix-sizes")
    plan = cuts(sizes, weights, share, epochs)
    out = taken(keyed(body), plan).filter("taken > 0")
    size, left = F.col("size"), F.col("taken")
    # One entry a copy: how many of its words that copy holds.
    copies = F.transform(F.sequence(F.lit(1).cast("long"), F.ceil(left / size)), lambda k: F.least(size, left - (k - 1) * size))
    words = F.split(F.col("text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    out = out.withColumn("copy", F.explode(copies))
    text = F.when(F.col("copy") >= size, F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.col("copy").cast("int")), ""))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])
