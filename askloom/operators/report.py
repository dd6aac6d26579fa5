"""Dashboard aggregates, history retention and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions import text as tx
from askloom.schemas import DEFAULT


def chunk_stats(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    size = F.length("text")
    return chunks.groupBy(key).agg(
        F.count(F.lit(1)).alias("chunks"), F.min(size).alias("smallest"), F.max(size).alias("largest"), F.round(F.avg(size), 1).alias("average"),
        F.sum(tx.word_count(F.col("text"))).cast("long").alias("words"), F.sum(size).cast("long").alias("chars"),
    )


def noise_removed(raw: Column, clean: Column) -> Column:
    return F.when(raw > 0, F.round((raw - clean) / raw * 100, 2)).otherwise(F.lit(0.0))


def latency_stats(history: DataFrame) -> DataFrame:
    """history(response_time_ms, created_at) -> one row; the mean is 0 and the extremes null without questions."""
    return history.agg(
        F.count(F.lit(1)).alias("questions_asked"),
        F.coalesce(F.round(F.avg("response_time_ms"), 2), F.lit(0.0)).alias("average_response_time_ms"),
        F.round(F.min("response_time_ms"), 2).alias("fastest_response_ms"),
        F.round(F.max("response_time_ms"), 2).alias("slowest_response_ms"),
        F.max("created_at").alias("last_question_at"),
    )


def recent(history: DataFrame, limit: int = DEFAULT.history_limit, tie: str = "id") -> DataFrame:
    """The newest entries, newest first."""
    return history.orderBy(F.desc("created_at"), F.desc(tie)).limit(min(DEFAULT.history_limit, max(1, limit)))


def registry_listing(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.desc("uploaded_at"), "id")


def by_status(registry: DataFrame, status: str) -> DataFrame:
    return registry.filter(F.col("status") == status)


def listed_chunks(registry: DataFrame) -> DataFrame:
    """Chunks of the documents that a listing shows."""
    return registry.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunks"))


def registry_totals(registry: DataFrame) -> DataFrame:
    ready = F.col("status") == "ready"
    return registry.agg(
        F.count(F.lit(1)).alias("total_documents"), F.count_if(ready).alias("documents_ready"), F.count_if(F.col("status") == "error").alias("documents_error"),
        F.coalesce(F.sum(F.when(ready, F.col("chunk_count"))), F.lit(0)).cast("long").alias("registered_chunks"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_size_bytes"), F.max(F.when(ready, F.col("updated_at"))).alias("last_indexed_at"),
    )


def dashboard(registry: DataFrame, chunks: DataFrame, history: DataFrame) -> DataFrame:
    """One row: registry totals, size of the index and latencies. Each side of the joins is one row."""
    indexed = chunks.agg(F.count(F.lit(1)).alias("indexed_chunks"))
    return registry_totals(registry).crossJoin(indexed).crossJoin(latency_stats(history))


def outcome(results: DataFrame) -> DataFrame:
    """results(code): null for accepted. Counts and the batch's message."""
    counted = results.agg(F.count_if(F.col("code").isNull()).alias("created"), F.count_if(F.col("code").isNotNull()).alias("failed"))
    done = F.format_string("%d document(s) processed", F.col("created"))
    return counted.withColumn("message", F.when(F.col("failed") > 0, F.concat(done, F.format_string(", %d failed", F.col("failed")))).otherwise(done))


def processing_time(stages: DataFrame) -> DataFrame:
    return stages.groupBy("doc_id").agg(F.round(F.sum(F.coalesce("duration_ms", F.lit(0.0))), 2).alias("processing_ms"))


# --- exports --------------------------------------------------------------------------------------------------------


def history_markdown(history: DataFrame, tie: str = "id", by: list[str] | None = None) -> DataFrame:
    """One Markdown section an entry, numbered newest first: (by..., place, section).

    A history that retention has not cut is numbered within the groups `by`, so that no task holds all of it.
    """
    per_source = F.transform(
        F.coalesce("sources", F.array()),
        lambda s: F.concat(
            F.format_string("- `%s` - chunk #%d", s["filename"], s["chunk_index"]), F.when(s["page"].isNotNull(), F.format_string(", page %d", s["page"])).otherwise(F.lit("")),
            F.format_string(" (similarity %.4f)\n  > %s", s["score"], s["snippet"]),
        ),
    )
    sources = F.when(F.size(F.coalesce("sources", F.array())) > 0, F.concat(F.lit("**Sources**\n\n"), F.array_join(per_source, "\n"), F.lit("\n\n"))).otherwise(F.lit(""))
    place = F.row_number().over(Window.partitionBy(*(by or [])).orderBy(F.desc("created_at"), F.desc(tie)))
    head = F.format_string(
        "## %d. %s\n\n- **Confidence**: %.0f%% (%s)\n- **Response time**: %d ms\n- **Top similarity**: %.4f\n- **Model**: %s\n- **Asked at**: %s\n\n**Answer**\n\n%s\n\n",
        F.col("place"), F.col("question"), F.col("confidence") * 100, F.col("confidence_label"), F.round("response_time_ms").cast("long"), F.col("top_score"),
        F.coalesce("llm_model", F.lit("n/a")), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.col("answer"),
    )
    return history.withColumn("place", place).select(*(by or []), "place", F.concat(head, sources, F.lit("---\n")).alias("section"))


def history_json(history: DataFrame, exported_at: Column) -> DataFrame:
    """JSON lines with the envelope's fields beside each entry: (entry) rows; write with .text or .json."""
    total = history.agg(F.count(F.lit(1)).alias("total"))
    return history.crossJoin(total).select(F.to_json(F.struct(exported_at.cast("string").alias("exported_at"), "total", F.struct(*[F.col(c) for c in history.columns]).alias("entry"))).alias("line"))
