"""Corpus lifecycle: ingest, replace, delete, re-index, rebuild, reset; registry records and stage metrics.

A corpus is four tables (segments, chunks with vectors, registry, rejects). Jobs take tables and return tables; nothing is
changed in place, so a failed job leaves the old version.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from askloom.functions import text as tx
from askloom.operators import chunk, clean, index, vectorize
from askloom.schemas import DEFAULT, STAGE_METRICS, Config
from askloom.sources import readers, storage


@dataclass(frozen=True)
class Corpus:
    """segments(doc_id, filename, page, seq, text), vectors (chunks and embeddings), registry, rejects."""

    segments: DataFrame
    vectors: DataFrame
    registry: DataFrame
    rejects: DataFrame


def records(docs: DataFrame, chunks: DataFrame, now) -> DataFrame:
    """docs(doc_id, filename, segments), chunks with the counts of their texts -> registry rows: ready with counts, or error
    where cleaning left no chunk."""
    raw = docs.select("doc_id", "filename", size_of("segments").alias("size_bytes"), F.array_max(F.transform("segments", lambda s: s["page"])).alias("page_count"), tx.fingerprint(F.array_join(F.transform("segments", lambda s: s["text"]), "\n\n")).alias("fingerprint"))
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"), F.max("clean_chars").cast("long").alias("char_count"), F.max("clean_words").cast("long").alias("word_count"))
    joined = raw.join(counts, "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("id"), "filename", tx.file_extension(F.col("filename")).alias("extension"), "size_bytes", tx.human_size(F.col("size_bytes")).alias("size_display"),
        F.when(F.col("chunk_count") > 0, "ready").otherwise("error").alias("status"), now.alias("uploaded_at"), now.alias("updated_at"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "page_count", F.coalesce("char_count", F.lit(0)).cast("long").alias("char_count"), F.coalesce("word_count", F.lit(0)).cast("long").alias("word_count"),
        "fingerprint", F.when(F.col("chunk_count").isNull(), "processing_failed").alias("error"),
    )


def size_of(segments: str) -> Column:
    return F.aggregate(segments, F.lit(0).cast("long"), lambda n, s: n + F.octet_length(F.coalesce(s["text"], F.lit(""))))


def checked(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """docs(doc_id, filename, segments) with the code of those that are refused."""
    fullest = F.array_max(F.transform("segments", lambda s: tx.strip(F.coalesce(s["text"], F.lit("")))))
    return docs.withColumn("code", readers.reject_code(tx.file_extension(F.col("filename")), size_of("segments"), fullest, config))


def documents_of(segments: DataFrame) -> DataFrame:
    """Rows of segments, or documents with an array of them, as documents (the latter are not shuffled)."""
    return segments if "segments" in segments.columns else chunk.assembled(segments)


#: Characters and words of a document's clean text, which its chunks carry until the registry has them.
COUNTS = ("clean_chars", "clean_words")


def counted(cleaned: DataFrame) -> DataFrame:
    return cleaned.withColumn("clean_chars", F.length("clean_text")).withColumn("clean_words", tx.word_count(F.col("clean_text")))


def ingest(segments: DataFrame, config: Config = DEFAULT, model: Callable = vectorize.HashingModel, now=None) -> Corpus:
    """Validates, cleans, cuts and embeds; documents that fail become rejects, not exceptions: those that are refused, and
    those of which cleaning leaves nothing. segments: rows, or documents with an array of them.

    Texts are cleaned and cut once: the chunks are written to the shared folder, and vectors, registry and rejects are made
    of what is written."""
    now = F.current_timestamp() if now is None else now
    docs = checked(documents_of(segments), config)
    good = docs.filter("code IS NULL").select("doc_id", "filename", "segments")
    cleaned = counted(clean.whole_documents(good, config.min_occurrences))
    chunks = storage.materialize(chunk.cut_documents(cleaned, config, COUNTS), "chunks")
    registry = records(good, chunks, now)
    failed = registry.filter("status = 'error'").select("filename", F.col("error").alias("code"))
    rejects = readers.with_reasons(docs.filter("code IS NOT NULL").select("filename", "code").union(failed), config)
    rows = good.select("doc_id", "filename", F.inline("segments")).select("doc_id", "filename", "page", "seq", "text")
    return Corpus(rows, embedded(chunks.drop(*COUNTS), model), registry, rejects)


def embedded(chunks: DataFrame, model: Callable = vectorize.HashingModel) -> DataFrame:
    """Chunks with the vectors of their titles and texts."""
    source = vectorize.title_aware(F.col("text"), F.col("filename"))
    return vectorize.embed(chunks.withColumn("embed_text", source), "embed_text", model).drop("embed_text")


def upload(corpus: Corpus, segments: DataFrame, **options) -> Corpus:
    """Adds documents. Those with the content and name of a known document replace it, in every table."""
    new = ingest(segments, **options)
    # written, as each is used several times and is made of all texts
    corpus, new = (replace(c, registry=storage.materialize(c.registry, "registry")) for c in (corpus, new))
    old = index.replaced_documents(corpus.registry, new.registry).select(F.col("id").alias("doc_id"))
    again = new.registry.select(F.col("id").alias("doc_id"))
    base = delete(corpus, old.union(again))
    return Corpus(*(a.unionByName(b, allowMissingColumns=True) for a, b in ((base.segments, new.segments), (base.vectors, new.vectors), (base.registry, new.registry), (base.rejects, new.rejects))))


def delete(corpus: Corpus, ids: DataFrame) -> Corpus:
    """Removes documents(doc_id) from every table, so a rebuild does not bring them back."""
    return replace(
        corpus, segments=index.delete_documents(corpus.segments, ids), vectors=index.delete_documents(corpus.vectors, ids),
        registry=index.delete_documents(corpus.registry, ids.select(F.col("doc_id").alias("id")), "id"),
    )


def reindex(corpus: Corpus, ids: DataFrame, **options) -> Corpus:
    """The given documents with the present settings; their new rows are made before the old ones go."""
    chosen = corpus.segments.join(ids.select("doc_id"), "doc_id", "left_semi")
    new = ingest(chosen, **options)
    return replace(corpus, vectors=index.delete_documents(corpus.vectors, ids).unionByName(new.vectors), registry=index.upsert(corpus.registry, new.registry, "id"))


def rebuild(corpus: Corpus, **options) -> Corpus:
    """Everything from the kept segments, with the same ids and names."""
    return ingest(corpus.segments, **options)


def reset(corpus: Corpus) -> tuple[Corpus, dict[str, int]]:
    """Empty tables of the same schemas, and how many documents and chunks there were."""
    counts = {"documents": corpus.registry.count(), "chunks": corpus.vectors.count()}
    return Corpus(*(t.limit(0) for t in (corpus.segments, corpus.vectors, corpus.registry, corpus.rejects))), counts


def recover_names(files: DataFrame) -> DataFrame:
    """Stored files back to (doc_id, filename): the id in the stored name, else one made from the name."""
    made = tx.generated_id("doc_", F.col("filename"))
    return files.withColumn("doc_id", F.coalesce(tx.stored_doc_id(F.col("filename")), made)).withColumn("filename", tx.stored_name(F.col("filename")))


@dataclass
class Trace:
    """Times the stages of a run. A stage's counts are observed while its table is written."""

    spark: SparkSession
    run_id: str
    rows: list[tuple] = field(default_factory=list)

    def stage(self, name: str, df: DataFrame, path: str, **metrics) -> DataFrame:
        """Writes df and reads it back; metrics are aggregate columns."""
        seen, began, status, detail, got = Observation(f"{self.run_id}-{name}"), time.perf_counter(), "completed", "", {}
        try:
            df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]).write.mode("overwrite").parquet(path)
            got = {k: str(v) for k, v in seen.get.items()}
        except Exception as error:
            status, detail = "failed", str(error)[:200]
            raise
        finally:
            self.rows.append((self.run_id, None, name, status, (time.perf_counter() - began) * 1000, detail, got))
        return self.spark.read.parquet(path)

    def check(self, name: str, df: DataFrame) -> None:
        """A stage that finds its rows in place: counts them."""
        began = time.perf_counter()
        rows = df.count()
        self.rows.append((self.run_id, None, name, "completed", (time.perf_counter() - began) * 1000, "", {"rows": str(rows)}))

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, STAGE_METRICS)


# The stages of a run, in order; the last two are those of questions.
STAGES = ("ingest", "extraction", "cleaning", "chunking", "embedding", "vector_store", "retrieval", "generation")


def traced_ingest(segments: DataFrame, folder: str, run_id: str, config: Config = DEFAULT, model: Callable = vectorize.HashingModel, now=None) -> tuple[Corpus, DataFrame]:
    """ingest() with a table written after each stage, and the metrics of the stages: of the run, and of each document.

    A document's duration is its share of the stage's wall time by characters, as a stage handles all documents at once.
    """
    now = F.current_timestamp() if now is None else now
    spark, trace = segments.sparkSession, Trace(segments.sparkSession, run_id)
    docs = trace.stage("ingest", checked(documents_of(segments), config), f"{folder}/documents", refused=F.count("code"))
    good = docs.filter("code IS NULL")
    read = trace.stage("extraction", good.select("doc_id", "filename", "segments"), f"{folder}/extracted", segments=F.sum(F.size("segments")), bytes=F.sum(size_of("segments")))
    cleaned = trace.stage("cleaning", clean.whole_documents(read, config.min_occurrences), f"{folder}/cleaned", chars=F.sum(F.length("clean_text")))
    chunks = trace.stage("chunking", chunk.cut_documents(counted(cleaned), config, COUNTS), f"{folder}/chunks", longest=F.max(F.length("text")))
    stored = trace.stage("embedding", embedded(chunks.drop(*COUNTS), model), f"{folder}/vectors", dimension=F.max(F.size("embedding")))
    trace.check("vector_store", stored)
    registry = records(read, chunks, now)
    rejects = readers.with_reasons(docs.filter("code IS NOT NULL").select("filename", "code").union(registry.filter("status = 'error'").select("filename", F.col("error").alias("code"))), config)
    rows = read.select("doc_id", "filename", F.inline("segments")).select("doc_id", "filename", "page", "seq", "text")
    took = {row[2]: row[4] for row in trace.rows}
    per = document_stages(docs, cleaned, chunks, run_id, took)
    return Corpus(rows, stored, registry, rejects), trace.table().unionByName(per)


def document_stages(docs: DataFrame, cleaned: DataFrame, chunks: DataFrame, run_id: str, took: dict[str, float]) -> DataFrame:
    """Stage metrics of each of docs(doc_id, filename, segments, code): success, failed at the stage that refused it or left
    nothing of it, skipped after that. took: the milliseconds of the stages."""
    chars = F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.length(F.coalesce(s["text"], F.lit(""))))
    slim = docs.select("doc_id", "code", F.size("segments").alias("segments"), chars.alias("chars"))
    total = slim.filter("code IS NULL").agg(F.sum("chars").alias("all_chars"))  # one row
    sizes = cleaned.select("doc_id", F.length("clean_text").alias("clean_chars"))
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("char_count").alias("longest"))
    joined = slim.join(sizes, "doc_id", "left").join(counts, "doc_id", "left").crossJoin(F.broadcast(total))
    share = F.when(F.col("code").isNull(), F.col("chars") / F.greatest(F.lit(1), F.col("all_chars"))).otherwise(F.lit(0.0))
    ends = F.when(F.col("code").isNotNull(), 1).when(F.col("clean_chars").isNull(), 3).when(F.col("chunks").isNull(), 4).otherwise(99)
    text = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    metrics = {
        "ingest": ("code", F.coalesce("code", F.lit("accepted"))), "extraction": ("segments", text(F.col("segments"))), "cleaning": ("chars", text(F.col("clean_chars"))),
        "chunking": ("chunks", text(F.col("chunks"))), "embedding": ("vectors", text(F.col("chunks"))), "vector_store": ("rows", text(F.col("chunks"))),
    }
    rows = []
    for place, name in enumerate(STAGES[:6], 1):
        status = F.when(ends < place, "skipped").when(ends == place, "failed").otherwise("completed")
        key, value = metrics[name]
        duration = F.when(ends >= place, share * float(took.get(name, 0.0)))
        rows.append(F.struct(F.lit(name).alias("stage"), status.alias("status"), duration.cast("double").alias("duration_ms"), F.when(ends == place, F.coalesce("code", F.lit("processing_failed"))).otherwise("").alias("detail"), F.create_map(F.lit(key), value).alias("metrics")))
    per = joined.select("doc_id", F.explode(F.array(*rows)).alias("s"))
    return per.select(F.lit(run_id).alias("run_id"), F.col("doc_id").cast("string").alias("doc_id"), "s.stage", "s.status", "s.duration_ms", "s.detail", "s.metrics")
