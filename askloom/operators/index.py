"""The vector table: set operations on rows, a stored table in versions, and an approximate search by signs.

Exact searches are in `nearest`, the neighbour graph is in `graph`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.operators import nearest
from askloom.operators.nearest import batch_types, knn, matrix
from askloom.operators.vectorize import l2_normalize
from askloom.schemas import VECTORS
from askloom.sources import buckets

__all__ = ["batch_types", "knn"]


# --- set operations -------------------------------------------------------------------------------------------------


def one_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key: the first by `order`, and then by a hash of the row (maps left out), the same in every run."""
    hashed = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    first = Window.partitionBy(key).orderBy(*order, F.xxhash64(*hashed))
    return rows.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")


def upsert(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows replace those with their key; of incoming rows with the same key, one_per_key takes one."""
    incoming = one_per_key(incoming, key)
    return table.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def insert_ignore(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Only incoming rows with a new key are added, one a key."""
    return table.unionByName(new_rows(table, incoming, key))


def new_rows(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    return one_per_key(incoming, key).join(table.select(key), key, "left_anti")


def number_added(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """One row: how many rows insert_ignore adds."""
    return new_rows(table, incoming, key).agg(F.count(F.lit(1)).alias("added"))


def append(table: DataFrame, incoming: DataFrame, key: str = "chunk_id", mode: str = "upsert") -> DataFrame:
    if mode not in ("upsert", "ignore"):
        raise ValueError(f"mode {mode}: upsert or ignore")
    return (upsert if mode == "upsert" else insert_ignore)(table, incoming, key)


def merge_latest(incoming: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """One row a key, incoming before current."""
    both = incoming.withColumn("_age", F.lit(0)).unionByName(current.withColumn("_age", F.lit(1)))
    return one_per_key(both, key, F.col("_age")).drop("_age")


def delete_documents(table: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def lookup(table: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows with these keys, keys that have no row)."""
    return table.join(ids.select(key), key, "left_semi"), ids.select(key).distinct().join(table.select(key), key, "left_anti")


def replaced_documents(registry: DataFrame, uploads: DataFrame) -> DataFrame:
    """Registry rows that an upload with the same content and name replaces."""
    return registry.join(uploads.select("fingerprint", "filename").distinct(), ["fingerprint", "filename"], "left_semi")


def preview(chunks: DataFrame, limit: int = 5, key: str = "doc_id", order: str = "chunk_index") -> DataFrame:
    """The first chunks of each document, 1 to 25 of them."""
    first = Window.partitionBy(key).orderBy(order)
    return chunks.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= min(25, max(1, limit))).drop("_k")


def count_by_document(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key)).agg(F.count(F.lit(1)).alias("chunks"))


def status(vectors: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return vectors.agg(F.when(n > 0, "ready").otherwise("empty").alias("status"), n.alias("rows"), F.max(F.size("embedding")).alias("dimension"), F.lit("cosine").alias("metric"))


def reset(spark: SparkSession, path: str) -> None:
    """An empty version of the table, which can be written to; a new table, where there is none."""
    try:
        buckets.reset(spark, path)
    except FileNotFoundError:
        save_vectors(spark.createDataFrame([], VECTORS), path)


def save_vectors(vectors: DataFrame, path: str, key: str = "chunk_id", by: str = "doc_id", number: int = 64) -> None:
    """Vectors and records as one table, so that they cannot part: a new version, in buckets of a hash of their documents.
    buckets.change and buckets.delete write parts of it."""
    buckets.create(vectors, path, key, by, number)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the stored table, its vectors of length one."""
    stored = buckets.read(spark, path)
    kind = stored.schema["embedding"].dataType
    return stored.withColumn("embedding", l2_normalize(F.col("embedding")).cast(kind))


def metadata_of(rows: DataFrame, *names: str) -> Column:
    """The named columns as one map of strings: nulls left out, nested values as JSON."""

    def shown(name: str) -> Column:
        nested = isinstance(rows.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
        return F.to_json(F.col(name)) if nested else F.col(name).cast("string")

    return sanitize_metadata(F.create_map(*[x for n in names for x in (F.lit(n), shown(n))]))


def sanitize_metadata(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda _, v: v.isNotNull())


# --- search ---------------------------------------------------------------------------------------------------------

#: Queries whose bands are compared with those of a run of vectors at once.
QUERIES_AT_ONCE = 256


def knn_lsh(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", bands: int = 24, bits: int = 6, seed: int = 11, block: int = nearest.QUERY_BLOCK) -> DataFrame:
    """Approximate top-k: signs against random directions, banded; candidates that share a band are scored exactly.

    Directions are drawn for each width; a query meets the vectors of its own width, and no others. Vectors are read once, in
    runs that meet the blocks of queries as in nearest.knn: bands are compared in the task, and k hits a query and task are
    shuffled, no pairs.
    """
    schema = T.StructType([T.StructField("question_id", queries.schema["question_id"].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("score", T.DoubleType())])
    load = nearest.query_blocks(queries.select("question_id", "embedding"), block)
    planes: dict[int, np.ndarray] = {}

    def codes(x: np.ndarray) -> np.ndarray:
        """A row a band, with the codes of all vectors."""
        width = x.shape[1]
        if width not in planes:
            planes[width] = np.random.default_rng(seed).standard_normal((bands * bits, width)).astype(np.float32)
        sign = (x @ planes[width].T > 0).reshape(-1, bands, bits)
        return np.ascontiguousarray((sign * (1 << np.arange(bits))).sum(axis=2).T.astype(np.uint8 if bits <= 8 else np.int64))

    def run(batches):
        seen = nearest.Collector(k)
        for batch in batches:
            for at in range(0, len(batch), nearest.RUN):
                part, by_width = batch.slice(at, nearest.RUN), {}
                for name, some in load():
                    width = some.rows.shape[1]
                    if width not in by_width:
                        x, ok = matrix(part.column(1), width)
                        by_width[width] = x[ok], np.array(part.column(0).filter(ok).to_pylist()), codes(x[ok])
                    x, keys, theirs = by_width[width]
                    if len(x):
                        meet(some, name, x, keys, codes(some.rows), theirs, seen)
                    if seen.held > nearest.HELD:
                        yield from seen.drain(schema)
        yield from seen.drain(schema)

    def meet(some, name, x, keys, ours, theirs, seen) -> None:
        bar = seen.bar(name, len(some.ids))
        for a in range(0, len(some.ids), QUERIES_AT_ONCE):
            few = slice(a, a + QUERIES_AT_ONCE)
            for b in range(0, len(x), nearest.VECTORS_AT_ONCE):
                them = slice(b, b + nearest.VECTORS_AT_ONCE)
                near = np.zeros((len(ours[0, few]), len(theirs[0, them])), bool)
                for band in range(bands):
                    near |= ours[band, few, None] == theirs[band, None, them]
                scores = np.where(near, np.round(some.rows[few] @ x[them].T, 6), -np.inf)
                if scores.shape[1] >= k:
                    bar[few] = np.maximum(bar[few], np.partition(scores, -k, axis=1)[:, -k])
                row, at = np.nonzero((scores >= bar[few][:, None]) & near)
                if len(row):
                    seen.add(name, some.ids, (row + a, scores[row, at], keys[them][at]))

    found = vectors.select(key, "embedding").mapInArrow(run, schema)
    return nearest.ranked(found, k, key).select("question_id", key, "score", "rank")
