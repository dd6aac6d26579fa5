"""Exact nearest vectors for tables of queries: a join of blocks of queries with runs of vectors, in one stage.

Queries are held in blocks. Up to one block of them goes to the tasks with the code (its size is checked); more are written
to the shared folder, and the driver holds the blocks' names only. A task reads its vectors once, in runs, and takes every
block past each run, so one scan serves any number of queries. What a task holds is a run, a block and a bounded number of
hits; k hits a query are sent on for each task (or more often, where a task's hits would outgrow their bound).

A query with a document meets that document's vectors only: they are multiplied with its own queries, not masked. Where
vectors are stored in buckets of the document (sources.buckets), `knn_stored` reads only the buckets that such queries name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.operators import vectorize
from askloom.sources import storage

#: Queries that meet the vectors at once, vectors in a run, vectors multiplied at once, and hits that a task holds.
QUERY_BLOCK, RUN, VECTORS_AT_ONCE, HELD = 4096, 8192, 1024, 1 << 20
#: Blocks up to this many bytes go to the tasks with the code.
SENT_BYTES = 32 << 20


# --- arrays ---------------------------------------------------------------------------------------------------------


def sizes(column) -> np.ndarray:
    """The widths of an Arrow list column; 0 for null."""
    return np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)


def matrix(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow list column -> (unit rows, which rows have this width and no null)."""
    found = sizes(column)
    ok = (found == width) & (width > 0)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(found), width))
    out[ok] = flat[np.repeat(ok, found)].reshape(-1, width)
    rows, finite = unit(out)
    return rows, ok & finite


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length 1, which are finite); rows of zeros stay."""
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None], np.isfinite(norm)


Hits = tuple[np.ndarray, np.ndarray, np.ndarray]


def best(hits: Hits, k: int) -> Hits:
    """The k best of (query, score, key) for each query; ties go to the smaller key."""
    order = np.lexsort((hits[2], -hits[1], hits[0]))
    query = hits[0][order]
    head = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, bool)
    place = np.arange(len(query)) - np.maximum.accumulate(np.where(head, np.arange(len(query)), 0)) if len(query) else query
    order = order[place < k]
    return tuple(h[order] for h in hits)


def batch_types(schema: T.StructType) -> list:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


# --- blocks of queries ----------------------------------------------------------------------------------------------


@dataclass
class Block:
    """Queries of one width: ids, unit rows, which have no document, and the places of those of each document."""

    ids: list
    rows: np.ndarray
    free: np.ndarray = field(init=False)
    of: dict[str, np.ndarray] = field(init=False)
    documents: list

    def __post_init__(self) -> None:
        self.free = np.array([k for k, d in enumerate(self.documents) if d is None], np.int64)
        named: dict[str, list[int]] = {}
        for k, d in enumerate(self.documents):
            if d is not None:
                named.setdefault(d, []).append(k)
        self.of = {d: np.array(k) for d, k in named.items()}


def block_of(table) -> Block:
    """An Arrow table (question_id, document_id, embedding of one width) as a block."""
    vectors = table.column("embedding").combine_chunks()
    vectors = vectors.chunk(0) if hasattr(vectors, "chunk") else vectors
    width = int(sizes(vectors)[0]) if len(vectors) else 0
    return Block(table.column("question_id").to_pylist(), matrix(vectors, width)[0], table.column("document_id").to_pylist())


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> Callable[[], Iterator[tuple[object, Block]]]:
    """queries(question_id, document_id or null, embedding) -> a function for tasks: (name, block) of all blocks, one at a
    time. Null and empty vectors are left out."""
    spark = queries.sparkSession
    document = F.col("document_id").cast("string") if "document_id" in queries.columns else F.lit(None).cast("string")
    rows = queries.select("question_id", document.alias("document_id"), "embedding", F.size("embedding").alias("width")).filter("width > 0")
    head = rows.limit(size + 1).toArrow()
    if head.num_rows <= size and head.nbytes <= SENT_BYTES:
        widths = head.column("width").to_numpy()
        held = spark.sparkContext.broadcast([(int(w), block_of(head.filter(widths == w))) for w in np.unique(widths)])
        return lambda: iter(held.value)
    kept = storage.materialize(rows, "queries")
    blocks = max(1, -(-kept.count() // size))
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("question_id"), F.lit(blocks)).cast("int"))
    path = storage.work_folder(spark, "blocks")
    dealt.repartition(blocks, "block").sortWithinPartitions("width", "block", "question_id").write.partitionBy("width", "block").parquet(path)
    found = spark.read.parquet(path).select("width", "block").distinct().collect()  # one row a block
    names = sorted(f"{path}/width={r['width']}/block={r['block']}" for r in found)

    def load():
        import pyarrow.parquet as pq
        from pyarrow import fs

        for name in names:
            system, place = fs.FileSystem.from_uri(name)
            yield name, block_of(pq.read_table(place, filesystem=system, partitioning=None))

    return load


# --- the join -------------------------------------------------------------------------------------------------------


class Collector:
    """The k best hits of each query of each block that a task has seen."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, 0
        self.kept: dict[object, tuple[list, Hits]] = {}
        self.bars: dict[object, np.ndarray] = {}

    def bar(self, name: object, n: int) -> np.ndarray:
        if name not in self.bars:
            self.bars[name] = np.full(n, -np.inf)
            self.held += n
        return self.bars[name]

    def add(self, name: object, ids: list, new: Hits) -> None:
        old = self.kept.get(name)
        joined = best(new if old is None else tuple(np.concatenate(z) for z in zip(old[1], new, strict=True)), self.k)
        self.held += len(joined[0]) - (len(old[1][0]) if old else 0)
        self.kept[name] = ids, joined

    def drain(self, schema: T.StructType):
        import pyarrow as pa

        kinds = batch_types(schema)
        for ids, (query, score, key) in self.kept.values():
            if len(query):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in query], kinds[0]), pa.array(key.tolist(), kinds[1]), pa.array(score)], names=schema.names)
        self.kept.clear()
        self.bars.clear()
        self.held = 0


def multiply(block: Block, name: object, x: np.ndarray, keys: np.ndarray, documents: dict[str, np.ndarray], seen: Collector) -> None:
    """A block against some vectors: queries without a document meet all, the others those of their document."""
    bar = seen.bar(name, len(block.ids))

    def meet(places: np.ndarray, rows: np.ndarray | slice) -> None:
        scores = np.round(block.rows[places] @ x[rows].T, 6)
        low = bar[places]
        if scores.shape[1] >= seen.k:
            low = np.maximum(low, np.partition(scores, -seen.k, axis=1)[:, -seen.k])
            bar[places] = low
        a, b = np.nonzero((scores >= low[:, None]) & np.isfinite(scores))
        if len(a):
            seen.add(name, block.ids, (places[a], scores[a, b], keys[rows][b]))

    if len(block.free):
        for at in range(0, len(x), VECTORS_AT_ONCE):
            meet(block.free, slice(at, at + VECTORS_AT_ONCE))
    for document in block.of.keys() & documents.keys():
        rows = documents[document]
        for at in range(0, len(rows), VECTORS_AT_ONCE):
            meet(block.of[document], rows[at : at + VECTORS_AT_ONCE])


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", document: str | None = None, block: int = QUERY_BLOCK, model: Callable | None = None, text: str = "embed_text") -> DataFrame:
    """Exact cosine top-k: (question_id, key, score, distance, rank) for queries(question_id, document_id or null, embedding).

    A query meets the vectors of its own width, and no others. Ties go to the smaller key. With a model (see vectorize.embed)
    the vectors are made of the column `text` in the task that searches them, and do not leave it.
    """
    schema = T.StructType([T.StructField("question_id", queries.schema["question_id"].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("score", T.DoubleType())])
    slim = vectors.select(key, (F.col(document) if document else F.lit(None)).cast("string").alias("document_id"), text if model else "embedding")
    load = query_blocks(queries, block)

    def run(batches):
        seen, use = Collector(k), model() if model else None
        for batch in batches:
            for at in range(0, len(batch), RUN):
                part, by_width = batch.slice(at, RUN), {}
                made = vectorize.vectors_of(use, [t or "" for t in part.column(2).to_pylist()]) if use else None
                for name, some in load():
                    width = some.rows.shape[1]
                    if width not in by_width:
                        if use is None:
                            x, ok = matrix(part.column(2), width)
                        else:
                            x, ok = unit(made.astype(np.float64)) if made.shape[1] == width else (made, np.zeros(len(part), bool))
                        keys, documents = np.array(part.column(0).filter(ok).to_pylist()), {}
                        if some.of:
                            named = np.array([d or "" for d in part.column(1).filter(ok).to_pylist()])
                            order = np.argsort(named, kind="stable")
                            values, first = np.unique(named[order], return_index=True)
                            documents = dict(zip(values.tolist(), np.split(order, first[1:]), strict=True)) if len(order) else {}
                        by_width[width] = x[ok], keys, documents
                    x, keys, documents = by_width[width]
                    if len(x):
                        multiply(some, name, x, keys, documents, seen)
                    if seen.held > HELD:
                        yield from seen.drain(schema)
        yield from seen.drain(schema)

    return ranked(slim.mapInArrow(run, schema), k, key)


def ranked(found: DataFrame, k: int, key: str) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("distance", F.round(1 - F.col("score"), 6))


def in_documents(vectors: DataFrame, queries: DataFrame, document: str = "doc_id") -> DataFrame:
    """The vectors of the documents that some query names. Of a table in buckets (a column `bucket`) only theirs are read:
    the join is on the bucket, too, so that Spark prunes the folders when it runs."""
    from askloom.sources import buckets

    named = F.col("document_id").cast("string")
    wanted, keys = queries.filter(named != "").select(named.try_cast(vectors.schema[document].dataType).alias(document)).distinct(), [document]
    if buckets.BUCKET in vectors.columns:
        n = buckets.number_of(vectors)
        wanted, keys = wanted.withColumn(buckets.BUCKET, buckets.bucket_of(F.col(document), n)), [buckets.BUCKET, document]
    return vectors.join(wanted, keys, "left_semi")


def knn_stored(vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", document: str = "doc_id", block: int = QUERY_BLOCK) -> DataFrame:
    """knn over a stored table: queries with a document search what in_documents keeps, the others the whole table."""
    named = queries.filter("document_id IS NOT NULL")
    free = queries.filter("document_id IS NULL")
    return knn(in_documents(vectors, named, document), named, k, key, document, block).unionByName(knn(vectors, free, k, key, document, block))
