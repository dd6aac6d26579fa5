"""Operator 11: ranked lexical search by impact vectors in norm buckets.

A document's impact vector has, for each term that some item asks for, a whole number that grows with the term's occurrences
and shrinks with the document's words; an item's vector has the terms' weights. The score is their product. Texts are read
once, into counts of the items' terms; document frequencies follow from the counts. Impact vectors are then written with
their lengths (each impact times its term's weight).

A task searches its vectors a run at a time, longest first, in buckets of BUCKET vectors. Of an item's best k scores so
far, the least is its bar. By Cauchy-Schwarz no vector shorter than the bar over the item's own length reaches it: the rest
of the run is left out. The largest impact of each term in a bucket bounds what an item can get there. Inside a bucket the
item's heaviest terms (FOCUS of them) are added up exactly, and the rest is bounded by lengths and by largest impacts, whichever is
less. What survives is scored exactly in 64-bit integers. The globally longest vectors are searched first, so that all
tasks begin with their bars; bars only ever leave out what can't be among the best k.

Items are dealt into blocks of about BLOCK_WORDS words, built by tasks and written to the shared folder; for each block the
driver holds its name, one count a term and one bar an item (some MB). A task sends k rows an item. Terms are looked up by
hash and compared in full.

Defined results: a null or empty text has no terms, isn't counted and is never found; a very long text is a run of its own;
an item without terms finds nothing; rows with equal item_id and text are one item, others are items of their own, even if
they share an id; equal scores are ordered by doc_id, nulls last; repeated documents are found as often as they occur; other
columns are left out; empty tables give an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.llm import _words
from askloom.llm._shared import materialize, new_folder, release
from askloom.llm._store import locate, publish

TOP, BLOCK_WORDS = 10, 400_000
#: Vectors in a bucket and in a run of a task, entries of a run, terms that are added up exactly, and vectors that are to be searched first.
BUCKET, RUN, RUN_ENTRIES, FOCUS, FIRST = 1024, 8192, 2_000_000, 32, 4096
#: Bounds are doubles: they are raised by more than their error.
SLACK = 1 + 1e-9

COUNTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])
VECTORS = T.StructType([T.StructField("length", T.DoubleType()), T.StructField("impacts", T.ArrayType(T.LongType()))])


def tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased, starts and ends of the terms, and where each text's terms begin."""
    raw, offsets = _words.flat(texts)
    raw = _words.LOWER[raw]
    return raw, *_words.spans(raw, offsets, _words.ALNUM)


class Items:
    """A block of items: their ids, the terms they ask for, and for each item its terms and how often it names them."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.raw, starts, ends, first = tokens(pa.array([t for _, t in items], pa.string()))
        code = _words.hashes(self.raw, starts, ends)
        self.codes, sample, number = np.unique(code, return_index=True, return_inverse=True)
        self.starts, self.ends = starts[sample], ends[sample]
        if not _words.same(self.raw, starts, ends, self.raw, self.starts[number], self.ends[number]).all():
            raise ValueError("two terms of the items share a 64-bit hash")
        self.ids, self.terms, self.times = [i for i, _ in items], [], []
        for a, b in zip(first[:-1], first[1:], strict=True):
            terms, times = np.unique(number[a:b], return_counts=True)
            self.terms.append(terms)
            self.times.append(times.astype(np.int64))

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word's term, or -1."""
        if not len(self.codes):
            return np.full(len(starts), -1)
        code = _words.hashes(raw, starts, ends)
        near = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = np.flatnonzero(self.codes[near] == code)
        hit = hit[_words.same(raw, starts[hit], ends[hit], self.raw, self.starts[near[hit]], self.ends[near[hit]])]
        out = np.full(len(starts), -1)
        out[hit] = near[hit]
        return out


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> list[str]:
    """Blocks of items(item_id, text) as files in the shared folder, each built by a task; their names."""
    folder = new_folder(items.sparkSession, "items")
    known = items.select("item_id", "text").filter("text IS NOT NULL").distinct()
    words = known.agg(F.sum(F.floor(F.octet_length("text") / 2) + 1)).first()[0] or 0
    count = max(1, -(-int(words) // block_words))
    dealt = known.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)).cast("int"))

    def build(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for block, item, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held.setdefault(block, []).append((item, text))
        for block, rows in held.items():
            name = f"{folder}/block-{block}"
            with publish(name) as out:
                out.write(pickle.dumps(Items(rows)))
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    rows = dealt.select("block", "item_id", "text").repartition(count, "block").sortWithinPartitions("block", "item_id", "text")
    return sorted({r["name"] for r in rows.mapInArrow(build, "name string").collect()})


@lru_cache(maxsize=1)
def load(name: str) -> Items:
    system, path = locate(name)
    with system.open_input_file(path) as source:
        return pickle.loads(source.read())


def count_column(name: str):
    """A column function: texts to their number of terms, and their counts of the terms of a block."""

    @F.arrow_udf(COUNTS)
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from askloom.llm.token_store import batches_of

        block, kind = load(name), pa.struct([("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
        for texts in batches:
            parts = [pa.array([], kind)]
            for a, b in batches_of(texts):
                raw, starts, ends, first = tokens(texts.slice(a, b - a))
                term = block.find(raw, starts, ends)
                doc = np.repeat(np.arange(b - a), np.diff(first))[term >= 0]
                key, tf = np.unique(doc * len(block.codes) + term[term >= 0], return_counts=True)
                cuts = np.searchsorted(key, np.arange(b - a + 1) * len(block.codes))
                lists = (pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), x) for x in (pa.array(key % max(len(block.codes), 1), pa.int32()), pa.array(tf, pa.int64())))
                parts.append(pa.StructArray.from_arrays([pa.array(np.diff(first), pa.int64()), *lists], fields=list(kind)))
            yield pa.concat_arrays(parts)

    return counts.asNondeterministic()  # evaluated once, where several of its fields are used


def vector_column(weights: np.ndarray, documents: int, words: int):
    """A column function: (n, terms, tfs) to the length and the impacts of the vector."""

    @F.arrow_udf(VECTORS)
    def vectors(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for size, terms, tfs in batches:
            n, tf = size.to_numpy(zero_copy_only=False).astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
            cuts = terms.offsets.to_numpy().astype(np.int64)
            cuts -= cuts[0]
            m = np.repeat(100 - 75 + 75 * n * documents // max(words, 1), np.diff(cuts))
            impact = 1_000_000_000 * tf // np.maximum(1000 * tf + 8 * m, 1)
            heavy = (impact * weights[terms.flatten().to_numpy()]).astype(np.float64) ** 2
            total = np.zeros(len(n))
            some = np.diff(cuts) > 0
            if some.any():
                total[some] = np.add.reduceat(heavy, cuts[:-1][some])
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(impact))
            yield pa.StructArray.from_arrays([pa.array(np.sqrt(total)), lists], names=["length", "impacts"])

    return vectors


class Bucket:
    """Vectors of near lengths, longest first: by row, and by term."""

    def __init__(self, length: np.ndarray, cuts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, weights: np.ndarray) -> None:
        self.length, self.cuts, self.terms, self.impacts = length, cuts, terms, impacts
        order = np.argsort(terms, kind="stable")
        self.by_term, self.rows = terms[order], np.repeat(np.arange(len(length)), np.diff(cuts))[order]
        self.heavy = (impacts[order] * weights[self.by_term]).astype(np.float64)
        self.most = np.zeros(len(weights))  # the largest weighted impact of each term
        np.maximum.at(self.most, self.by_term, self.heavy)

    def survivors(self, terms: np.ndarray, times: np.ndarray, live: int, bar: float) -> np.ndarray:
        """Which of the first `live` vectors may reach the bar."""
        gain = times * self.most[terms]
        order = np.argsort(-gain, kind="stable")
        focus, rest = order[:FOCUS], order[FOCUS:]
        lo, hi = np.searchsorted(self.by_term, terms[focus]), np.searchsorted(self.by_term, terms[focus], side="right")
        got, used = np.zeros(live), np.zeros(live)
        for a, b, t in zip(lo, hi, times[focus], strict=True):
            row, heavy = self.rows[a:b], self.heavy[a:b]
            inside = row < live
            got[row[inside]] += t * heavy[inside]
            used[row[inside]] += heavy[inside] ** 2
        by_length = np.sqrt(float((times[rest] ** 2).sum())) * np.sqrt(np.maximum(self.length[:live] ** 2 * SLACK - used, 0))
        return np.flatnonzero((got + np.minimum(by_length, gain[rest].sum())) * SLACK >= bar)

    def scores(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """The exact scores of some rows; dense: the item's weight of each term."""
        size = self.cuts[rows + 1] - self.cuts[rows]
        at = np.repeat(self.cuts[rows] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        total = np.concatenate([[0], np.cumsum(self.impacts[at] * dense[self.terms[at]])])
        ends = np.cumsum(size)
        return total[ends] - total[ends - size]


class Searcher:
    """The best k documents of each item of a block, of the vectors that a task has seen."""

    def __init__(self, block: Items, weights: np.ndarray, bars: np.ndarray, k: int) -> None:
        self.block, self.weights, self.k, self.bars = block, weights, k, bars.copy()
        self.best: list[list[tuple]] = [[] for _ in block.ids]
        self.norms = np.array([np.sqrt(float((t * t).sum())) for t in block.times])
        self.dense = np.zeros(len(weights), np.int64)
        self.some = np.flatnonzero([len(t) > 0 for t in block.terms])
        self.flat = np.concatenate([block.terms[i] for i in self.some]) if len(self.some) else np.zeros(0, np.int64)
        self.flat_times = np.concatenate([block.times[i] for i in self.some]) if len(self.some) else np.zeros(0, np.int64)
        self.heads = np.cumsum([0, *(len(block.terms[i]) for i in self.some[:-1])]) if len(self.some) else np.zeros(0, np.int64)
        self.scored = 0

    def run(self, ids: list, length: np.ndarray, cuts: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> None:
        """Searches a run of vectors, in buckets from the longest on."""
        if not len(self.some):
            return
        place = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        later = np.empty(len(ids), np.int64)
        later[place] = np.arange(len(ids))  # among equal scores the smaller id is first
        order = np.argsort(-length, kind="stable")
        for a in range(0, len(order), BUCKET):
            rows = order[a : a + BUCKET]
            live = self.some[self.norms[self.some] * length[rows[0]] * SLACK >= self.bars[self.some]]
            if not len(live):
                return
            size = cuts[rows + 1] - cuts[rows]
            at = np.repeat(cuts[rows] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            bucket = Bucket(length[rows], np.concatenate([[0], np.cumsum(size)]), terms[at], impacts[at], self.weights)
            most = np.zeros(len(self.norms))
            most[self.some] = np.add.reduceat(self.flat_times * bucket.most[self.flat], self.heads)
            for i in live[most[live] * SLACK >= self.bars[live]]:
                self._search(i, bucket, rows, ids, later)

    def _search(self, i: int, bucket: Bucket, rows: np.ndarray, ids: list, later: np.ndarray) -> None:
        terms, times, bar = self.block.terms[i], self.block.times[i], self.bars[i]
        live = int(np.searchsorted(-bucket.length, -(bar / (self.norms[i] * SLACK)), side="right"))
        found = bucket.survivors(terms, times, live, bar)
        if not len(found):
            return
        self.scored += len(found)
        self.dense[terms] = times * self.weights[terms]
        score = bucket.scores(found, self.dense)
        self.dense[terms] = 0
        good = score >= bar
        found, score = rows[found[good]], score[good]
        first = np.lexsort((later[found], -score))[: self.k]
        best = self.best[i]
        best.extend((int(score[j]), ids[found[j]]) for j in first)
        best.sort(key=lambda hit: (-hit[0], hit[1] is None, hit[1] if hit[1] is not None else 0))
        del best[self.k :]
        if len(best) == self.k:
            self.bars[i] = max(bar, best[-1][0])


def search_part(vectors: DataFrame, name: str, weights: np.ndarray, bars: np.ndarray, k: int, item_type: T.DataType) -> DataFrame:
    """vectors(doc_id, length, terms, impacts) -> item (its number in the block), item_id, doc_id, score: k rows an item and task at most."""
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_type), T.StructField("doc_id", vectors.schema["doc_id"].dataType), T.StructField("score", T.LongType())])

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        block = load(name)
        seen, held, rows, entries = Searcher(block, weights, bars, k), [], 0, 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cuts = table.column(2).offsets.to_numpy().astype(np.int64)
            seen.run(table.column(0).to_pylist(), table.column(1).to_numpy(), cuts - cuts[0], table.column(2).flatten().to_numpy().astype(np.int64), table.column(3).flatten().to_numpy())
            held.clear()

        for batch in batches:
            for a in range(0, len(batch), BUCKET):
                part = batch.slice(a, BUCKET)
                held.append(part)
                rows, entries = rows + len(part), entries + len(part.column(2).flatten())
                if rows >= RUN or entries >= RUN_ENTRIES:
                    flush()
                    rows = entries = 0
        if held:
            flush()
        hits = [(i, block.ids[i], doc, score) for i, best in enumerate(seen.best) for score, doc in best]
        if hits:
            kinds = [to_arrow_type(f.dataType) for f in schema]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*hits, strict=True), kinds, strict=True)], names=schema.names)

    return vectors.select("doc_id", "length", "terms", "impacts").mapInArrow(work, schema)


def best_of(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each item, with their ranks."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, name: str, k: int, item_type: T.DataType) -> DataFrame:
    """docs(doc_id, text) against the items of one block."""
    counted = materialize(docs.select("doc_id", count_column(name)(F.col("text")).alias("c")).select("doc_id", "c.*").filter("n > 0"), "counts")
    documents, words = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    block = load(name)
    df = np.zeros(len(block.codes), np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # a row a term of the block
        df[r["term"]] = r["df"]
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    made = counted.filter(F.size("terms") > 0).withColumn("v", vector_column(weights, documents, words)("n", "terms", "tfs"))
    vectors = materialize(made.select("doc_id", "terms", "v.*").filter("length > 0"), "impacts")
    release(counted)
    # lengths in quarter octaves: a few hundred rows
    octave = F.floor(4 * F.log2("length"))
    left, cut = FIRST, None
    for r in vectors.groupBy(octave.alias("octave")).count().orderBy(F.desc("octave")).collect():
        left, cut = left - r["count"], r["octave"]
        if left <= 0:
            break
    bars = np.ones(len(block.ids))
    if cut is None:
        return search_part(vectors, name, weights, bars, k, item_type).withColumn("rank", F.lit(0))
    first = materialize(best_of(search_part(vectors.filter(octave >= cut), name, weights, bars, k, item_type), k), "first_hits")
    for r in first.filter(F.col("rank") == k).select("item", "score").collect():  # a row an item of the block
        bars[r["item"]] = r["score"]
    rest = search_part(vectors.filter(octave < cut), name, weights, bars, k, item_type)
    return best_of(first.drop("rank").unionByName(rest), k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> item_id, rank, doc_id, score: the k best documents of each item."""
    kind, found = items.schema["item_id"].dataType, None
    for name in item_blocks(items, block_words):
        part = materialize(search_block(docs, name, k, kind).select("item_id", "rank", "doc_id", "score"), "hits")
        found = part if found is None else found.unionByName(part)
    if found is None:
        empty = docs.filter(F.lit(False)).select(F.lit(None).cast(kind).alias("item_id"), F.lit(None).cast("int").alias("rank"), "doc_id", F.lit(None).cast("long").alias("score"))
        return empty
    return found
