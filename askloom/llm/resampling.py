"""Operator 13: importance resampling of documents towards a target distribution, by bit-sliced aggregation.

A document is a bag of hashed features: runs of 1 to `width` words, each in the bucket of its CRC-32. A bucket's gain is its
log ratio of target to corpus, in thousandths and whole numbers. A document's weight is the mean gain of its features,
rounded down. It is summed in bit slices: the documents' bucket counts become planes of one bit a bucket (plane j holds the
bits of 2^j), the gains become planes by sign and bit; each pair of planes is ANDed, its ones are counted, and the
counts are added times powers of two. The sums are exact, whatever the counts.

Gumbel noise from a hash of the id makes the highest scores a draw without replacement in proportion to exp(weight / 1000).
Ranks are places in the order of all scores: the number of higher scores, from a histogram of the scores taken in two levels,
and the place among equal ones, so no task sorts all rows. Bags are written once; texts are read once and not shuffled.

Sizes: gains are one row a bucket (a parameter, 10000) and go to tasks with the code. A score's noise lies between
-3,100 and 22,900 and its weight within 1000 times the log of the number of features, so there are at most some hundred thousand distinct scores.

Defined results: a null or empty text has no features and weight 0; a text of any length is one bag; documents of fewer than
min_words words get a score and no rank; a null doc_id hashes as an empty one and comes last among equal scores; repeated rows
each get their own rank; other columns are left out; an empty target gives gains from the corpus alone; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.llm import _words
from askloom.llm._shared import materialize, release

BUCKETS, WIDTH, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Documents whose planes are in memory at once, and scores in a coarse step of the histogram.
AT_ONCE, STEP = 256, 64

BAG = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()),
    T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType())),
])


def bags_of(texts, width: int = WIDTH, buckets: int = BUCKETS) -> tuple[np.ndarray, ...]:
    """A pyarrow string array -> (words, features, offsets of the bags, their buckets, their counts)."""
    raw, offsets = _words.flat(texts)
    raw = _words.LOWER[raw]
    starts, ends, first = _words.spans(raw, offsets, _words.ALNUM)
    words = np.diff(first)
    owner = np.repeat(np.arange(len(words)), words)
    space = np.array([32], np.uint8)
    code, keys = None, []
    for k in range(width):
        at = np.arange(len(starts) - k) if len(starts) > k else np.zeros(0, np.int64)
        if k == 0:
            code = _words.crc32(raw, starts, ends)
        else:  # runs of k words and one more, after a space
            joined = _words.crc32(space, np.zeros(len(at), np.int64), np.ones(len(at), np.int64), code[: len(at)])
            code = _words.crc32(raw, starts[k:], ends[k:], joined)
        inside = owner[at] == owner[at + k] if len(at) else np.zeros(0, bool)
        keys.append(owner[at][inside] * buckets + code[inside].astype(np.int64) % buckets)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    doc = key // buckets
    features = np.bincount(doc, weights=count, minlength=len(words)).astype(np.int64) if len(doc) else np.zeros(len(words), np.int64)
    return words, features, np.searchsorted(doc, np.arange(len(words) + 1)), (key % buckets).astype(np.int32), count.astype(np.int64)


def bag_column(width: int = WIDTH, buckets: int = BUCKETS):
    """A column function: texts to their bags."""

    @F.arrow_udf(BAG)
    def bag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from askloom.llm.token_store import batches_of

        kind = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
        for texts in batches:
            parts = [pa.array([], kind)]
            for a, b in batches_of(texts):
                words, features, cuts, where, count = bags_of(texts.slice(a, b - a), width, buckets)
                lists = (pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x)) for x in (where, count))
                parts.append(pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(features), *lists], fields=list(kind)))
            yield pa.concat_arrays(parts)

    return bag.asNondeterministic()  # evaluated once, where several of its fields are used


def bags(docs: DataFrame, keep: list[str], width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """docs(text, keep...) -> keep..., n_words, n_features, buckets, counts."""
    kept = [F.col(f"`{c}`") for c in keep]
    return docs.select(*kept, bag_column(width, buckets)(F.col("text")).alias("_bag")).select(*kept, "_bag.*")


def totals(bag_rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all bags in each bucket. One row a bucket reaches the driver."""
    pairs = bag_rows.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p")).select("p.buckets", "p.counts")
    out = np.zeros(buckets, np.int64)
    for r in pairs.groupBy("buckets").agg(F.sum("counts").alias("n")).collect():
        out[r["buckets"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket: floor(1000 * ln of its smoothed share in the target over that in the corpus)."""
    s, t, b = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def planes_of(rows: np.ndarray, places: np.ndarray, n: int, bits: int) -> np.ndarray:
    """n rows of `bits` bits, with ones at (rows, places), as 64-bit words."""
    flags = np.zeros((n, -(-bits // 64) * 64), bool)
    flags[rows, places] = True
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def signed_planes(gains: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(sign, bit, plane) of each bit that some gain of this sign has."""
    out = []
    for sign in (1, -1):
        size = np.maximum(sign * gains, 0)
        for bit in range(int(size.max(initial=0)).bit_length()):
            place = np.flatnonzero(size >> bit & 1)
            if len(place):
                out.append((sign, bit, planes_of(np.zeros(len(place), np.int64), place, 1, len(gains))[0]))
    return out


def sliced_sums(cuts: np.ndarray, where: np.ndarray, counts: np.ndarray, planes: list[tuple[int, int, np.ndarray]], buckets: int) -> np.ndarray:
    """The sum of count times gain of each bag, from bit planes. cuts: offsets of the bags in `where` and `counts`."""
    n = len(cuts) - 1
    out, doc = np.zeros(n, np.int64), np.repeat(np.arange(n), np.diff(cuts))
    for a in range(0, n, AT_ONCE):
        span = slice(cuts[a], cuts[min(a + AT_ONCE, n)])
        rows, place, left, j = doc[span], where[span], counts[span], 0
        while len(left):
            odd = (left & 1).astype(bool)
            here, row = np.unique(rows[odd], return_inverse=True)
            if len(here):
                slices = planes_of(row, place[odd], len(here), buckets)
                for sign, bit, plane in planes:
                    out[here] += sign * (np.bitwise_count(slices & plane).sum(axis=1, dtype=np.int64) << (bit + j))
            left, j = left >> 1, j + 1
            live = left > 0
            rows, place, left = rows[live], place[live], left[live]
    return out


def weight_column(gains: np.ndarray):
    """A column function: (features, buckets, counts) of bags to the floored means of their gains."""
    planes, buckets = signed_planes(gains), len(gains)

    @F.arrow_udf(T.LongType())
    def weight(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for features, where, counts in batches:
            n = features.to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = where.offsets.to_numpy().astype(np.int64)
            total = sliced_sums(cuts - cuts[0], where.flatten().to_numpy(), counts.flatten().to_numpy(), planes, buckets)
            yield pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))

    return weight


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from 32 bits of a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weights(docs: DataFrame, target: DataFrame, width: int = WIDTH, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text), target(text) -> doc_id, n_words, n_features, weight, score, as a written table."""
    held = materialize(bags(docs, ["doc_id"], width, buckets), "bags")
    gains = gains_of(totals(held, buckets), totals(bags(target.select("text"), [], width, buckets), buckets))
    weighed = held.withColumn("weight", weight_column(gains)("n_features", "buckets", "counts"))
    out = materialize(weighed.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")), "weights")
    release(held)
    return out


def ranked(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scored(doc_id, n_words, n_features, score, ...), a written table -> the same rows with a rank for those drawn."""
    steps = scored.filter(F.col("n_words") >= min_words).groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.floor(F.col("score") / STEP))
    coarse = steps.groupBy("step").agg(F.sum("n").alias("in_step"))  # a row for STEP scores
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    higher = coarse.withColumn("above", F.coalesce(F.sum("in_step").over(above), F.lit(0)))
    within = Window.partitionBy("step").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    places = steps.join(higher.select("step", "above"), "step").select("score", (F.col("above") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before"))
    places = materialize(places, "places")
    most = scored.filter(F.col("n_words") >= min_words).count() * percent // 100
    cut = places.filter(F.col("before") < most).agg(F.min("score")).first()[0]
    drawn = (F.col("n_words") >= min_words) & (F.col("score") >= F.lit(cut)) if cut is not None else F.lit(False)
    tied = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features")
    rank = F.col("before") + F.row_number().over(tied)
    names = [F.col(f"`{c}`") for c in scored.columns]
    high = scored.filter(drawn).join(places, "score").select(*names, F.when(rank <= most, rank).cast("long").alias("rank"))
    return high.unionByName(scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, width: int = WIDTH, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text), target(text) -> doc_id, n_words, n_features, weight, score, rank: all documents, with a rank for
    the percentage drawn of those with min_words words."""
    return ranked(weights(docs, target, width, buckets, seed), percent, min_words)


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents that are drawn, with all their columns. Rows that share a doc_id are drawn together."""
    ids = resample(docs, target, **options).filter("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi")
