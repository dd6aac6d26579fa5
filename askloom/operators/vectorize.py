"""Feature-hashing vectors: words, neighbouring pairs and character trigrams into signed buckets, with 1 + ln(count).

`embed` runs a model over Arrow batches (the default hashes with blake2b);
`hashed_md5` is the same computation with md5 in place of blake2b, for engines without it; `term_frequencies` and `joined_md5`
have it in DataFrame operations.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions import text as tx
from askloom.schemas import DEFAULT
from askloom.sources import storage

_TOKEN = re.compile("[a-z0-9]+")
Model = Callable[[list[str]], np.ndarray]


def features(text: str, n: int = DEFAULT.ngram) -> Counter:
    words = _TOKEN.findall(text.lower())
    grams = (f"c:{p[i : i + n]}" for w in words for p in [f"^{w}$" if len(w) >= n else w] for i in range(max(1, len(p) - n + 1)))
    return Counter([*(f"w:{w}" for w in words), *(f"b:{a}_{b}" for a, b in zip(words, words[1:])), *grams])


#: Letters of words, and what they are in numbers: 1 and up, 0 for none; then the marks of a word's ends.
_LETTERS = np.array([0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A for c in range(256)])
_NUMBER = np.where(_LETTERS, np.cumsum(_LETTERS), 0)
_BEGIN, _END = int(_LETTERS.sum()) + 1, int(_LETTERS.sum()) + 2
_BASE = _END + 1
_NAMED = "".join(["", *(chr(c) for c in np.flatnonzero(_LETTERS)), "^", "$"])


def _run(sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """at[k], at[k] + 1, ... (sizes[k] of them) for each k, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(at - np.cumsum(sizes) + sizes, sizes)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


#: Features as bytes: all of them, one after the other, and how long each is.
Spelled = tuple[np.ndarray, np.ndarray]


def spelled(*pieces: tuple[np.ndarray, np.ndarray | int, np.ndarray | int], n: int) -> Spelled:
    """n features, each of which is its pieces one after the other; a piece is of some bytes, from where, and how long."""
    parts = [(source, np.broadcast_to(np.asarray(at), n), np.broadcast_to(np.asarray(size), n)) for source, at, size in pieces]
    total = np.sum([size for _, _, size in parts], axis=0, dtype=np.int64)
    place, out = np.cumsum(total) - total, np.zeros(total.sum(), np.uint8)
    for source, at, size in parts:
        out[_run(size, place)] = source[_run(size, at)]
        place = place + size
    return out, total


def _bytes(text: bytes) -> tuple[np.ndarray, int, int]:
    return np.frombuffer(text, np.uint8), 0, len(text)


class HashingModel:
    """Texts to unit vectors, a list of texts at once, in arrays: words are runs of bytes, numbered among the distinct words of
    the list; distinct pairs of neighbours are hashed once a list, distinct grams once a task (their number is bounded)."""

    #: Texts that embed() gives at once.
    batch = 256

    def __init__(self, dimension: int = DEFAULT.dimension, ngram: int = DEFAULT.ngram) -> None:
        self.dimension, self.ngram = dimension, ngram
        self.name = f"hashing-ngram-{dimension}d"
        #: Hashes of the grams that were seen, by number.
        self.gram_values, self.gram_known = np.zeros(_BASE**ngram, np.uint64), np.zeros(_BASE**ngram, bool)

    def digests(self, features: list[bytes]) -> list[bytes]:
        """The features' hashes, of 64 bits: the highest is the sign, the rest of the division by the dimension is the bucket."""
        return [hashlib.blake2b(f, digest_size=8).digest() for f in features]

    def values(self, features: list[bytes]) -> np.ndarray:
        return self.hashed((np.frombuffer(b"".join(features), np.uint8), np.array([len(f) for f in features], np.int64)))

    def hashed(self, features: Spelled) -> np.ndarray:
        whole, ends = features[0].tobytes(), np.cumsum(features[1]).tolist()
        return np.frombuffer(b"".join(self.digests([whole[a:b] for a, b in zip([0, *ends], ends)])), ">u8").astype(np.uint64)

    def values_of_grams(self, grams: np.ndarray) -> np.ndarray:
        """Hashes of grams, given by number."""
        if len(new := grams[~self.gram_known[grams]]):
            new, places = np.unique(new), _BASE ** np.arange(self.ngram - 1, -1, -1)
            digits = new[:, None] // places % _BASE
            named = [("c:" + "".join(_NAMED[d - 1] for d in row if d)).encode() for row in digits.tolist()]
            self.gram_values[new] = self.values(named)
            self.gram_known[new] = True
        return self.gram_values[grams]

    def weighted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket, weight) of all distinct features of each text."""
        import pyarrow as pa

        lower = [t.lower().encode("utf-8", "replace") for t in texts]
        raw = np.frombuffer(b"".join([b"\n", *(x for t in lower for x in (t, b"\n"))]), np.uint8)  # a line end before and after each text
        inside = _LETTERS[raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, size = edges[::2], edges[1::2] - edges[::2]
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in lower]), starts - 1, "right")
        letters = raw[inside]
        begin = np.cumsum(size) - size
        encoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(begin, len(letters)).astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
        word, names = encoded.indices.to_numpy().astype(np.int64), np.frombuffer(encoded.dictionary.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(encoded.dictionary.buffers()[1] or bytes(8), np.int64)[: len(encoded.dictionary) + 1]
        at_name, long_name, known = ends[:-1], np.diff(ends), len(encoded.dictionary) or 1
        parts = []
        # words
        key, n = _counted(owner * known + word)
        parts.append((key // known, self.hashed(spelled(_bytes(b"w:"), (names, at_name, long_name), n=len(at_name)))[key % known], n))
        # grams: of a word with marks at its ends, or of a shorter one the whole
        long = size >= self.ngram
        width = np.where(long, size + 2, self.ngram)
        at, number = np.cumsum(width) - width, np.zeros(width.sum() + self.ngram, np.int64)
        number[_run(size, at + long)] = _NUMBER[letters]
        number[at[long]], number[(at + size + 1)[long]] = _BEGIN, _END
        gram = number[: len(number) - self.ngram]
        for k in range(1, self.ngram):
            gram = gram * _BASE + number[k : k + len(gram)]
        many = np.where(long, width - self.ngram + 1, 1)
        key, n = _counted(np.repeat(owner, many) * _BASE**self.ngram + gram[_run(many, at)])
        parts.append((key // _BASE**self.ngram, self.values_of_grams(key % _BASE**self.ngram), n))
        # pairs do not cross texts
        same = owner[1:] == owner[:-1]
        pair, which = np.unique(word[:-1][same] * known + word[1:][same], return_inverse=True)
        a, b = pair // known, pair % known
        value = self.hashed(spelled(_bytes(b"b:"), (names, at_name[a], long_name[a]), _bytes(b"_"), (names, at_name[b], long_name[b]), n=len(pair)))
        key, n = _counted(owner[1:][same] * (len(pair) or 1) + which)
        parts.append((key // (len(pair) or 1), value[key % (len(pair) or 1)], n))
        text, value, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        sign = np.where(value >> np.uint64(63), 1.0, -1.0)
        return text, (value % np.uint64(self.dimension)).astype(np.int64), sign * (1.0 + np.log(n))

    def sparse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket, value) of the unit vectors, for each bucket that a feature of the text is in; a text without
        features, or of no length, has bucket 0."""
        text, bucket, weight = self.weighted(texts)
        total, there = (np.bincount(text * self.dimension + bucket, w, len(texts) * self.dimension).reshape(len(texts), self.dimension) for w in (weight, None))
        norm = np.sqrt((total * total).sum(axis=1))
        none = norm <= 1e-12
        total[none], there[none], norm[none] = 0, 0, 1
        total[none, 0] = there[none, 0] = 1
        row, at = np.nonzero(there)
        return row, at, total[row, at] / norm[row]

    def __call__(self, texts: list[str]) -> np.ndarray:
        text, bucket, weight = self.weighted(texts)
        out = np.bincount(text * self.dimension + bucket, weight, len(texts) * self.dimension).reshape(len(texts), self.dimension)
        norm = np.sqrt((out * out).sum(axis=1))
        out[norm == 0, 0] = norm[norm == 0] = 1
        return out / norm[:, None]


class Md5Model(HashingModel):
    """The same with the first half of md5 in place of blake2b, as hashed_md5 has it: for engines without blake2b."""

    def __init__(self, *args, **options) -> None:
        super().__init__(*args, **options)
        self.name += "-md5"

    def digests(self, features: list[bytes]) -> list[bytes]:
        return [hashlib.md5(f, usedforsecurity=False).digest()[:8] for f in features]

    def hashed(self, features: Spelled) -> np.ndarray:
        whole, size = features
        at, short, out = np.cumsum(size) - size, size < 56, np.zeros(len(size), np.uint64)
        kept = size[short]
        blocks, row = np.zeros((len(kept), 64), np.uint8), np.arange(len(kept)) * 64
        blocks.ravel()[_run(kept, row)] = whole if len(kept) == len(size) else whole[_run(kept, at[short])]
        blocks.ravel()[row + kept] = 0x80
        blocks[:, 56], blocks[:, 57] = kept * 8 & 255, kept * 8 >> 8
        out[short] = md5_heads(blocks.view("<u4"))
        if len(kept) < len(size):
            out[~short] = super().hashed((whole[_run(size[~short], at[~short])], size[~short]))
        return out


# Fixed values of md5: how far each step turns, and its constant.
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_SINES = [np.uint32(int(abs(math.sin(k + 1)) * 2**32)) for k in range(64)]


def md5_heads(blocks: np.ndarray, at_once: int = 8192) -> np.ndarray:
    """The first 64 bits of md5 of many texts of one block (16 words) each, in arrays: hashlib takes four times as long."""
    out = np.zeros(len(blocks), np.uint64)
    for at in range(0, len(blocks), at_once):
        m = np.ascontiguousarray(blocks[at : at + at_once].T)
        used = m.any(axis=1)
        first = [np.full(m.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        (a, b, c, d), f = (x.copy() for x in first), np.empty(m.shape[1], np.uint32)
        for k in range(64):
            if k < 16:
                g = k
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif k < 32:
                g = (5 * k + 1) % 16
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif k < 48:
                g = (3 * k + 5) % 16
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                g = 7 * k % 16
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            f += _SINES[k]
            if used[g]:
                f += m[g]
            np.left_shift(f, np.uint32(_TURNS[k]), out=a)
            f >>= np.uint32(32 - _TURNS[k])
            a |= f
            a += b
            a, d, c, b = d, c, b, a
        high, low = ((x + y).byteswap().astype(np.uint64) for x, y in zip((a, b), first, strict=False))
        out[at : at + at_once] = high << np.uint64(32) | low
    return out


def vectors_of(use: Model, texts: list[str], batch: int | None = None) -> np.ndarray:
    """The vectors of some texts, one at least, given to the model in lists of `batch` texts (see embed)."""
    size = batch or getattr(use, "batch", 32)
    return np.concatenate([np.asarray(use(texts[k : k + size]), np.float32) for k in range(0, len(texts), size)])


def embed(rows: DataFrame, column: str = "text", model: Callable[[], Model] = HashingModel, batch: int | None = None, name: str = "embedding") -> DataFrame:
    """rows with the vector of a text column. `model` makes the model, once in each task; it gets lists of `batch` texts (else
    of as many as it says itself, or 32)."""

    def run(batches: Iterator):
        import pyarrow as pa

        use = model()
        for part in batches:
            texts = [t or "" for t in part.column(part.schema.get_field_index(column)).to_pylist()]
            if texts:
                matrix = vectors_of(use, texts, batch)
                lists = pa.ListArray.from_arrays(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32), matrix.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))]))


def title_aware(text: Column, filename: Column) -> Column:
    """The text to embed: the title of the file name twice, then the chunk; the stored text stays as it is."""
    return F.concat(tx.title_context(filename), F.lit("\n\n"), text)


# --- the same in DataFrame operations -------------------------------------------------------------------------------


def term_frequencies(rows: DataFrame, key: str = "doc_id", n: int = DEFAULT.ngram) -> DataFrame:
    """(key, feature, n). Character grams are taken from each distinct word of a text, with its count."""
    tokens = rows.select(key, tx.tokens(F.col("text"), "[a-z0-9]+").alias("words"))
    words = tokens.select(key, F.explode("words").alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("n"))
    rest = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = tokens.select(key, F.explode(F.arrays_zip(F.slice("words", F.lit(1), rest).alias("a"), F.slice("words", F.lit(2), rest).alias("b"))).alias("p"))
    padded = F.when(F.length("w") >= n, F.concat(F.lit("^"), F.col("w"), F.lit("$"))).otherwise(F.col("w"))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("p") - (n - 1)))
    grams = words.select(key, padded.alias("p"), "n").select(key, "p", "n", F.explode(places).alias("i"))
    every = (
        words.select(key, F.concat(F.lit("w:"), F.col("w")).alias("feature"), "n")
        .union(pairs.select(key, F.concat(F.lit("b:"), F.col("p.a"), F.lit("_"), F.col("p.b")), F.lit(1).cast("long")))
        .union(grams.select(key, F.concat(F.lit("c:"), F.substring(F.col("p"), F.col("i"), F.lit(n))), "n"))
    )
    return every.groupBy(key, "feature").agg(F.sum("n").alias("n"))


def hashed_md5(rows: DataFrame, key: str = "doc_id", dimension: int = DEFAULT.dimension) -> DataFrame:
    """rows(key, text) -> sparse unit vectors (key, bucket, value); texts without a feature have bucket 0.

    A key's rows are one text whose pairs do not cross rows. Where a key has one row, its features are counted in the task
    that has the row; only those of keys with several rows are shuffled."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull()).select(key)
    several = storage.materialize(counts, "repeated_keys")
    again = rows.withColumnRenamed(key, "_key").join(several, F.col("_key").eqNullSafe(several[key]), "left_semi").withColumnRenamed("_key", key)
    once = rows.filter(F.col(key).isNotNull()).join(several, key, "left_anti")
    return sparse_vectors(once, lambda: Md5Model(dimension), key).union(joined_md5(again, key, dimension))


def sparse_vectors(rows: DataFrame, model: Callable[[], HashingModel] = HashingModel, key: str = "doc_id", batch: int = 32) -> DataFrame:
    """rows(key, text) -> (key, bucket, value) of each row."""

    def run(batches: Iterator):
        import pyarrow as pa

        use = model()
        for part in batches:
            texts = [t or "" for t in part.column(1).to_pylist()]
            for k in range(0, len(texts), batch):
                row, bucket, value = use.sparse(texts[k : k + batch])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row + k)), pa.array(bucket.astype(np.int32)), pa.array(value)], names=[key, "bucket", "value"])

    return rows.select(key, "text").mapInArrow(run, T.StructType([rows.schema[key], T.StructField("bucket", T.IntegerType()), T.StructField("value", T.DoubleType())]))


def joined_md5(rows: DataFrame, key: str = "doc_id", dimension: int = DEFAULT.dimension) -> DataFrame:
    """hashed_md5 by shuffles of all features, for keys with any number of rows."""
    digest = F.md5(F.col("feature").cast("binary"))
    value = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    sign = F.when(F.substring(digest, 1, 1) >= "8", 1.0).otherwise(-1.0)
    weighted = term_frequencies(rows, key).select(key, (value % dimension).cast("int").alias("bucket"), (sign * (1 + F.ln("n"))).alias("w"))
    # a weightless row stands for each text, so that one without features is not lost
    marks = rows.select(key, F.lit(-1).alias("bucket"), F.lit(0.0).alias("w"))
    sums = weighted.union(marks).groupBy(key, "bucket").agg(F.sum("w").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    scaled = sums.withColumn("norm", norm).filter((F.col("bucket") >= 0) == (F.col("norm") > 1e-12))
    return scaled.select(key, F.greatest(F.lit(0), F.col("bucket")).alias("bucket"), F.when(F.col("bucket") < 0, 1.0).otherwise(F.col("w") / F.col("norm")).alias("value"))


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.transform(vector, lambda v: v.cast("double") / F.when(norm > 0, norm).otherwise(F.lit(1.0)))
