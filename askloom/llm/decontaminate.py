"""Operator 7: benchmark decontamination by suffix arrays of the training texts.

A task turns its documents, SHARD_BYTES at a time (a shard), into word numbers of the benchmark's vocabulary and sorts all
their suffixes that begin with such a word into a suffix array, to the depth of a window, in packed words of 64 bits.
Every benchmark suffix of at least a window is then found by binary search: its range in the array is all places where the
window occurs. Occurrences that follow one another in item and document join into the longest verbatim matches, with their
places. Word hashes of 64 bits stand for words in the array; a match is confirmed on the words' bytes.

The benchmark is dealt into blocks of about BLOCK_WORDS words, which tasks build and write to the shared folder (about 200
MB at most); the driver gets their names only. A task holds one block at a time; where there are several it takes
SEVERAL_BYTES of documents past each in turn. Texts are not shuffled, and only texts go to Python.

Defined results: null or empty texts have no words and no match; a very long text is a shard of its own; an item of fewer
words than a window is one window; items without words match nothing; an item without an id is searched for and reported
as a match without an id; repeated rows each get their result; other columns stay as they are, whatever their names; empty
tables give empty or clean results.
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.llm import _words
from askloom.llm._shared import new_folder
from askloom.llm._store import locate, publish

WINDOW, BLOCK_WORDS, SHARD_BYTES, SEVERAL_BYTES = 10, 2_000_000, 2 << 20, 32 << 20

MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_from", T.IntegerType()), T.StructField("doc_from", T.IntegerType()), T.StructField("words", T.IntegerType())]))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("matches", MATCH)])


def tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the words, and where each text's words begin."""
    raw, offsets = _words.flat(texts)
    raw = _words.LOWER[raw]
    return raw, *_words.spans(raw, offsets, _words.ALNUM)


class Block:
    """The windows of some benchmark items, sorted as suffixes, in packed word numbers."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        raw, starts, ends, first = tokens(pa.array([t for _, t in items], pa.string()))
        code = _words.hashes(raw, starts, ends)
        self.ids = [i for i, _ in items]
        self.vocabulary, number = np.unique(code, return_inverse=True)
        self.spelling = {int(c): raw[a:b].tobytes() for c, a, b in zip(code, starts, ends, strict=True)}
        bits = max(1, int(len(self.vocabulary)).bit_length())
        self.window, self.bits, self.per_key = window, bits, max(1, 63 // bits)
        self.keys = -(-window // self.per_key)
        self.item, self.at, self.width = [], [], []
        for k in range(len(items)):
            n = int(first[k + 1] - first[k])
            w = min(n, window)
            for j in range(n - w + 1 if n else 0):
                self.item.append(k), self.at.append(j), self.width.append(w)
        self.item, self.at, self.width = (np.array(x, np.int64) for x in (self.item, self.at, self.width))
        place = first[self.item] + self.at if len(self.item) else np.zeros(0, np.int64)
        padded = np.concatenate([number + 1, np.zeros(window, np.int64)]).astype(np.int64)
        low = np.zeros((len(place), self.keys * self.per_key), np.int64)
        for t in range(window):
            low[:, t] = np.where(t < self.width, padded[place + t], 0)
        high = low.copy()
        for t in range(window):
            high[:, t] = np.where(t < self.width, low[:, t], (1 << bits) - 1)
        self.low, self.high = self._pack(low), self._pack(high)
        self.words = padded[place[:, None] + np.arange(window)] * (np.arange(window) < self.width[:, None])

    def _pack(self, rows: np.ndarray) -> list[np.ndarray]:
        out = []
        for k in range(self.keys):
            key = np.zeros(len(rows), np.int64)
            for t in range(self.per_key):
                key = (key << self.bits) | rows[:, k * self.per_key + t]
            out.append(key)
        return out


def suffix_array(numbers: np.ndarray, block: Block) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places in `numbers` (0: not a benchmark word) whose suffixes begin with a benchmark word, in order, and their keys."""
    padded = np.concatenate([numbers, np.zeros(block.keys * block.per_key, np.int64)])
    place = np.flatnonzero(numbers)
    keys = []
    for k in range(block.keys):
        key = np.zeros(len(place), np.int64)
        for t in range(block.per_key):
            w = k * block.per_key + t
            key = (key << block.bits) | (padded[place + w] if w < block.window else 0)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    return place[order], [k[order] for k in keys]


def bound(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of many suffixes at once: the first place not before (or after) each of them."""
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (open_ := lo < hi).any():
        middle = (lo + hi) // 2
        at = np.minimum(middle, max(len(keys[0]) - 1, 0))
        less, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, w in zip(keys, wanted, strict=True):
            less |= equal & (k[at] < w)
            equal &= k[at] == w
        go = open_ & (less | (equal & after))
        lo = np.where(go, middle + 1, lo)
        hi = np.where(open_ & ~go, middle, hi)
    return lo


def occurrences(texts, block: Block) -> tuple[np.ndarray, ...]:
    """(words of each document; document, item, place in the item, place in the document, words of the longest matches).
    Matches are runs of windows that follow one another in both."""
    raw, starts, ends, first = tokens(texts)
    code = _words.hashes(raw, starts, ends)
    near = np.searchsorted(block.vocabulary, code)
    known = (near < len(block.vocabulary)) & (block.vocabulary[np.minimum(near, max(len(block.vocabulary) - 1, 0))] == code) if len(block.vocabulary) else np.zeros(len(code), bool)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    numbers = np.zeros(len(code) + len(first), np.int64)  # a 0 between documents
    numbers[np.arange(len(code)) + doc] = np.where(known, near + 1, 0)
    place, keys = suffix_array(numbers, block)
    empty = (np.diff(first), *(np.zeros(0, np.int64),) * 5)
    # a benchmark suffix with a word that the shard lacks needs no search
    here = np.zeros(len(block.vocabulary) + 1, bool)
    here[numbers] = True
    here[0] = True
    wanted = np.flatnonzero(here[block.words].all(axis=1))
    if not len(place) or not len(wanted):
        return empty
    lo, hi = bound(keys, [k[wanted] for k in block.low], False), bound(keys, [k[wanted] for k in block.high], True)
    count = np.maximum(hi - lo, 0)
    if not count.sum():
        return empty
    w = np.repeat(wanted, count)
    at = place[np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)]
    owner = np.searchsorted(first[:-1] + np.arange(len(first) - 1), at, side="right") - 1
    while (wrong := first[owner + 1] <= at - owner).any():  # documents without words share their place with the next
        owner = owner + wrong
    word = at - owner
    item, j, width = block.item[w], block.at[w], block.width[w]
    order = np.lexsort((j, word - j, item, owner))
    owner, item, j, word, width = owner[order], item[order], j[order], word[order], width[order]
    new = np.ones(len(j), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (word[1:] - j[1:] != word[:-1] - j[:-1]) | (j[1:] != j[:-1] + 1)
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(j))) + width[head] - 1
    true = np.ones(len(head), bool)
    for k, (a, n) in enumerate(zip(word[head], length, strict=True)):
        true[k] = all(block.spelling[int(code[i])] == raw[starts[i] : ends[i]].tobytes() for i in range(a, a + n))
    head, length = head[true], length[true]
    return np.diff(first), owner[head], item[head], j[head], word[head] - first[owner[head]], length


def _blocks(benchmark: DataFrame, window: int) -> list[str]:
    """Blocks of benchmark(item_id, text) as files in the shared folder, each built by a task; their names."""
    folder = new_folder(benchmark.sparkSession, "benchmark")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL")
    words = items.agg(F.sum(F.floor(F.octet_length("text") / 2) + 1)).first()[0] or 0
    count = max(1, -(-int(words) // BLOCK_WORDS))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(count)).cast("int"))

    def build(batches):
        at, held = None, []

        def put():
            name = f"{folder}/block-{at}"
            with publish(name) as out:
                out.write(pickle.dumps(Block(held, window)))
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

        for batch in batches:
            for block, item, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if block != at:
                    if held:
                        yield put()
                    at, held = block, []
                held.append((item, text))
        if held:
            yield put()

    rows = dealt.select("block", "item_id", "text").repartition(count, "block").sortWithinPartitions("block", "item_id", "text")
    return sorted(r["name"] for r in rows.mapInArrow(build, "name string").collect())


_held: list = [None, None]


def _block(name: str) -> Block:
    """The block of that name: a task holds the last one that it asked for."""
    if _held[0] != name:
        _held[:] = None, None
        system, path = locate(name)
        with system.open_input_file(path) as source:
            _held[:] = name, pickle.loads(source.read())
    return _held[1]


def searcher(benchmark: DataFrame, window: int = WINDOW):
    """A column function: texts to their number of words and their longest matches of at least a window."""
    names = _blocks(benchmark, window)

    def found(texts: pa.Array) -> pa.Array:
        from askloom.llm.token_store import batches_of

        n_words, matches = np.zeros(len(texts), np.int64), [[] for _ in range(len(texts))]
        for name in names or [None]:
            block = _block(name) if name else Block([], window)
            for a, b in batches_of(texts, SHARD_BYTES):
                n, *runs = occurrences(texts.slice(a, b - a), block)
                n_words[a:b] = n
                for doc, item, x, y, z in zip(*runs, strict=True):
                    matches[a + doc].append({"item_id": block.ids[item], "item_from": int(x), "doc_from": int(y), "words": int(z)})
        kind = pa.list_(pa.struct([("item_id", pa.string()), ("item_from", pa.int32()), ("doc_from", pa.int32()), ("words", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(n_words), pa.array(matches, kind)], names=["n_words", "matches"])

    @F.arrow_udf(FOUND)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from askloom.llm.token_store import batches_of

        for texts in batches:
            parts = [found(texts.slice(a, b - a)) for a, b in batches_of(texts, SEVERAL_BYTES)]
            yield pa.concat_arrays(parts) if parts else found(texts)

    return search.asNondeterministic()  # evaluated once, where several of its fields are used


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", out: str = "matches") -> DataFrame:
    """docs with a column of their longest verbatim matches of at least a window with benchmark(item_id, text)."""
    return docs.withColumn(out, searcher(benchmark, window)(F.col(f"`{text}`"))["matches"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_hit (words inside a match), items (sorted ids), matches."""
    found = docs.select("doc_id", searcher(benchmark, window)(F.col("text")).alias("found")).select("doc_id", "found.n_words", "found.matches")
    ordered = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_from"].alias("a"), (m["doc_from"] + m["words"]).alias("b"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(ordered, start, lambda s, m: F.struct((s["n"] + F.greatest(F.lit(0), m["b"] - F.greatest(m["a"], s["end"]))).alias("n"), F.greatest(s["end"], m["b"]).alias("end")))
    return found.select(
        "doc_id",
        "n_words",
        covered["n"].cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda i: i.isNotNull()))).alias("items"),
        "matches",
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a match, with all their columns; texts are not shuffled."""
    found: Column = searcher(benchmark, window)(F.col("text"))
    return docs.filter(F.size(found["matches"]) == 0)
