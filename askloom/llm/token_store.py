"""Operator 6: token ids in a canonical, length-limited Huffman code.

Texts are tokenized once, into a table of ids in the shared folder. Their counts give code lengths of at most 16 bits
(package-merge over the vocabulary, which is bounded). The ids are then dealt out by ranges of doc_id; a task packs each of
its documents as an independent block of whole bytes, in ascending order, and begins a new file after ids_per_file ids, so
that a range, or a single doc_id, of any size makes files of bounded size. Each file carries the code lengths, and for each
document its length in ids and bytes and a bit-offset checkpoint every 64 ids, so that decoding looks up one table for all
checkpoints of many documents at once. Files have names of their attempt; a manifest, which Spark commits, lists those that
count.

Texts are cut where the tokenizer cuts them anyway (white space, and between letters and punctuation, if probes show so),
and every distinct piece of a task is given to the tokenizer once; texts beside one that holds an added token, and all texts
of a tokenizer that fails the probes, are given to it whole: the ids are the tokenizer's own.

Defined results: a null or empty text has only the end id; a text of any length is one block; null doc_id comes first; equal
doc_ids keep any order among themselves; other columns are left out; a vocabulary of more than 65,536 ids is refused with an
error; an empty table gives no file.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.llm import _words
from askloom.llm._shared import new_folder
from askloom.llm._store import locate, publish, task_number

MAX_BITS = 16
STEP = 64
MAGIC = b"AHUF0001"
#: Ids that are encoded or decoded at once in a task, and pieces that a task remembers.
AT_ONCE, REMEMBER = 1 << 20, 1 << 21
#: Bytes of text that are cut into pieces at once: a piece is looked up once in them.
TEXT_AT_ONCE = 3 << 20

MANIFEST = "part long, file string, documents long, ids long"
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


# --- ids ------------------------------------------------------------------------------------------------------------


class Encoder:
    """Texts to ids: distinct pieces between white space are tokenized once and remembered.

    What the tokenizer is asked to show on probes allows cheaper pieces: lower-casing A-Z first, parting letters from
    ASCII punctuation, and giving words of plain letters to its model directly.
    """

    #: Latin letters that no Unicode normal form or lower-casing changes.
    LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str, end_id: int) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.model = self.tokenizer.model
        alphabet = "abcdefghijklmnopqrstuvwxyz"
        self.lowers = self._ids(f"Mixed {alphabet.upper()}") == self._ids(f"mixed {alphabet}")
        parted = [c for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{}~" if all(self._ids(f"{x}{c}{y}") == self._ids(x) + self._ids(c) + self._ids(y) for x in ("ab", "the", "s") for y in ("cd", "ing", "s", "ll"))]
        self.letter = np.isin(np.arange(256), list(alphabet.encode()) + ([] if self.lowers else list(alphabet.upper().encode())))
        self.parted = np.isin(np.arange(256), [ord(c) for c in parted])
        # a byte-level model names the bytes that are not printable Latin characters by code points from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        probes = [alphabet, "the", "\u00e9l\u00e0n", "\u00fcber", "\u00f1\u00ff\u00dfa", *(x + y for x in "aeint\u00e8" for y in alphabet)]
        self.added = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        sides = ("the", "Of", "ab,", "(12", "\u00e9t\u00e9", "...")
        self.cuts = all(self._ids(f"{x}{w}{y}") == self._ids(x) + self._ids(y) for x in sides for y in sides for w in (" ", "\n", "\t", "  \r\n"))
        self.direct = all(self._direct(x) == self._ids(x) for x in probes)
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _direct(self, word: str) -> list[int]:
        return [x.id for x in self.model.tokenize(word if word.isascii() else "".join(map(self.names.__getitem__, word.encode())))]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lengths, self.pool, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16), 0

    def _learn(self, pieces: list[str]) -> None:
        plain = self.LETTERS.fullmatch if self.direct else lambda _: None
        other = [x for x in pieces if not plain(x)]
        rest = iter(self.tokenizer.encode_batch_fast(other, add_special_tokens=False))
        found = [self._direct(x) if plain(x) else next(rest).ids for x in pieces]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.known.update(zip(pieces, range(len(self.lengths), len(self.lengths) + len(pieces)), strict=True))
        flat = np.fromiter(chain.from_iterable(found), np.uint16, int(lengths.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), 2 * len(flat), 1 << 16), np.uint16)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += len(flat)

    def _whole(self, texts) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)
        ids = [np.array([*x.ids, self.end_id], np.uint16) for x in found]
        return np.concatenate([np.zeros(0, np.uint16), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """A pyarrow string array -> (ids of all texts, each with the end id; offsets of the texts)."""
        import pyarrow as pa

        raw, offsets = _words.flat(texts)
        lower = _words.LOWER[raw]
        plain = lower.tobytes()
        if not self.cuts or any(x in plain for x in self.added):
            return self._whole(texts)
        raw = lower if self.lowers else raw
        solid = _words.NOT_SPACE[raw]
        head = solid.copy()
        head[1:] &= ~solid[:-1]
        edges = offsets[:-1][offsets[:-1] < len(raw)]
        head[edges] = solid[edges]
        letter, parted = self.letter[raw], self.parted[raw]
        head[1:] |= (letter[1:] & parted[:-1]) | (parted[1:] & letter[:-1])
        place = np.flatnonzero(head)
        through = np.cumsum(solid, dtype=np.int32 if len(raw) < 1 << 31 else np.int64)
        cuts = np.append(through[place] - 1, through[-1] if len(raw) else 0).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(place), pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw[solid].tobytes())).dictionary_encode()
        if len(self.known) > REMEMBER:
            self.forget()
        distinct = pieces.dictionary.to_pylist()
        if new := [x for x in distinct if x not in self.known]:
            self._learn(new)
        which = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[pieces.indices.to_numpy()]
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        ids = self.pool[np.repeat(self.starts[which] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))] if len(ends) else np.zeros(0, np.uint16)
        stops = np.concatenate([[0], ends])[np.searchsorted(place, offsets)] + np.arange(len(texts) + 1)
        out = np.full(len(ids) + len(texts), self.end_id, np.uint16)
        body = np.ones(len(out), bool)
        body[stops[1:] - 1] = False
        out[body] = ids
        return out, stops


def batches_of(texts, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about most_bytes of text; a longer text is a run of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > most_bytes:
            yield at, k
            at, total = k, 0
        total += int(n)
    if at < len(sizes):
        yield at, len(sizes)


# --- the code -------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol in an optimal prefix code of at most `most` bits (package-merge); 0 for absent symbols."""
    symbols = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(symbols)
    if n <= 1:
        out[symbols] = 1
        return out
    if n > 1 << most:
        raise ValueError(f"{n} symbols do not fit into codes of {most} bits")
    by_count = symbols[np.argsort(counts[symbols], kind="stable")]
    leaves = counts[by_count].astype(np.float64)
    packages, is_leaf = np.zeros(0), []
    for _ in range(most):
        merged = np.concatenate([leaves, packages])
        order = np.argsort(merged, kind="stable")
        is_leaf.append(order < n)
        merged = merged[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    wanted = 2 * n - 2
    for flags in reversed(is_leaf):
        taken = int(flags[:wanted].sum())
        out[by_count[:taken]] += 1
        wanted = 2 * (wanted - taken)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    bits = lengths[order].astype(np.int64)
    steps = np.concatenate([[0], np.left_shift(1, MAX_BITS - bits)[:-1]]) if len(order) else np.zeros(0, np.int64)
    codes[order] = np.cumsum(steps) >> (MAX_BITS - bits)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, bits) for each of the 2^16 possible next 16 bits."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    bits = lengths[order].astype(np.int64)
    fill = np.left_shift(1, MAX_BITS - bits)
    symbols, sizes = np.zeros(1 << MAX_BITS, np.uint16), np.zeros(1 << MAX_BITS, np.uint8)
    symbols[: fill.sum()] = np.repeat(order, fill)
    sizes[: fill.sum()] = np.repeat(bits, fill)
    return symbols, sizes


def pack(ids: np.ndarray, stops: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of whole bytes -> (bytes of all, byte offsets, checkpoint steps in bits, offsets of the checkpoints)."""
    bits = lengths[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(bits)])
    size = (ends[stops[1:]] - ends[stops[:-1]] + 7) // 8
    byte_at = np.concatenate([[0], np.cumsum(size)])
    at = ends[:-1] + np.repeat(byte_at[:-1] * 8 - ends[stops[:-1]], np.diff(stops))
    # each code lies in one 32-bit word or two neighbours; different codes never share a bit, so sums are unions
    value = np.left_shift(codes[ids].astype(np.uint64), (64 - bits - (at & 31)).astype(np.uint64))
    words = byte_at[-1] // 4 + 2
    high = np.bincount(at >> 5, weights=(value >> np.uint64(32)).astype(np.float64), minlength=words)
    low = np.bincount((at >> 5) + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
    data = (high + low).astype(np.uint32).astype(">u4").tobytes()[: byte_at[-1]]
    # a checkpoint every STEP ids of a document, as bits since the one before
    count = (np.diff(stops) + STEP - 1) // STEP
    marks = np.concatenate([[0], np.cumsum(count)])
    inner = np.arange(marks[-1]) - np.repeat(marks[:-1], count)
    first = np.repeat(stops[:-1], count) + inner * STEP
    last = np.minimum(first + STEP, np.repeat(stops[1:], count))
    return data, byte_at, (ends[last] - ends[first]).astype(np.uint16), marks


def unpack(data: np.ndarray, byte_at: np.ndarray, n_ids: np.ndarray, steps: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of all blocks; data has 4 bytes of padding."""
    symbols, sizes = table
    window = (data[:-3].astype(np.uint32) << 24) | (data[1:-2].astype(np.uint32) << 16) | (data[2:-1].astype(np.uint32) << 8) | data[3:]
    count = (n_ids + STEP - 1) // STEP
    marks = np.concatenate([[0], np.cumsum(count)])
    bit = np.concatenate([[0], np.cumsum(steps.astype(np.int64))])
    pos = bit[:-1] + np.repeat(byte_at[:-1] * 8 - bit[marks[:-1]], count)
    inner = np.arange(marks[-1]) - np.repeat(marks[:-1], count)
    stops = np.concatenate([[0], np.cumsum(n_ids)])
    to = np.repeat(stops[:-1], count) + inner * STEP
    have = np.minimum(STEP, np.repeat(n_ids, count) - inner * STEP)
    order = np.argsort(-have, kind="stable")
    pos, to, have = pos[order], to[order], have[order]
    out = np.zeros(int(stops[-1]), np.uint16)
    for k in range(STEP):
        live = int(np.searchsorted(-have, -k, side="left"))
        if not live:
            break
        p = pos[:live]
        x = (window[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF
        out[to[:live] + k] = symbols[x]
        pos[:live] += sizes[x]
    return out


# --- files ----------------------------------------------------------------------------------------------------------


class Writer:
    """A file: header with the code lengths, blocks in order, then the table of documents."""

    def __init__(self, out, lengths: np.ndarray) -> None:
        packed = zlib.compress(lengths.tobytes())
        out.write(MAGIC + struct.pack("<II", len(lengths), len(packed)) + packed)
        self.out, self.docs, self.null, self.ids, self.bytes, self.steps, self.total = out, [], [], [], [], [], 0

    def add(self, doc_id: int | None, n_ids: int, block: bytes, steps: bytes) -> None:
        self.out.write(block)
        self.total += n_ids
        for at, x in ((self.docs, doc_id or 0), (self.null, doc_id is None), (self.ids, n_ids), (self.bytes, len(block)), (self.steps, steps)):
            at.append(x)

    def close(self) -> None:
        table = b"".join([np.array(self.docs, "<i8").tobytes(), np.array(self.null, "u1").tobytes(), np.array(self.ids, "<u4").tobytes(), np.array(self.bytes, "<u4").tobytes(), *self.steps])
        packed = zlib.compress(table, 1)
        self.out.write(packed + struct.pack("<QQ", len(self.docs), len(packed)) + MAGIC)


def read_file(source) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, ids of all, offsets) of runs of documents of an open file, in order."""
    size = source.size()
    source.seek(size - 24)
    n, packed, magic = struct.unpack("<QQ8s", source.read(24))
    if magic != MAGIC:
        raise ValueError("not a whole token file")
    source.seek(size - 24 - packed)
    table = zlib.decompress(source.read(packed))
    docs, null = np.frombuffer(table, "<i8", n), np.frombuffer(table, "u1", n, 8 * n)
    n_ids, n_bytes = np.frombuffer(table, "<u4", n, 9 * n).astype(np.int64), np.frombuffer(table, "<u4", n, 13 * n).astype(np.int64)
    steps = np.frombuffer(table, "<u2", -1, 17 * n)
    marks = np.concatenate([[0], np.cumsum((n_ids + STEP - 1) // STEP)])
    source.seek(8)
    vocabulary, packed = struct.unpack("<II", source.read(8))
    code = decode_table(np.frombuffer(zlib.decompress(source.read(packed)), np.uint8, vocabulary))
    total, at = np.concatenate([[0], np.cumsum(n_ids)]), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + AT_ONCE, side="right")) - 1)
        byte_at = np.concatenate([[0], np.cumsum(n_bytes[at:to])])
        data = np.frombuffer(source.read(int(byte_at[-1])) + b"\0\0\0\0", np.uint8)
        ids = unpack(data, byte_at, n_ids[at:to], steps[marks[at] : marks[to]], code)
        yield [None if z else int(d) for d, z in zip(docs[at:to], null[at:to], strict=True)], ids, total[at : to + 1] - total[at]
        at = to


# --- jobs -----------------------------------------------------------------------------------------------------------


def to_ids(docs: DataFrame, folder: str, path: str, end_id: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids (two bytes each), written under folder/raw: texts are tokenized once."""

    def run(batches):
        import pyarrow as pa

        encode = Encoder(path, end_id)
        for batch in batches:
            doc, texts = batch.column(0), batch.column(1)
            for a, b in batches_of(texts, TEXT_AT_ONCE):
                ids, stops = encode(texts.slice(a, b - a))
                data = ids.astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays([doc.slice(a, b - a), pa.array([data[2 * x : 2 * y] for x, y in zip(stops, stops[1:])], pa.binary())], names=["doc_id", "ids"])

    schema = "doc_id long, ids binary"
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{folder}/raw")
    return docs.sparkSession.read.schema(schema).parquet(f"{folder}/raw")


def _flat_ids(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow binary column of ids -> (ids of all rows, offsets)."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view("<u2"), (offsets - offsets[0]) // 2


def count_ids(ids: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; at most one row an id reaches the driver."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            total += np.bincount(_flat_ids(batch.column(0))[0], minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 2, ids_per_file: int = 1 << 24) -> DataFrame:
    """docs(doc_id, text) -> files under folder/ids; returns their manifest, written under folder/manifest."""
    spark = docs.sparkSession
    raw = to_ids(docs, folder, path, end_id)
    counts = count_ids(raw)
    lengths = code_lengths(counts[: int(np.flatnonzero(counts).max(initial=0)) + 1])
    code = spark.sparkContext.broadcast(lengths)  # one byte an id of the vocabulary

    def write(batches):
        import pyarrow as pa

        codes, task, attempt = canonical_codes(code.value), task_number(), uuid.uuid4().hex[:8]
        out, name, stream, done = None, None, None, []

        def finish():
            out.close()
            stream.__exit__(None, None, None)
            done.append((task << 24 | len(done), name, len(out.docs), out.total))

        for batch in batches:
            for a, b in batches_of(batch.column(1), 2 * AT_ONCE):
                ids, stops = _flat_ids(batch.column(1).slice(a, b - a))
                data, byte_at, steps, marks = pack(ids, stops, code.value, codes)
                bits = steps.astype("<u2").tobytes()
                for k, doc in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    if out and out.total >= ids_per_file:
                        finish()
                        out = None
                    if not out:
                        name = f"ids/{task:06d}-{attempt}-{len(done):06d}.ids"
                        stream = publish(f"{folder}/{name}")
                        out = Writer(stream.__enter__(), code.value)
                    out.add(doc, int(stops[k + 1] - stops[k]), data[byte_at[k] : byte_at[k + 1]], bits[2 * marks[k] : 2 * marks[k + 1]])
        if out:
            finish()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=[x.split()[0] for x in MANIFEST.split(", ")])

    order = F.col("doc_id").asc_nulls_first()
    dealt = raw.repartitionByRange(max(1, -(-int(counts.sum()) // ids_per_file)), order)
    dealt.sortWithinPartitions(order).mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document: its place among all ids, its number of ids, and the checksum of the decoded ids."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = locate(f"{folder}/{file}")
                with system.open_input_file(path) as source:
                    for docs, ids, stops in read_file(source):
                        wide = ids.astype("<u4")
                        sums = [zlib.crc32(wide[a:b]) for a, b in zip(stops, stops[1:])]
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(stops[:-1] + start), pa.array(np.diff(stops)), pa.array(sums, pa.int64())], names=[x.split()[0] for x in DECODED.split(", ")])
                        start += int(stops[-1])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("file", "start")
    spread_out = max(1, manifest.count())
    return files.repartition(spread_out).mapInArrow(read, DECODED)


def round_trip(docs: DataFrame, path: str, end_id: int = 2, ids_per_file: int = 1 << 24) -> DataFrame:
    folder = new_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, path, end_id, ids_per_file), folder)
