"""Operator 12: secrets in whole texts, by patterns and a character convolutional network.

Three patterns give the base findings, which always stay: assignments to a credential's name, access key ids, long hex
runs. Candidates for more are all runs of LEAST or more characters of keys ([A-Za-z0-9+/_=-]) that mix letters and digits
or have at least LONG characters, wherever they stand. The network sees a candidate, LEFT characters before it and RIGHT
after it: characters become vectors, a convolution of five characters runs over them, its largest and mean values inside
and its largest outside the candidate go through a small dense layer to one number. Longer candidates are seen in
overlapping pieces; the highest counts. It is numpy only and a few thousand parameters, which go to tasks with the code.

It is trained on labelled findings: those of the corpus (base findings are positive, candidates that no pattern
claims negative, but for those that a first network takes for secrets; all distinct ones), and as many made from them, whose
value and credential's name are drawn anew, so that shapes without a pattern are learned too. A third of the findings, by
hash, isn't learned from: on it the numbers are calibrated to probabilities (Platt), and for each make of candidate the
threshold is the highest that still finds RECALL of the held-out positives (EVEN without any).

Texts are scanned once and not shuffled; only spans and candidates are written. Training, calibration and thresholds see
every distinct labelled finding, in tasks: findings are dealt to shards by hash, each round every shard goes once over its
findings from the shared state, and the driver gets the shards' states (72 kB each, SHARDS at most) and averages them. One
shard needs no rounds. Calibration adds up sums of tasks, thresholds are counted out. Every candidate of every text is scored.

Defined results: a null or empty text has no findings; very long texts and values are scanned whole; a candidate that
touches a base finding is not reported again; repeated rows each get their findings; other columns are left out; without
findings in the corpus the made ones alone are learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from copy import deepcopy
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.llm import _words
from askloom.llm._shared import materialize, release

# The kinds of findings in their order, and the patterns of the contract.
KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: What every assignment holds, in lower case.
NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")

LEAST, LONG, LEFT, PIECE, STRIDE, RIGHT = 12, 20, 24, 48, 32, 8
RECALL, EVEN, SEED, EPOCHS = 0.99, 0.5, 5, 14
#: Findings of a shard (more where there would be more than SHARDS), and numbers that the driver sorts to find a threshold.
SHARD, SHARDS, SORTED = 2048, 256, 4096
#: Findings that a shard reads at a time.
PART = 8192


def _among(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in chars])


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX, _KEY = _among(_DIGITS + "abcdef"), _among(_DIGITS + _LOWER + _UPPER + "+/_=-")
_DIGIT, _LETTER = _among(_DIGITS), _among(_LOWER + _UPPER)


# --- findings and candidates ----------------------------------------------------------------------------------------


def scan(text: bytes, hex_runs: list[tuple[int, int]], key_runs: list[tuple[int, int]], lower: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """((start, kind, end) of the base findings, in order; (start, end) of the candidates) of a text, in bytes."""
    base = []
    if any(name in lower for name in NAMES):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    base += [(a, 2, b) for a, b in hex_runs]
    base.sort()
    taken, end = [], -1
    for a, _, b in base:  # joined intervals
        if a <= end:
            end = taken[-1][1] = max(end, b)
        else:
            taken.append([a, b])
            end = b
    free, k = [], 0
    for a, b in key_runs:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            free.append((a, b))
    return base, free


def _runs(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, _ = _words.spans(raw, offsets, kind)
    long = ends - starts >= least
    return starts[long], ends[long]


def scan_texts(texts) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, bytes, bytes, bytes]]]]:
    """For each text of a pyarrow string array: base findings (start, kind, end), and candidates with what stands before
    them, their value and what stands after them; all in code points."""
    raw, offsets = _words.flat(texts)
    h_starts, h_ends = _runs(raw, offsets, _HEX, HEX_LEAST)
    k_starts, k_ends = _runs(raw, offsets, _KEY, LEAST)
    digits, letters = (np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int64)]) for kind in (_DIGIT, _LETTER))
    some = lambda total: total[k_ends] > total[k_starts]
    good = some(letters) & (some(digits) | (k_ends - k_starts >= LONG))
    k_starts, k_ends = k_starts[good], k_ends[good]
    h_cut, k_cut = np.searchsorted(h_starts, offsets), np.searchsorted(k_starts, offsets)
    whole, lower = raw.tobytes(), _words.LOWER[raw].tobytes()
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        text = whole[a:b]
        pairs = lambda s, e, cut: [(int(x) - a, int(y) - a) for x, y in zip(s[cut[i] : cut[i + 1]], e[cut[i] : cut[i + 1]], strict=True)]  # noqa: B023, E731
        base, free = scan(text, pairs(h_starts, h_ends, h_cut), pairs(k_starts, k_ends, k_cut), lower[a:b])
        if base or free:
            chars = np.flatnonzero((raw[a:b] & 0xC0) != 0x80)  # bytes that begin a code point
            at = lambda x: int(np.searchsorted(chars, x))  # noqa: B023, E731
            yield [(at(x), k, at(y)) for x, k, y in base], [(at(x), at(y), text[max(0, x - LEFT) : x], text[x:y], text[y : y + RIGHT]) for x, y in free]
            continue
        yield [], []


BASE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())]))
FREE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("left", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("right", T.BinaryType())]))
_BASE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_FREE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("left", pa.binary()), ("value", pa.binary()), ("right", pa.binary())]))


@F.arrow_udf(T.StructType([T.StructField("base", BASE), T.StructField("free", FREE), T.StructField("known", FREE)]))
def _scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    from askloom.llm.token_store import batches_of

    names = ["base", "free", "known"]
    for texts in batches:
        parts = [pa.StructArray.from_arrays([pa.array([], _BASE), pa.array([], _FREE), pa.array([], _FREE)], names=names)]
        for a, b in batches_of(texts):
            piece = texts.slice(a, b - a)
            base, free, known = [], [], []
            for i, (spans, candidates) in enumerate(scan_texts(piece)):
                base.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in spans])
                free.append([dict(zip(("start", "end", "left", "value", "right"), c, strict=True)) for c in candidates])
                text = piece[i].as_py() if spans else ""
                known.append([{"start": x, "end": y, "left": text[max(0, z - LEFT) : z].encode(), "value": text[z:y].encode(), "right": text[y : y + RIGHT].encode()} for x, k, y in spans for z in [value_start(text, x, k, y)]])
            parts.append(pa.StructArray.from_arrays([pa.array(base, _BASE), pa.array(free, _FREE), pa.array(known, _FREE)], names=names))
        yield pa.concat_arrays(parts)


def value_start(text: str, start: int, kind: int, end: int) -> int:
    """Where the value of a base finding begins: an assignment's after its name."""
    found = ASSIGN.match(text[start:end].encode()) if kind == 0 else None
    return start + found.start(2) if found else start


# --- the network ----------------------------------------------------------------------------------------------------

#: Padding, letters and digits and marks one by one, space, line end, other controls, all above ASCII.
_SHOWN = _LOWER + _UPPER + _DIGITS + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \n"
CODE = np.full(256, len(_SHOWN) + 1, np.int64)
CODE[128:] = len(_SHOWN) + 2
for _k, _c in enumerate(_SHOWN, 1):
    CODE[ord(_c)] = _k
SIZE, DIM, FILTERS, SPAN, HIDDEN = len(_SHOWN) + 3, 8, 24, 5, 12
WIDTH = LEFT + PIECE + RIGHT


def encode(findings: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, value, right) -> character codes and which are of the value, a row a piece; the finding of each row."""
    rows, inside, owner = [], [], []
    for i, (left, value, right) in enumerate(findings):
        for a in range(0, max(1, len(value) - PIECE + STRIDE), STRIDE):
            piece, end = value[a : a + PIECE], a + PIECE >= len(value)
            before, after = (left if a == 0 else value[max(0, a - LEFT) : a])[-LEFT:], right[:RIGHT] if end else value[a + PIECE : a + PIECE + RIGHT]
            line, flag = np.zeros(WIDTH, np.int64), np.zeros(WIDTH, bool)
            line[LEFT - len(before) : LEFT] = CODE[np.frombuffer(before, np.uint8)]
            line[LEFT : LEFT + len(piece)] = CODE[np.frombuffer(piece, np.uint8)]
            line[LEFT + len(piece) : LEFT + len(piece) + len(after)] = CODE[np.frombuffer(after, np.uint8)]
            flag[LEFT : LEFT + len(piece)] = True
            rows.append(line), inside.append(flag), owner.append(i)
    return np.array(rows).reshape(-1, WIDTH), np.array(inside).reshape(-1, WIDTH), np.array(owner, np.int64)


def fresh(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return {
        "letters": (rng.standard_normal((SIZE, DIM)) * 0.5).astype(np.float32), "conv": scale(SPAN * (DIM + 1), FILTERS), "conv_b": np.zeros(FILTERS, np.float32),
        "dense": scale(3 * FILTERS + 1, HIDDEN), "dense_b": np.zeros(HIDDEN, np.float32), "out": scale(HIDDEN, 1), "out_b": np.zeros(1, np.float32),
    }


def forward(net: dict[str, np.ndarray], codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The number of each row, and what backward needs."""
    n, half = len(codes), SPAN // 2
    chars = np.concatenate([net["letters"][codes], inside[..., None].astype(np.float32)], axis=2)
    padded = np.zeros((n, WIDTH + 2 * half, DIM + 1), np.float32)
    padded[:, half : half + WIDTH] = chars
    windows = np.concatenate([padded[:, k : k + WIDTH] for k in range(SPAN)], axis=2)
    maps = np.maximum(windows @ net["conv"] + net["conv_b"], 0)
    value = maps * inside[..., None]
    near = maps * ~inside[..., None]
    at_in, at_out = value.argmax(axis=1), near.argmax(axis=1)
    size = np.maximum(inside.sum(axis=1, keepdims=True), 1).astype(np.float32)
    pick = lambda x, at: np.take_along_axis(x, at[:, None, :], axis=1)[:, 0]
    pooled = np.concatenate([pick(value, at_in), value.sum(axis=1) / size, pick(near, at_out), np.log(size) / 4], axis=1)
    hidden = np.maximum(pooled @ net["dense"] + net["dense_b"], 0)
    return (hidden @ net["out"] + net["out_b"])[:, 0], (codes, inside, windows, maps, at_in, at_out, size, pooled, hidden)


def backward(net: dict[str, np.ndarray], kept: tuple, slope: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the sum of slope * number."""
    codes, inside, windows, maps, at_in, at_out, size, pooled, hidden = kept
    n, half, s = len(codes), SPAN // 2, slope[:, None]
    d_hidden = (s @ net["out"].T) * (hidden > 0)
    d_pooled = d_hidden @ net["dense"].T
    d_maps = np.repeat((d_pooled[:, FILTERS : 2 * FILTERS] / size)[:, None, :], WIDTH, axis=1) * inside[..., None]
    row, place = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
    d_maps[row, at_in, place] += d_pooled[:, :FILTERS] * inside[row, at_in]
    d_maps[row, at_out, place] += d_pooled[:, 2 * FILTERS : 3 * FILTERS] * ~inside[row, at_out]
    d_maps *= maps > 0
    flat = d_maps.reshape(-1, FILTERS)
    d_windows = (flat @ net["conv"].T).reshape(n, WIDTH, SPAN, DIM + 1)
    d_padded = np.zeros((n, WIDTH + 2 * half, DIM + 1), np.float32)
    for k in range(SPAN):
        d_padded[:, k : k + WIDTH] += d_windows[:, :, k]
    d_letters = np.zeros_like(net["letters"])
    np.add.at(d_letters, codes.ravel(), d_padded[:, half : half + WIDTH, :DIM].reshape(-1, DIM))
    return {
        "letters": d_letters, "conv": windows.reshape(-1, windows.shape[2]).T @ flat, "conv_b": flat.sum(axis=0),
        "dense": pooled.T @ d_hidden, "dense_b": d_hidden.sum(axis=0), "out": hidden.T @ s, "out_b": s.sum(axis=0),
    }


def start(seed: int = SEED) -> dict:
    """The state of the training before its first step: the network, Adam's means, steps taken."""
    net = fresh(seed)
    return {"net": net, "first": {k: np.zeros_like(v) for k, v in net.items()}, "second": {k: np.zeros_like(v) for k, v in net.items()}, "step": 0}


def once(state: dict, codes: np.ndarray, inside: np.ndarray, y: np.ndarray, share: float, rng: np.random.Generator, size: int = 256, rate: float = 4e-3) -> None:
    """Goes once over the rows: logistic loss, Adam; `share` of all rows are positive, and classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32)
    net, first, second = state["net"], state["first"], state["second"]
    order = rng.permutation(len(y))
    for a in range(0, len(order), size):
        at = order[a : a + size]
        number, kept = forward(net, codes[at], inside[at])
        slope = ((1 / (1 + np.exp(-np.clip(number, -30, 30))) - y[at]) * weight[at] / len(at)).astype(np.float32)
        state["step"] += 1
        for k, g in backward(net, kept, slope).items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net[k] -= rate * (first[k] / (1 - 0.9 ** state["step"])) / (np.sqrt(second[k] / (1 - 0.99 ** state["step"])) + 1e-8)


def train(findings: list[tuple[bytes, bytes, bytes]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    codes, inside, owner = encode(findings)
    y, state, rng = labels[owner].astype(np.float32), start(seed), np.random.default_rng(seed)
    for _ in range(epochs):
        once(state, codes, inside, y, float(y.mean()), rng)
    return state["net"]


def numbers(net: dict[str, np.ndarray], findings: list[tuple[bytes, bytes, bytes]], at_once: int = 512) -> np.ndarray:
    """The highest number of each finding's pieces."""
    out = np.full(len(findings), -np.inf)
    for a in range(0, len(findings), at_once):
        codes, inside, owner = encode(findings[a : a + at_once])
        for b in range(0, len(codes), at_once):
            got, _ = forward(net, codes[b : b + at_once], inside[b : b + at_once])
            np.maximum.at(out, a + owner[b : b + at_once], got.astype(np.float64))
    return out


def make_of(value: bytes) -> int:
    """The make of a candidate: 0 of hex digits, 1 of letters and digits, 2 with marks, 3 without digits."""
    kinds = np.frombuffer(value, np.uint8)
    if not _DIGIT[kinds].any():
        return 3
    return 0 if _HEX[kinds].all() else 1 if (_DIGIT[kinds] | _LETTER[kinds]).all() else 2


def newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, aims: tuple[float, float]) -> np.ndarray:
    """A Newton step's sums over numbers x: the gradient, and the second derivatives of (slope, slope and offset, offset)."""
    p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
    off, bend = p - np.where(y > 0, *aims), p * (1 - p) + 1e-9
    return np.array([(x * off).sum(), off.sum(), (x * x * bend).sum(), (x * bend).sum(), bend.sum()])


def calibrate(sums, n1: int, n0: int, steps: int = 200) -> tuple[float, float]:
    """Platt scaling: slope and offset that make logistic(slope * number + offset) a probability. sums(w, aims) adds up
    newton_sums over n1 positives and n0 others."""
    w, aims = np.array([1.0, 0.0]), ((n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(steps):
        a, b, xx, x1, one = sums(w, aims)
        move = np.linalg.solve(np.array([[xx, x1], [x1, one]]) + 1e-6 * np.eye(2), np.array([a, b]))
        w = w - np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


# --- labelled findings ----------------------------------------------------------------------------------------------

# Names of credentials, and of what is none, that made findings stand behind.
CREDENTIALS = ("secret", "token", "api_key", "password", "auth", "authorization: bearer", "bearer", "pwd", "client_secret", "private_key", "access key", "credentials", "signing key", "webhook secret", "connection key", "")
PLAIN = ("file", "id of the page", "commit message", "see", "path", "name", "version", "date", "class", "column", "mail", "link", "by", "the", "")
_ALPHABETS = (_DIGITS + "abcdef", _LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS + "+/", _LOWER + _UPPER + _DIGITS + "_-", _UPPER + "234567", _LOWER + _DIGITS)
_PARTS = ("report", "index", "summary", "chapter", "image", "final", "draft", "mail", "server", "node", "user", "page", "section", "table", "model", "config", "release", "build", "daily", "backup")


def made(seen: list[tuple[bytes, bytes, bytes]], labels: np.ndarray, least: int = 1500, seed: int = SEED) -> tuple[list[tuple[bytes, bytes, bytes]], np.ndarray]:
    """A finding for each seen one, and `least` of each label at least, with a value and a name drawn anew."""
    rng, out, kinds = random.Random(seed), [], []

    def secret() -> str:
        body = "".join(rng.choices(rng.choice(_ALPHABETS), k=rng.randint(16, 64)))
        mark = rng.choice(["", "", "", "pk_", "live_", "key-", "x" + "".join(rng.choices(_LOWER, k=2)) + "-"])
        return mark + body + rng.choice(["", "", "", "=", "=="])

    def plain() -> str:
        word = lambda: rng.choice(_PARTS) if rng.random() < 0.5 else "".join(rng.choices("aeioulnrst", k=rng.randint(3, 8)))
        kind = rng.randrange(5)
        if kind == 0:
            return f"{rng.randint(1990, 2039)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}"
        if kind == 1:
            return rng.choice("-_/").join([*(word() for _ in range(rng.randint(2, 6))), str(rng.randint(1, 2030))])
        if kind == 2:
            return "".join(word().capitalize() for _ in range(rng.randint(2, 5))) + str(rng.randint(1, 99))
        if kind == 3:
            return rng.choice("-_/").join(word() for _ in range(rng.randint(3, 8)))
        return "".join(word() for _ in range(rng.randint(3, 6)))

    by_label = [[f for f, y in zip(seen, labels, strict=True) if y == c] for c in (0, 1)]
    for c in (0, 1):
        for k in range(max(least, len(by_label[c]))):
            around = rng.choice(by_label[rng.randrange(2)] or by_label[c] or [(b"", b"", b"")])
            name = rng.choice(CREDENTIALS if c else PLAIN)
            join = rng.choice([" = ", "=", ": ", ":", " ", ' = "', "='", " => ", '": "']) if name else rng.choice([" ", "\n", "(", '"'])
            left = (around[0][: rng.randint(0, LEFT)] + (" " + (name.upper() if rng.random() < 0.2 else name) + join).encode())[-LEFT:]
            value = secret() if c else plain()
            out.append((left, value.encode(), rng.choice([b" ", b"\n", b'" ', b"'", around[2]])))
            kinds.append(c)
    return out, np.array(kinds)


def labelled(found: DataFrame) -> DataFrame:
    """found(free, known) -> label, left, value (its first piece), right: all distinct findings of the corpus."""

    def of(label: int, column: str) -> DataFrame:
        return found.select(F.explode(column).alias("f")).select(F.lit(label).alias("label"), "f.left", F.substring("f.value", 1, PIECE).alias("value"), "f.right")

    return of(0, "free").union(of(1, "known")).distinct()


class Model:
    """The trained network, its calibration, and a threshold for each make of candidate."""

    def __init__(self, findings: list[tuple[bytes, bytes, bytes]], labels: np.ndarray, recall: float = RECALL) -> None:
        out = np.array([held_out(v) for _, v, _ in findings])
        self.net = train([f for f, o in zip(findings, out, strict=True) if not o], labels[~out])
        held = [f for f, o in zip(findings, out, strict=True) if o]
        number, y, makes = numbers(self.net, held), labels[out], np.array([make_of(v) for _, v, _ in held])
        self.slope, self.offset = calibrate(lambda w, aims: newton_sums(number, y, w, aims), int(y.sum()), int(len(y) - y.sum()))
        p = self.probability(number)
        self.thresholds = np.full(4, EVEN)
        self.recall, self.false = np.ones(4), np.zeros(4)
        for make in range(4):
            good, bad = np.sort(p[(makes == make) & (y == 1)]), p[(makes == make) & (y == 0)]
            if len(good):
                self.thresholds[make] = good[int((1 - recall) * len(good))]
                self.recall[make] = (good >= self.thresholds[make]).mean()
            if len(bad):
                self.false[make] = (bad >= self.thresholds[make]).mean()

    @classmethod
    def of(cls, net: dict[str, np.ndarray], slope: float, offset: float, thresholds: np.ndarray) -> Model:
        out = cls.__new__(cls)
        out.net, out.slope, out.offset, out.thresholds = net, slope, offset, thresholds
        return out

    def probability(self, number: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * number + self.offset, -30, 30)))

    def secret(self, findings: list[tuple[bytes, bytes, bytes]]) -> np.ndarray:
        if not findings:
            return np.zeros(0, bool)
        makes = np.array([make_of(v) for _, v, _ in findings])
        return self.probability(numbers(self.net, findings)) >= self.thresholds[makes]


# --- learning in tasks ----------------------------------------------------------------------------------------------

_KEY_COLUMNS = ("left", "value", "right")


def held_out(value: bytes) -> bool:
    return zlib.crc32(value) % 3 == 0


def _findings(batch: pa.RecordBatch | pa.Table) -> list[tuple[bytes, bytes, bytes]]:
    return list(zip(*(batch.column(c).to_pylist() for c in _KEY_COLUMNS), strict=True))


def dealt(rows: DataFrame, n: int, marks: DataFrame | None = None) -> DataFrame:
    """rows, and marks of shards if given, with their shard of n, by the hash of the finding. A shard lies whole in a
    partition, in a fixed order, however many partitions there are."""
    sharded = rows.withColumn("shard", F.pmod(F.hash(*_KEY_COLUMNS), F.lit(n)))
    return (sharded if marks is None else sharded.union(marks)).repartition(n, "shard").sortWithinPartitions("shard", "label", *_KEY_COLUMNS)


def shards_of(n_findings: int) -> int:
    return min(SHARDS, max(1, -(-n_findings // SHARD)))


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """(shard, number, rows) for rows sorted by shard: those of each shard in parts of PART, wherever batches end."""
    shard, number, held = -1, 0, None
    for batch in batches:
        at = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else []
        for a, b in pairwise(cuts):
            if at[a] != shard:
                if held is not None and len(held):
                    yield shard, number, held
                shard, number, held = int(at[a]), 0, None
            more = pa.Table.from_batches([batch.slice(a, b - a)])
            held = more if held is None else pa.concat_tables([held, more])
            while len(held) >= PART:
                yield shard, number, held.slice(0, PART)
                number, held = number + 1, held.slice(PART)
    if held is not None and len(held):
        yield shard, number, held


def with_made(seen: DataFrame, n: int, least: int = 1500) -> DataFrame:
    """seen(label, left, value, right) and as many made findings of each label, `least` at least; is_made tells them apart.
    Each of the n shards makes its part of them."""
    spark, each = seen.sparkSession, -(-least // n)
    schema = T.StructType([*seen.schema.fields, T.StructField("is_made", T.BooleanType())])
    marks = spark.range(n).select(F.lit(-1).alias("label"), *[F.lit(b"").alias(c) for c in _KEY_COLUMNS], F.col("id").cast("int").alias("shard"))  # so that no shard is empty

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, k, part in by_shard(batches):
            labels = np.array(part.column("label").to_pylist(), np.int64)
            findings = [f for f, y in zip(_findings(part), labels, strict=True) if y >= 0]
            labels = labels[labels >= 0]
            more, kinds = made(findings, labels, 0 if k else each, SEED + shard + 1000003 * k)
            whole, y = findings + more, np.concatenate([labels, kinds]).astype(np.int32)
            columns = [pa.array(c, pa.binary()) for c in zip(*whole, strict=True)] if whole else [pa.array([], pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(y), *columns, pa.array(np.arange(len(whole)) >= len(findings))], names=schema.names)

    return dealt(seen, n, marks).mapInArrow(run, schema)


def trained(rows: DataFrame, n: int, share: float, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """rows(label, left, value, right) -> the network: n shards go over their findings from one state, the mean of theirs is
    the next. An only shard goes through all epochs in its task."""
    import pickle

    rounds, passes, state = (1, epochs, start()) if n == 1 else (epochs, 1, start())
    shards = dealt(rows, n)
    for number in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], state=state, number=number) -> Iterator[pa.RecordBatch]:
            for shard, parts in groupby(by_shard(batches), key=lambda p: p[0]):
                own, seen, rng = deepcopy(state), 0, np.random.default_rng([SEED, number, shard])

                def coded(parts=parts):
                    for _, _, part in parts:
                        codes, inside, owner = encode(_findings(part))
                        yield codes, inside, np.array(part.column("label").to_pylist(), np.float32)[owner]

                held = list(coded()) if passes > 1 else coded()
                for _ in range(passes):
                    for codes, inside, y in held:
                        once(own, codes, inside, y, share, rng)
                        seen += len(y)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seen], pa.int64()), pa.array([pickle.dumps(own)], pa.binary())], names=["shard", "seen", "state"])

        got = sorted(shards.mapInArrow(run, "shard int, seen long, state binary").collect(), key=lambda r: r["shard"])  # a row a shard
        found = [(r["seen"], pickle.loads(r["state"])) for r in got]
        total = sum(w for w, _ in found) or 1
        mean = lambda part, k: sum(w / total * s[part][k].astype(np.float64) for w, s in found).astype(np.float32)  # noqa: B023, E731
        if found:
            state = {**{part: {k: mean(part, k) for k in state["net"]} for part in ("net", "first", "second")}, "step": round(sum(w / total * s["step"] for w, s in found))}
    return state["net"]


def numbered(net: dict[str, np.ndarray], rows: DataFrame) -> DataFrame:
    """rows(label, left, value, right) with their make and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            findings = _findings(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([make_of(v) for _, v, _ in findings], pa.int32()), pa.array(numbers(net, findings), pa.float64())], names=[*batch.schema.names, "make", "number"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("make", T.IntegerType()), T.StructField("number", T.DoubleType())]))


def calibrated(held: DataFrame, n1: int, n0: int) -> tuple[float, float]:
    """calibrate() over held(label, number); tasks add up, the driver gets five numbers a task."""

    def sums(w: np.ndarray, aims: tuple[float, float]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros(5)
            for batch in batches:
                total += newton_sums(batch.column("number").to_numpy(), batch.column("label").to_numpy(), w, aims)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["place", "sums"])

        got = sorted(held.select("label", "number").mapInArrow(run, "place int, sums array<double>").collect(), key=lambda r: r["place"])
        return np.sum([np.zeros(5), *[r["sums"] for r in got]], axis=0)

    return calibrate(sums, n1, n0)


def kth(values: DataFrame, k: int, n: int, cells: int = 1024) -> float:
    """The k-th smallest (from 0) of values(value), which has n rows: the range that holds it is counted in cells and
    narrowed until few are left, and these are sorted."""
    while n > SORTED:
        low, high = values.agg(F.min("value"), F.max("value")).first()
        if low == high:
            return low
        cell = F.least(F.lit(cells - 1), F.floor((F.col("value") - low) / (high - low) * cells).cast("int")).alias("cell")
        counts = values.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).orderBy("low").collect()
        for r in counts:
            if k < r["n"]:
                break
            k -= r["n"]
        n, values = r["n"], values.filter(F.col("value").between(r["low"], r["high"]))
    return values.orderBy("value").collect()[k]["value"]


def fit(rows: DataFrame, recall: float | None = RECALL) -> Model:
    """rows(label, left, value, right), all in tasks -> the model; without a recall, its thresholds are all EVEN."""
    out = F.crc32("value") % 3 == 0
    pieces = F.ceil(F.greatest(F.lit(1), F.length("value") - PIECE + STRIDE) / STRIDE)
    n, ones, every = rows.filter(~out).agg(F.count(F.lit(1)), F.sum(F.when(F.col("label") == 1, pieces)), F.sum(pieces)).first()
    net = trained(rows.filter(~out), shards_of(n), (ones or 0) / (every or 1))
    held = materialize(numbered(net, dealt(rows.filter(out), shards_of(n))).select("label", "make", "number"), "held")
    found = {(r["make"], r["label"]): r["n"] for r in held.groupBy("make", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # eight rows at most
    total = lambda label: sum(n for (_, y), n in found.items() if y == label)
    model = Model.of(net, *calibrated(held, total(1), total(0)), np.full(4, EVEN))
    for make in range(4) if recall is not None else ():
        if good := found.get((make, 1)):
            up = 1 if model.slope >= 0 else -1
            value = up * kth(held.filter((F.col("make") == make) & (F.col("label") == 1)).select((F.col("number") * up).alias("value")), int((1 - recall) * good), good)
            model.thresholds[make] = model.probability(np.array([value]))[0]
    release(held)
    return model


def learn(found: DataFrame, recall: float = RECALL) -> Model:
    """found(free, known) of a corpus -> the model, of all its distinct findings.

    No pattern says that the corpus's candidates are clean, so those that a first model, of the other findings, thinks are
    secrets are not learned from.
    """
    seen = materialize(labelled(found), "labelled")
    n = shards_of(seen.count())
    rows = materialize(with_made(seen, n), "learned")
    doubtful = (F.col("label") == 0) & ~F.col("is_made")
    used = rows
    if not seen.filter("label = 0").isEmpty():
        first = fit(rows.filter(~doubtful), None)
        clean = numbered(first.net, rows.filter(doubtful)).filter(F.lit(first.slope) * F.col("number") + first.offset < float(np.log(EVEN / (1 - EVEN))))
        used = materialize(rows.filter(~doubtful).unionByName(clean.select(rows.columns)), "learned")
    model = fit(used, recall)
    release(seen, rows, used if used is not rows else None)
    return model


def judge(model: Model):
    """A column function: candidates to the spans of those that are secrets."""

    @F.arrow_udf(BASE)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            rows = lists.to_pylist()
            flat = [(f["left"], f["value"], f["right"]) for row in rows for f in row or ()]
            good, at, out = model.secret(flat), 0, []
            for row in rows:
                keep = good[at : at + len(row or ())]
                at += len(keep)
                out.append([{"start": f["start"], "kind": 3, "end": f["end"]} for f, k in zip(row or (), keep, strict=True) if k])
            yield pa.array(out, _BASE)

    return spans


# --- results --------------------------------------------------------------------------------------------------------


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs(text, keep...) -> keep..., base, free, known: base findings, candidates, and the values of base findings."""
    kept = [F.col(f"`{c}`") for c in keep]
    return docs.select(*kept, _scanned.asNondeterministic()(F.col("text")).alias("_found")).select(*kept, "_found.*")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, by start and then kind, with commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """docs(doc_id, text) -> doc_id, base (findings by patterns) and spans (with those of the network), as arrays of
    (start, kind, end)."""
    found = materialize(find(docs, ["doc_id"]), "secrets")
    model = learn(found, recall)
    return found.select("doc_id", "base", F.concat("base", judge(model)("free")).alias("spans"))
