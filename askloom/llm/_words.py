"""Words of many texts at once, on the bytes of an Arrow string column. Words are runs of bytes of a given class, which is
the same as runs of characters for classes that hold all or none of the bytes above 0x7F."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np

#: Any byte but space and 0x09 to 0x0D; the same with A-Z lower-cased first.
NOT_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: Digits, lower-case letters, and all above 0x7F.
ALNUM = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes that are looked at at once, and the length from which a word is hashed on its own.
PIECE, LONG = 1 << 22, 64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def spans(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets of the texts' words) of the words in all texts, a piece of the bytes at a time."""
    starts, ends, last = [], [], False
    for a in range(0, len(raw), PIECE):
        inside = kind[raw[a : a + PIECE]]
        before = np.concatenate([[last], inside[:-1]])
        last = inside[-1]
        joined = before & inside
        joined[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, a + len(inside))] - a] = False
        starts.append(np.flatnonzero(inside & ~joined) + a)
        ends.append(np.flatnonzero(before & ~joined) + a)
    ends.append(np.full(int(last), len(raw)))
    starts, ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
    return starts, ends.astype(np.int64), np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, of its bytes eight at a time. What it holds grows with the words, and nothing stays."""
    size = ends - starts
    out = size.astype(_U)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw), "<u8", padded, strides=(1,))
    live = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        out[live] = mix(out[live] * _U(_BASE) + (eight[starts[live] + k] & _FIRST[np.minimum(size[live] - k, 8)]))
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words, one for every place where one starts."""
    n = len(words) - width + 1
    out = np.full(max(n, 0), width, _U)
    for k in range(width):
        out = mix(out * _U(_BASE) + words[k : k + n]) if n > 0 else out
    return out


def same(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, o_starts: np.ndarray, o_ends: np.ndarray) -> np.ndarray:
    """Whether each word has the bytes of its counterpart in another array of bytes."""
    size = ends - starts
    out = size == o_ends - o_starts
    left, right = (np.ndarray(len(r), "<u8", np.concatenate([r, np.zeros(8, np.uint8)]), strides=(1,)) for r in (raw, other))
    live = np.flatnonzero(out)
    k = 0
    while len(live := live[size[live] > k]):
        short = _FIRST[np.minimum(size[live] - k, 8)]
        unequal = (left[starts[live] + k] & short) != (right[o_starts[live] + k] & short)
        out[live[unequal]] = False
        live = live[~unequal]
        k += 8
    return out


def _crc_table() -> np.ndarray:
    """The reflected CRC-32 of each byte, from its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The unsigned CRC-32 of each word, or of what has the CRC-32 `before` and the word after it."""
    ones = np.uint32(0xFFFFFFFF)
    out = np.full(len(starts), ones) if before is None else before.astype(np.uint32) ^ ones
    size = ends - starts
    live = np.flatnonzero(size <= LONG)
    for k in range(LONG):
        live = live[size[live] > k]
        if not len(live):
            break
        out[live] = _CRC[(out[live] ^ raw[starts[live] + k]) & 255] ^ (out[live] >> 8)
    out ^= ones
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(raw[starts[i] : ends[i]], 0 if before is None else int(before[i]))
    return out
