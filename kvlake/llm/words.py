"""Splitting and hashing the words of an Arrow batch of texts with numpy, on the UTF-8 bytes.

A word's 64-bit hash is a polynomial over its bytes modulo 2**64, mixed at the end. All words of a
batch are hashed together: byte values times powers of the base are summed from word start to word
start, and each sum is brought back to power 0 by the base's inverse.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
WINDOW = 1 << 18
M1, M2, M3, M4 = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x9FB21C651E98DF25))

#: Kinds of byte in the tables below.
SPACE, WORD, MARK = 0, 1, 2


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _values(lower: bool) -> np.ndarray:
    v = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        v[ord("A") : ord("Z") + 1] = v[ord("a") : ord("z") + 1]
    return v


@lru_cache
def plain_words() -> tuple[np.ndarray, np.ndarray]:
    """Kinds and values for words of any bytes but blank and 0x09-0x0D, with A-Z lower-cased."""
    kinds = np.full(256, WORD, np.uint8)
    kinds[[0x20, *range(0x09, 0x0E)]] = SPACE
    return kinds, np.where(kinds == SPACE, np.uint64(0), _values(True))


@lru_cache
def letter_words(lower: bool, marks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and values for words of letters, digits and non-ASCII bytes; each mark is a word of its own, or none."""
    kinds = np.full(256, MARK if marks else SPACE, np.uint8)
    kinds[0x80:] = WORD
    for a, z in ("09", "AZ", "az"):
        kinds[ord(a) : ord(z) + 1] = WORD
    kinds[[*range(0x00, 0x21), 0x7F]] = SPACE
    return kinds, np.where(kinds == SPACE, np.uint64(0), _values(lower))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * M1
    h = (h ^ (h >> np.uint64(29))) * M2
    return h ^ (h >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array without nulls; text k is bytes[offsets[k]:offsets[k + 1]]."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def fold_latin(data: np.ndarray) -> np.ndarray:
    """The bytes with the upper-case letters of U+00C0-U+00DE lower-cased (A-Z are left to the value tables)."""
    if not len(data) or not (data == 0xC3).any():
        return data
    out = data.copy()
    up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[up] += 0x20
    return out


def split(data: np.ndarray, offsets: np.ndarray, how: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word, in order. A word never crosses the border of two texts."""
    kinds, values = how
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = kinds[data]
    begins = kind == MARK
    inside = kind == WORD
    begins[0] |= inside[0]
    begins[1:] |= inside[1:] & ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] |= inside[heads]
    starts = np.flatnonzero(begins)
    return span_hashes(values[data], starts), np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the values from each start to the next; zeros at a span's end don't count."""
    hashes, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        first = starts[k]
        to = max(int(np.searchsorted(starts, first + WINDOW)), k + 1)
        part = values[first : starts[to] if to < len(starts) else len(values)]
        power, inverse = _powers(1 << max(18, int(len(part)).bit_length()))
        at = starts[k:to] - first
        hashes[k:to] = np.add.reduceat(part * power[: len(part)], at) * inverse[at]
        k = to
    return mixed(hashes)


def pieces(column: pa.Array, most: int = 1 << 19):
    """(from, to) row ranges of a batch with about `most` bytes each, so that temporary arrays stay small."""
    _, at = utf8(column)
    k = 0
    while k < len(column):
        to = max(int(np.searchsorted(at, at[k] + most)), k + 1)
        yield k, min(to, len(column))
        k = to
