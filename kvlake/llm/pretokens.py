"""The word-end BPE vocabulary over Arrow batches: splitting into pre-tokens, whole tokens, merging the rest.

Splitting works on the UTF-8 bytes of all texts of a batch at once, for texts whose characters are
ASCII or Latin up to U+024F; there Unicode normalisation changes nothing, and lower case and classes
are the same in all libraries. Other texts, and those that may hold a special token, go to the
library whole. Pre-tokens are known by 64-bit hashes; what a task has once found, it remembers.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from . import words

#: Fixed values of the vocabulary: the mark of a word's end, and endings that are pre-tokens of their own:
#: 's 't 'm 'd 're 've 'll
WORD_END = "</w>"
ONE, TWO = (b"s", b"t", b"m", b"d"), (b"re", b"ve", b"ll")
#: Bytes of the longest pre-token that is merged here; longer ones go to the library. Pre-tokens that a task remembers.
LONGEST, REMEMBERED = 64, 1 << 18
LETTER, NUMBER, OTHER, BLANK, FOREIGN = range(5)
NEVER = np.int32(2**31 - 1)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower-case form) of each character under U+0800; FOREIGN where the library is to decide."""
    kind, low = np.full(0x800, FOREIGN, np.uint8), np.arange(0x800, dtype=np.uint16)
    for c in [*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA0, 0x250)]:
        small = chr(c).lower()
        if len(small) == 1 and ord(small) < 0x800 and (c < 0x80) == (ord(small) < 0x80):
            main = unicodedata.category(small)[0]
            kind[c], low[c] = BLANK if chr(c).isspace() else LETTER if main == "L" else NUMBER if main == "N" else OTHER, ord(small)
    return kind, low


def split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, hashes, row of each pre-token, rows left to the library)."""
    data, offsets = words.utf8(column)
    nothing = np.zeros(0, np.int64)
    if not len(data):
        return data, nothing, nothing, nothing.astype(np.uint64), nothing, nothing
    kinds, lower = _letters()
    kind = np.concatenate([kinds[:0x80], np.full(0x80, FOREIGN, np.uint8)])[data]
    text = np.concatenate([lower[:0x80].astype(np.uint8), np.arange(0x80, 0x100, dtype=np.uint8)])[data]
    two = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xC9) & (data[1:] & 0xC0 == 0x80))
    point = ((data[two] & 0x1F).astype(np.uint16) << 6) | (data[two + 1] & 0x3F)
    kind[two] = kind[two + 1] = kinds[point]
    text[two], text[two + 1] = (lower[point] >> 6) | 0xC0, (lower[point] & 0x3F) | 0x80
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    row_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
    foreign = np.unique(row_of(np.concatenate([np.flatnonzero(kind == FOREIGN), special])))
    kind[kind == FOREIGN] = OTHER
    head = np.zeros(len(data) + 3, bool)
    head[offsets[:-1]] = True
    begins = np.ones(len(data), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | head[1 : len(data)]
    begins[two + 1] = False
    begins[kind == BLANK] = False
    mark = np.flatnonzero(begins & (text == ord("'")))
    padded = np.concatenate([text, np.zeros(3, np.uint8)])
    is_letter = np.concatenate([kind == LETTER, np.zeros(3, bool)])
    for size, endings in ((1, ONE), (2, TWO)):
        hit = np.zeros(len(mark), bool)
        for e in endings:
            same = ~head[mark + 1]
            for k in range(size):
                same &= (padded[mark + 1 + k] == e[k]) & ~(head[mark + 1 + k])
            hit |= same
        at = mark[hit]
        begins[at + 1] = False
        after = at + 1 + size
        begins[after[is_letter[after]]] = True
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(np.concatenate([(kind == BLANK), [True]]) & np.concatenate([[True], kind != BLANK]))
    ends = np.minimum(np.append(starts[1:], len(data)), stops[np.minimum(np.searchsorted(stops, starts), len(stops) - 1)])
    values = np.where(kind == BLANK, np.uint64(0), words._values(False)[text])
    hashes, doc = words.span_hashes(values, starts), row_of(starts)
    if len(foreign):
        keep = ~np.isin(doc, foreign)
        starts, ends, hashes, doc = starts[keep], ends[keep], hashes[keep], doc[keep]
    return text, starts, ends, hashes, doc, foreign


class Merges:
    """The vocabulary's merges, applied to many words of equal length at once."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        ids, pairs = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level vocabularies write such a byte as itself, the others as the next letters from U+0100 on
        letter = {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner, self.last = (np.array([ids[letter[b] + end] for b in range(256)], np.int64) for end in ("", WORD_END))
        key = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.new = key[order], order.astype(np.int32), np.array([ids[a + b] for a, b in pairs], np.int64)[order]
        byte = {c: b for b, c in letter.items()}
        self.strings = []
        for x in ids:
            if x.endswith(WORD_END) and all(c in byte for c in x[: -len(WORD_END)]) and len(x) > len(WORD_END):
                self.strings.append(bytes(byte[c] for c in x[: -len(WORD_END)]))

    def _probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        return np.where(hit, self.rank[at], NEVER), self.new[at]

    def __call__(self, letters: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Groups (rows, ids) of words given as rows of bytes; rows of a group end with equally many ids."""
        ids = np.concatenate([self.inner[letters[:, :-1]], self.last[letters[:, -1:]]], 1)
        rank, new = self._probe(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(len(ids)), []
        while rank.shape[1]:
            r = np.arange(len(rows))
            pick = np.argmin(rank, 1)
            ok = rank[r, pick] != NEVER
            if not ok.all():
                out.append((rows[~ok], ids[~ok]))
                rows, ids, rank, new, pick = rows[ok], ids[ok], rank[ok], new[ok], pick[ok]
                r = np.arange(len(rows))
            if not len(rows):
                return out
            ids[r, pick] = new[r, pick]
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > pick[:, None]), 1)
            shift = column[:-1] + (column[:-1] >= pick[:, None])
            rank, new = np.take_along_axis(rank, shift, 1), np.take_along_axis(new, shift, 1)
            for side in (-1, 0):
                k = pick + side
                some = np.flatnonzero((k >= 0) & (k < rank.shape[1]))
                rank[some, k[some]], new[some, k[some]] = self._probe(ids[some, k[some]], ids[some, k[some] + 1])
        out.append((rows, ids))
        return out


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def whole_tokens(path: str) -> dict[bytes, int]:
    """Vocabulary strings that the library, given them alone, encodes as one token, with that token's id. As pre-tokens never merge with each other, such a string counts as one token wherever it is a pre-token."""
    strings = []
    for b in merges(path).strings:
        try:
            strings.append(b.decode())
        except UnicodeDecodeError:
            continue  # not a text of its own, such as half a character
    text, starts, ends, _, doc, foreign = split(pa.array(strings))
    alone = np.bincount(doc, minlength=len(strings)) == 1
    alone[foreign] = False
    return {s.encode(): e.ids[0] for s, e, ok in zip(strings, tokenizer(path).encode_batch(strings, add_special_tokens=False), alone) if ok and len(e.ids) == 1}


class Ids:
    """Ids of pre-tokens: whole tokens from the start, others as they are met."""

    def __init__(self, path: str, whole: dict[bytes, int]):
        self.path = path
        joined = np.frombuffer(b"".join(whole), np.uint8)
        starts = np.cumsum([0, *map(len, whole)])[:-1]
        key = words.span_hashes(words._values(False)[joined], starts)
        order = np.argsort(key)
        self.base = key[order], np.arange(len(key)), np.ones(len(key), np.int64), np.array(list(whole.values()), np.uint32)[order]
        self.keys, self.first, self.count, self.pool = self.base

    def _learn(self, new: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        size = ends - starts
        found: list[np.ndarray] = [None] * len(new)  # type: ignore[list-item]
        for n in np.unique(size).tolist():
            which = np.flatnonzero(size == n)
            if n > LONGEST:
                for k in which:
                    word = text[starts[k] : ends[k]].tobytes().decode()
                    found[k] = np.array(tokenizer(self.path).encode(word, add_special_tokens=False).ids, np.uint32)
                continue
            for rows, ids in merges(self.path)(text[starts[which][:, None] + np.arange(n)]):
                for k, x in zip(which[rows].tolist(), ids.astype(np.uint32)):
                    found[k] = x
        many = np.array([len(x) for x in found])
        at = np.searchsorted(self.keys, new)
        self.keys, self.first, self.count = np.insert(self.keys, at, new), np.insert(self.first, at, len(self.pool) + np.cumsum(many) - many), np.insert(self.count, at, many)
        self.pool = np.concatenate([self.pool, *found])

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place in pool, number of ids, row) of each pre-token in order, and rows left to the library."""
        text, starts, ends, hashes, doc, foreign = split(column)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > REMEMBERED + len(self.base[0]):
            self.keys, self.first, self.count, self.pool = self.base
        at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1) if len(self.keys) else np.zeros(len(distinct), int)
        new = np.flatnonzero(self.keys[at] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            self._learn(distinct[new], text, starts[first[new]], ends[first[new]])
            at = np.searchsorted(self.keys, distinct)
        return self.first[at][inverse], self.count[at][inverse], doc, foreign

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        _, many, doc, foreign = self.of(column)
        n = np.bincount(doc, many, len(column)).astype(np.int64)
        for k in foreign.tolist():
            n[k] = len(tokenizer(self.path).encode(column[k].as_py(), add_special_tokens=False).ids)
        return n

    def flat(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        place, many, doc, foreign = self.of(column)
        ids = self.pool[np.repeat(place - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        out = np.split(ids, np.cumsum(np.bincount(doc, many, len(column)).astype(np.int64))[:-1])
        for k in foreign.tolist():
            out[k] = np.array(tokenizer(self.path).encode(column[k].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


_KEPT: dict[str, Ids] = {}


def ids_for(path: str, whole: dict[bytes, int]) -> Ids:
    """One for all tasks that a worker process runs."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = Ids(path, whole)
    return _KEPT[path]
