"""Encoding and decoding with a sentencepiece vocabulary by batched Viterbi in numpy.

Distinct words of equal length advance together. All their substrings are hashed at once and probed in
the sorted keys of the pieces; for each end, a vectorised maximum over the starts picks the last piece
of the best path so far and stores it with its backpointer.

The vocabularies served are BPE ones, whose scores are merge ranks: their best sum is another
segmentation than the library's. So a step is worth nothing if merging would leave its piece and the
one before as they are, and is refused if a merge would cross the border between them. Of a prefix
exactly one path is left then, the library's. Models of other kinds are left to the library.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from . import words
from .common import texts

BLANK = "▁"
_find = regex.compile(f"{BLANK}+[^{BLANK}]*").findall
#: Characters of the longest word that is segmented here; longer ones go to the library. Distinct words that a task remembers.
LONGEST, REMEMBERED = 128, 1 << 18
#: Table entries of a batch of words; pairs of pieces whose legality a task remembers; slots that tell which hashes may be pieces'.
CELLS, PAIRS, SLOTS = 1 << 18, 1 << 20, 1 << 20
BASE = 0x9E3779B97F4A7C15
#: Fixed value: how a model says that it is a BPE one.
BPE = 2
NEVER = np.int64(1 << 40)


def _fields(message: bytes):
    """(number, value) of a protocol buffer's fields: numbers as int, others as bytes."""

    def number():
        nonlocal at
        out = shift = 0
        while True:
            b = message[at]
            at, out, shift = at + 1, out | (b & 127) << shift, shift + 7
            if b < 128:
                return out

    at = 0
    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, message[at : at + size]
            at += size


def encodes_words_alone(library: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether a BPE model takes texts as they are, puts one blank first, and has no piece that goes on beyond a word: then words can be encoded by themselves."""
    fields = [*_fields(library.serialized_model_proto())]
    model = dict(fields)  # 2: trainer, 3: normaliser
    trainer, normaliser = dict(_fields(model.get(2, b""))), dict(_fields(model.get(3, b"")))
    plain_text = not normaliser.get(2, b"") and normaliser.get(3, 1) == 1 and normaliser.get(4, 1) == 0 and normaliser.get(5, 1) == 1
    own = {dict(_fields(x)).get(3, 1) for f, x in fields if f == 1}
    plain = (k for k in range(library.get_piece_size()) if not (library.is_byte(k) or library.is_control(k) or library.is_unknown(k) or library.is_unused(k)))
    return trainer.get(3) == BPE and plain_text and 4 not in own and not any(BLANK in library.id_to_piece(k).lstrip(BLANK) for k in plain)


class Vocabulary:
    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = dict(_fields(self.library.serialized_model_proto()))  # 2: trainer, 3: normaliser
        self.kind = dict(_fields(model.get(2, b""))).get(3)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(k) for k in range(n)]
        self.bytes_at = {int(x[3:5], 16): k for k, x in enumerate(names) if self.library.is_byte(k)}
        plain = [k for k in range(n) if not (self.library.is_byte(k) or self.library.is_control(k) or self.library.is_unknown(k) or self.library.is_unused(k))]
        self.unknown = self.library.unk_id()
        #: Texts are taken as they are, blanks become the mark and one stands first, and no piece goes on beyond a word: words can be encoded by themselves. Else the library encodes whole texts.
        self.by_words = encodes_words_alone(self.library)
        shown = [b"" if self.library.is_control(k) else bytes([int(x[3:5], 16)]) if self.library.is_byte(k) else " ⁇ ".encode() if k == self.unknown else x.replace(BLANK, " ").encode() for k, x in enumerate(names)]
        self.shown_size = np.array([len(x) for x in shown])
        self.shown_at, self.shown = np.cumsum(self.shown_size) - self.shown_size, np.frombuffer(b"".join(shown), np.uint8)
        # handles: pieces in the order of their keys, then characters that are no pieces, then any other character
        chars = sorted({c for k in plain for c in names[k]} - {names[k] for k in plain})
        all_names, self.widest = [names[k] for k in plain] + chars, max((len(names[k]) for k in plain), default=1)
        hashes, order = np.array([self._hash(x) for x in all_names], np.uint64), np.arange(len(all_names))
        order[: len(plain)] = np.argsort(hashes[: len(plain)])
        self.key, self.pieces = np.append(hashes[order], np.uint64(1)), len(plain)
        self.maybe = np.zeros(SLOTS, bool)
        self.maybe[(self.key[: self.pieces] >> np.uint64(44)).astype(np.int64)] = True
        self.pairs, self.fits = np.full(PAIRS, -1), np.zeros(PAIRS, bool)
        self.size = np.array([len(all_names[k]) for k in order] + [1])
        self.power = np.array([pow(BASE, k, 1 << 64) for k in range(self.widest + 1)], np.uint64)
        self.ids = np.array([plain[k] if k < len(plain) else -1 for k in order] + [-1], np.int64)
        self.score = np.array([self.library.get_score(plain[k]) if k < len(plain) else 0.0 for k in order] + [0.0])
        self.other = len(order)
        if self.by_words:
            self.rank = np.where(self.size > 1, np.argsort(np.argsort(-self.score, kind="stable"), kind="stable"), -1)
            self.left, self.right = self._parts([all_names[k] for k in order])

    @staticmethod
    def _letters(points: np.ndarray) -> np.ndarray:
        x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def _hash(self, text: str) -> int:
        h = 0
        for x in self._letters(np.frombuffer(text.encode("utf-32-le"), "<u4")).tolist():
            h = (h * BASE + x) % (1 << 64)
        return h

    def _probe(self, hashes: np.ndarray) -> np.ndarray:
        """Handles of the pieces with these hashes, -1 for none."""
        out = np.full(hashes.shape, -1)
        some = np.nonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        own = hashes[some]
        at = np.minimum(np.searchsorted(self.key[: self.pieces], own), self.pieces - 1)
        out[some] = np.where(self.key[at] == own, at, -1)
        return out

    def _parts(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Handles of the two parts that merging joins last to get each piece; -1 where it has one character or merging does not end at it."""
        left, right = np.full(self.other + 1, -1), np.full(self.other + 1, -1)
        single = {x: k for k, x in enumerate(names) if len(x) == 1}
        for size in range(2, self.widest + 1):
            own = np.flatnonzero(self.size[: self.pieces] == size)
            if not len(own):
                continue
            seq = np.array([[single[c] for c in names[k]] for k in own])
            live = np.arange(len(own))
            while len(live) and seq.shape[1] > 1:
                if seq.shape[1] == 2:
                    done = self._joined(seq[:, 0], seq[:, 1]) == own[live]
                    left[own[live[done]]], right[own[live[done]]] = seq[done, 0], seq[done, 1]
                    break
                new = self._joined(seq[:, :-1], seq[:, 1:])
                pick = np.argmin(np.where(new >= 0, self.rank[new], NEVER), 1)
                ok = new[np.arange(len(live)), pick] >= 0
                live, seq, new, pick = live[ok], seq[ok], new[ok], pick[ok]
                seq[np.arange(len(live)), pick] = new[np.arange(len(live)), pick]
                column = np.arange(seq.shape[1] - 1)
                seq = np.take_along_axis(seq, column + (column > pick[:, None]), 1)
        return left, right

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Handles of the pieces that a and b make together, -1 for none."""
        size = self.size[a] + self.size[b]
        found = self._probe(self.key[a] * self.power[self.size[b]] + self.key[b])
        return np.where((size <= self.widest) & (a != self.other) & (b != self.other), found, -1)

    def legal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of a piece a and a piece b after it ends with these two.

        Merges come in the order of their ranks. From the last one back, each side is taken apart at its
        border; a merge crosses the border if some pair that stood there makes a piece of a better rank
        than those by which its two members went into larger pieces, the leftmost of equals first.
        """
        out = np.ones(len(a), bool)
        out &= ((self.left[a] >= 0) | (self.size[a] == 1)) & ((self.left[b] >= 0) | (self.size[b] == 1))
        live = np.flatnonzero(out)
        x, y = a[live], b[live]
        over_x, over_y = np.full(len(live), NEVER), np.full(len(live), NEVER)
        while len(live):
            new = self._joined(x, y)
            rank = self.rank[new]
            crossed = (new >= 0) & (rank < over_x) & (rank <= over_y) & ((rank < NEVER) | (over_y < NEVER))
            out[live[crossed]] = False
            on = ~crossed & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            live, x, y, over_x, over_y = live[on], x[on], y[on], over_x[on], over_y[on]
            first = self.rank[x] > self.rank[y]
            over_x, over_y = np.where(first, self.rank[x], over_x), np.where(first, over_y, self.rank[y])
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return out

    def _legal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """legal(a, b), remembered: each pair has one slot, where a later one may take its place."""
        pair = a * (self.other + 1) + b
        slot = ((pair.astype(np.uint64) * np.uint64(BASE)) >> np.uint64(44)).astype(np.int64)
        out, new = self.fits[slot], np.flatnonzero(self.pairs[slot] != pair)
        if len(new):
            out[new] = fits = self.legal(a[new], b[new])
            self.pairs[slot[new]], self.fits[slot[new]] = pair[new], fits
            # of several pairs with one slot the last has it; its own result must stand there too
            last = np.flatnonzero(self.pairs[slot[new]] == pair[new])
            self.fits[slot[new[last]]] = fits[last]
        return out

    def _tables(self, some: list[str]) -> np.ndarray:
        """The handle of each word's substrings by start and length - 1; -1 where it is no piece. All words have one length."""
        n, size = len(some), len(some[0])
        letters = self._letters(np.frombuffer("".join(some).encode("utf-32-le"), "<u4").reshape(n, size))
        wide = min(self.widest, size)
        place, run = np.full((n, size, wide), -1), np.zeros((n, size), np.uint64)
        for k in range(wide):
            run = run[:, : size - k] * np.uint64(BASE) + letters[:, k:]
            place[:, : size - k, k] = self._probe(run)
        return place

    def viterbi(self, some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, end, handle) of the pieces of the best path of each word, in order. All words have one length."""
        place = self._tables(some)
        n, size, wide = place.shape
        best, back, last = np.full((n, size + 1), -np.inf), np.zeros((n, size + 1), np.int64), np.full((n, size + 1), self.other)
        best[:, 0] = 0
        for end in range(1, size + 1):
            start = np.arange(max(0, end - wide), end)
            step = place[:, start, end - start - 1]
            known = step >= 0
            known[:, -1] = True  # a character without a piece stands alone
            row, col = np.nonzero(known)
            piece = step[row, col]
            piece = np.where(piece < 0, self.other, piece)
            before = last[row, start[col]]
            inner = np.flatnonzero(start[col] > 0)
            fits = (self.left[piece] >= 0) | (self.size[piece] == 1)
            fits[inner] &= self._legal(before[inner], piece[inner])
            total = np.full(step.shape, -np.inf)
            total[row, col] = np.where(fits, best[row, start[col]], -np.inf)
            pick = np.argmax(total, 1)
            own = np.arange(n)
            best[:, end], back[:, end] = total[own, pick], start[pick]
            last[:, end] = np.where(step[own, pick] < 0, self.other, step[own, pick])
        used, at, live = np.zeros((n, size + 1), bool), np.full(n, size), np.arange(n)
        while len(live):
            used[live, at] = True
            at = back[live, at]
            live, at = live[at > 0], at[at > 0]
        word, end = np.nonzero(used)
        return word, end, last[word, end]

    def encoded(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        many, found, odd = np.zeros(len(some), np.int64), [], {}
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(some):
            by_length.setdefault(len(w), []).append(k)
        for size, which in by_length.items():
            if size > LONGEST:
                odd.update((k, self.whole(some[k][1:])) for k in which)
                continue
            most = 1 + CELLS // (size * min(size, self.widest))
            for a in range(0, len(which), most):
                part = which[a : a + most]
                word, end, handle = self.viterbi([some[k] for k in part])
                ids, own = self.ids[handle], np.array(part)
                for r in np.unique(word[ids < 0]).tolist():  # a character without a piece is written as its bytes, or a run of such ones as unknown
                    fixed: list[int] = []
                    for x, z in zip(ids[word == r].tolist(), end[word == r].tolist()):
                        more = [x] if x >= 0 else self._fallback(some[part[r]][z - 1])
                        fixed += more if more != [self.unknown] or fixed[-1:] != more else []
                    odd[part[r]] = np.array(fixed, np.uint32)
                count = np.bincount(word, minlength=len(part))
                many[own] = count
                found.append((own[word], np.arange(len(word)) - (np.cumsum(count) - count)[word], ids))
        for k, x in odd.items():
            many[k] = len(x)
        first = np.cumsum(many) - many
        out = np.zeros(many.sum() + 1, np.uint32)
        is_odd = np.zeros(len(some), bool)
        is_odd[list(odd)] = True
        for word, at, ids in found:
            out[np.where(is_odd[word], len(out) - 1, first[word] + at)] = ids.astype(np.uint32)
        for k, x in odd.items():
            out[first[k] : first[k] + len(x)] = x
        return out[:-1], many

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes_at[b] for b in char.encode()] if self.bytes_at else [self.unknown]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text), np.uint32)

    def decoded(self, ids: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all texts, offsets): ids of texts of so many ids each, as bytes without the blank that stands first."""
        size = self.shown_size[ids]
        offsets = np.concatenate(([0], np.cumsum(size)))
        data = self.shown[np.repeat(self.shown_at[ids] - offsets[:-1], size) + np.arange(offsets[-1])]
        offsets = offsets[np.concatenate(([0], np.cumsum(many)))]
        full = offsets[:-1] < offsets[1:]
        first = offsets[:-1][full]
        drop = first[data[first] == ord(" ")]
        gone = np.zeros(len(offsets), np.int64)
        gone[1:] = np.cumsum(np.isin(offsets[:-1], drop) & full)
        return np.delete(data, drop), offsets - gone


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts, remembering words by their hashes up to a bound."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first, self.count, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _known(self, distinct: np.ndarray, spell) -> np.ndarray:
        """Places of words, by hash, in the tables; spell(which) gives the words of those not yet met."""
        if len(self.keys) + len(distinct) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        new = np.flatnonzero((at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != distinct)) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            ids, many = self.v.encoded(spell(new))
            at = np.searchsorted(self.keys, distinct[new])
            self.keys, self.first, self.count = np.insert(self.keys, at, distinct[new]), np.insert(self.first, at, len(self.pool) + np.cumsum(many) - many), np.insert(self.count, at, many)
            self.pool = np.concatenate([self.pool, ids])
        return np.searchsorted(self.keys, distinct)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        data, offsets = words.utf8(column)
        size = np.diff(offsets)
        apart = np.zeros(len(column), bool)  # texts that are not words with one blank between them
        row_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
        if len(data) > 2:
            apart[row_of(np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)))] = True
        blank = data == 0x20
        apart[row_of(np.flatnonzero(blank[:-1] & blank[1:]))] = True
        full = np.flatnonzero(size)
        apart[full] |= blank[offsets[full]] | blank[offsets[full + 1] - 1]
        if not self.v.by_words:
            apart[:] = True
        begins = np.zeros(len(data), bool)
        begins[offsets[full]] = True
        begins[1:] |= blank[:-1]
        starts = np.flatnonzero(begins)
        doc = row_of(starts)
        starts, doc = starts[~apart[doc]], doc[~apart[doc]]
        stops = np.flatnonzero(np.concatenate([blank, [True]]))
        ends = np.minimum(stops[np.searchsorted(stops, starts)], offsets[doc + 1])
        hashes = words.span_hashes(np.where(blank, np.uint64(0), words._values(False)[data]), starts) if len(starts) else np.zeros(0, np.uint64)
        if len(starts) and apart.any():  # a span must not run on into a text that is left out
            hashes = words.span_hashes(np.where(blank | np.repeat(apart, size), np.uint64(0), words._values(False)[data]), starts)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        spell = lambda new: [BLANK + data[a:z].tobytes().decode() for a, z in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
        at = self._known(distinct, spell)[inverse] if len(distinct) else np.zeros(0, np.int64)
        place, many = self.first[at], self.count[at]
        ids = self.pool[np.repeat(place - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        count = np.bincount(doc, many, len(column)).astype(np.int64)
        odd = np.flatnonzero(apart)
        if len(odd):
            parts = np.split(ids, np.cumsum(count)[:-1])
            for k in odd.tolist():
                parts[k] = self._odd(data[offsets[k] : offsets[k + 1]].tobytes().decode())
                count[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, count

    def _odd(self, text: str) -> np.ndarray:
        if not self.v.by_words or not text:
            return self.v.whole(text)
        own = _find(BLANK + text.replace(" ", BLANK))
        distinct, inverse = np.unique(np.array(own, object), return_inverse=True)
        ids, many = self.v.encoded(distinct.tolist())
        parts = np.split(ids, np.cumsum(many)[:-1])
        return np.concatenate([parts[k] for k in inverse.tolist()])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for all tasks that a worker process runs."""
    return Encoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the piece ids of each whole text of docs (doc_id, text), without begin or end, as the library gives them.

    An empty or null text has none; null ids and repeated rows are kept; an empty table gives an empty
    result; other columns are ignored. Models that are not BPE ones, change texts before
    encoding, or have pieces beyond a word or of the user's own are left to the library, text by text.
    """

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for a, z in words.pieces(batch.column("text")):
                ids, many = coder(batch.column("text").slice(a, z - a))
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, z - a), "ids": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), pa.array(ids.astype(np.int32)))})

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): the inverse of encode but for what the vocabulary cannot tell apart (U+2581 and blank). Null ids give a null text, ids outside the vocabulary count as unknown; bytes that are no UTF-8 become U+FFFD; an empty table gives an empty result; null doc_ids and repeated rows are kept; other columns are ignored."""

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            out = []
            for x in batch.column("ids").to_pylist():
                if x is None:
                    out.append(None)
                    continue
                ids = np.array([v.unknown if k is None else k for k in x], np.int64)
                data, _ = v.decoded(np.where((ids < 0) | (ids >= len(v.shown_size)), v.unknown, ids), np.array([len(ids)]))
                out.append(data.tobytes().decode("utf-8", "replace"))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(out, pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_crc32, round_trip): encode and decode of each whole text in one pass, as numbers.

    crc32 over ids as little-endian 32-bit numbers and over the decoded text's UTF-8; round_trip is whether
    decoding gives the text. An empty or null text has no pieces, crc32 0 and a round trip; null ids and
    repeated rows are kept; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for a, z in words.pieces(batch.column("text")):
                part = batch.column("text").slice(a, z - a)
                ids, many = coder(part)
                back, at = coder.v.decoded(ids, many)
                data, offsets = words.utf8(part)
                raw, cut = memoryview(ids.astype("<u4").tobytes()), 4 * np.concatenate(([0], np.cumsum(many)))
                texts_, backs, at, offsets, cut = memoryview(data.tobytes()), memoryview(back.tobytes()), at.tolist(), offsets.tolist(), cut.tolist()
                rows = range(z - a)
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(a, z - a), "n_pieces": pa.array(many, pa.int64()), "ids_crc32": pa.array([zlib.crc32(raw[cut[k] : cut[k + 1]]) for k in rows], pa.int64()),
                    "decoded_crc32": pa.array([zlib.crc32(backs[at[k] : at[k + 1]]) for k in rows], pa.int64()), "round_trip": pa.array([backs[at[k] : at[k + 1]] == texts_[offsets[k] : offsets[k + 1]] for k in rows], pa.bool_()),
                })

    return texts(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
