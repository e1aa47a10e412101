"""Alignment of two tokenizers' tokens over the same bytes, by merge-path partitioning.

A text's tokens end at rising byte offsets, in both tokenizations, so aligning them is merging two
sorted lists. Diagonals of the merge, a fixed number of steps apart, cut it into pieces of equal work;
a binary search along each diagonal finds where its piece begins in both lists. All pieces advance
together, a step at a time, and give the ends that A and B share; a group of tokens that begins in one
piece and ends in a later one is put together from both.

Before that, both libraries encode chunks, not texts: a chunk is a run of blanks with what follows up to
the next run. Where neither tokenizer has tokens that go on from one chunk into the next, or looks at
what is around a chunk, a text's tokens are those of its chunks, and a task encodes only chunks that it
has not met yet, known by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import words
from .common import stored, texts
from .pieces import encodes_words_alone

#: Steps of a piece of the merge; bytes of text that are aligned together.
STEPS, TOGETHER = 256, 1 << 19
#: Chunks that a worker process remembers, and ids of all of them, by each vocabulary, at most; new chunks that are encoded as one text.
REMEMBERED, POOL, TIED = 1 << 19, 1 << 22, 512
BLANK = "▁"


class Shown:
    """The bytes of a vocabulary's tokens, by id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.size = tokens, np.array([len(x) for x in tokens], np.int64)
        self.at, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens) or b"\0", np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.data[np.repeat(self.at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class ByteLevel(Shown):
    """A byte-level vocabulary (.json), special strings taken as plain text; a text is encoded with a blank before it."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # such a byte is written as itself, the others as the letters from U+0100 on
        byte = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        own = json.load(open(path, encoding="utf-8"))
        vocabulary, model, before = own["model"]["vocab"], own["model"], own["pre_tokenizer"] or {}
        #: Texts are taken as they are, and the byte-level expression parts them before each run of blanks.
        self.by_chunks = model["type"] == "BPE" and not model.get("dropout") and not own["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and all(x["special"] for x in own["added_tokens"])
        tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for x, k in vocabulary.items():
            tokens[k] = bytes(byte[c] for c in x) if all(c in byte for c in x) else x.encode()
        super().__init__(tokens)

    def encode(self, some: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([" " + x for x in some], add_special_tokens=False)]


class Pieces(Shown):
    """A sentencepiece vocabulary (.model), which puts a blank before a text itself."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        super().__init__([bytes([int(x[3:5], 16)]) if self.library.is_byte(k) else x.replace(BLANK, " ").encode() for k, x in enumerate(names)])
        #: Texts are taken as they are, and no piece goes on from one run of blanks and what follows into the next.
        self.by_chunks = encodes_words_alone(self.library)

    def encode(self, some: list[str]) -> list[list[int]]:
        return self.library.encode(some, num_threads=1)


@lru_cache(maxsize=2)
def vocabularies(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    """One of each for all tasks that a worker process runs."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return ByteLevel(a), Pieces(b)


def linkable(a: ByteLevel, b: Pieces) -> np.ndarray:
    """The sorted keys (A id << 32 | B id) of all pairs that can end together: one's bytes end the other's.

    A token has as many endings as bytes, and ids of equal bytes are few, so there are not many more such
    pairs than the vocabularies have bytes.
    """
    spelled: tuple[dict[bytes, list[int]], ...] = ({}, {})
    for own, v in zip(spelled, (a, b)):
        for k, x in enumerate(v.tokens):
            if x:
                own.setdefault(x, []).append(k)
    keys = {i << 32 | j for y, many in spelled[1].items() for s in range(len(y)) for i in spelled[0].get(y[s:], ()) for j in many}
    keys |= {i << 32 | j for x, many in spelled[0].items() for s in range(1, len(x)) for j in spelled[1].get(x[s:], ()) for i in many}
    return np.array(sorted(keys), np.int64)


def cuts(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece of the merge of a and b begins in both: after d ends in order, of equal ones a's first, for every d that `steps` divides."""
    d = np.arange(0, len(a) + len(b), steps)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        more = a[mid] <= b[d[open_] - 1 - mid]
        low[open_] = np.where(more, mid + 1, low[open_])
        high[open_] = np.where(more, high[open_], mid)
    return low, d - low


def common_ends(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all a[i] = b[j], in order; both rise, and end with the same number."""
    i, j = cuts(a, b, steps)
    never = np.iinfo(np.int64).max
    a, b = np.append(a, never), np.append(b, never)
    at_i, at_j = np.full((len(i), steps), -1), np.empty((len(i), steps), np.int64)
    for k in range(steps):
        x, y = a[i], b[j]
        same = (x == y) & (x != never)
        at_i[:, k], at_j[:, k] = np.where(same, i, -1), j
        first = (x <= y) & (x != never)
        i, j = i + first, j + (~first & (y != never))
    met = at_i >= 0
    return at_i[met], at_j[met]


@dataclass
class Aligned:
    """Texts' tokens, one after the other: ids, how many each text has, and the places (in ids) of the pairs that end together, in order."""

    a: np.ndarray
    b: np.ndarray
    many_a: np.ndarray
    many_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    @property
    def links(self) -> np.ndarray:
        """How many links each text has."""
        return np.diff(np.searchsorted(self.link_a, np.concatenate(([0], np.cumsum(self.many_a)))))


def solid(data: np.ndarray) -> np.ndarray:
    """Of each place in data, its end too: whether what ends there is surely no white space."""
    before, two, three = (np.concatenate([np.zeros(k, np.uint8), data])[: len(data) + 1] for k in (1, 2, 3))
    wide = (before >= 0x80) & (two != 0xC2) & ((three < 0xE1) | (three > 0xE3))  # white space beyond ASCII has two bytes from C2 on, or three from E1 to E3 on
    return (before > ord(" ")) & (before < 0x7F) | wide


def chunk_starts(data: np.ndarray, begins: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where each chunk begins: at a text's first byte (data begins a text at each of `begins`), and at blanks after what is no white space, but for one that ends a text."""
    cut = (data == ord(" ")) & solid(data)[:-1]
    cut[begins + size - 1] = False
    cut[begins] = True
    return np.flatnonzero(cut)


class Chunks:
    """The ids of chunks by both vocabularies, as they are met."""

    def __init__(self, *both: Shown):
        self.both = both
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.keys, self.good = none.astype(np.uint64), none.astype(bool)
        self.first, self.many, self.pool = ([none, none] for _ in range(3))

    def _encoded(self, v: Shown, spelled: list[bytes], joined: list[np.ndarray], alone: list[int]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """(which chunks, in the order of their ids; how many ids each has; all ids; whether they give each chunk back). Groups of chunks that are encoded as one text are parted where their bytes end, unless v does not give them back."""
        order, many, ids, alone = [], [], [], [*alone]
        for group, found in zip(joined, v.encode([b"".join(spelled[k] for k in g.tolist())[1:].decode() for g in joined])):
            own = np.array(found, np.int64)
            ends, want = np.cumsum(v.size[own]), np.cumsum([len(spelled[k]) for k in group.tolist()])
            at = np.searchsorted(ends, want)
            if len(own) and ends[-1] == want[-1] and np.array_equal(ends[at], want) and v.joined(own).tobytes() == b"".join(spelled[k] for k in group.tolist()):
                order += group.tolist()
                many.append(np.diff(at, prepend=-1))
                ids.append(own)
            else:
                alone += group.tolist()
        good = np.ones(len(spelled), bool)
        for k, found in zip(alone, v.encode([spelled[k][1:].decode() for k in alone])):
            order.append(k)
            many.append(np.array([len(found)]))
            ids.append(np.array(found, np.int64))
            good[k] = v.joined(ids[-1]).tobytes() == spelled[k]
        none = np.zeros(0, np.int64)
        return order, np.concatenate([none, *many]), np.concatenate([none, *ids]), good

    def _learn(self, new: np.ndarray, spelled: list[bytes], solid: np.ndarray) -> None:
        at, good, apart = np.searchsorted(self.keys, new), np.ones(len(new), bool), np.flatnonzero(solid)
        joined = [apart[k : k + TIED] for k in range(0, len(apart), TIED)]
        for k, v in enumerate(self.both):
            order, own, ids, whole = self._encoded(v, spelled, joined, np.flatnonzero(~solid).tolist())
            first, many = np.empty((2, len(new)), np.int64)
            first[order], many[order] = len(self.pool[k]) + np.cumsum(own) - own, own
            self.first[k], self.many[k] = np.insert(self.first[k], at, first), np.insert(self.many[k], at, many)
            self.pool[k] = np.concatenate([self.pool[k], ids])
            good &= whole
        self.keys, self.good = np.insert(self.keys, at, new), np.insert(self.good, at, good)

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(ids of all chunks, how many of each chunk, both by both vocabularies; whether both give the chunk back byte by byte)."""
        distinct, first, inverse = np.unique(words.span_hashes(words._values(False)[data], starts), return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > REMEMBERED or max(map(len, self.pool)) > POOL:
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        new[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] != distinct[at < len(self.keys)]
        if new.any():
            ends = np.append(starts, len(data))
            ends = ends[first[new] + 1]
            self._learn(distinct[new], [data[a:z].tobytes() for a, z in zip(starts[first[new]].tolist(), ends.tolist())], solid(data)[ends])
            at = np.searchsorted(self.keys, distinct)
        at = at[inverse]
        ids, counts = [], []
        for k in (0, 1):
            many = self.many[k][at]
            ids.append(self.pool[k][np.repeat(self.first[k][at] - (np.cumsum(many) - many), many) + np.arange(many.sum())])
            counts.append(many)
        return ids, counts, self.good[at]


@lru_cache(maxsize=2)
def chunks(va: ByteLevel, vb: Pieces) -> Chunks:
    """One for all tasks that a worker process runs."""
    return Chunks(va, vb)


def aligned(column: pa.Array, va: ByteLevel, vb: Pieces, steps: int = STEPS) -> Aligned:
    """Of a column without nulls; texts that are empty or that one of the two does not give back byte by byte have no tokens."""
    data, offsets = words.utf8(column)
    rows = len(column)
    size = np.diff(offsets) + 1
    there = size > 1
    spaced = np.full(len(data) + rows, ord(" "), np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(rows), size - 1) + 1] = data
    begins = np.cumsum(size) - size
    doubtful = there.copy()
    if va.by_chunks and vb.by_chunks and rows:
        starts = chunk_starts(spaced, begins, size)
        ids, counts, good = chunks(va, vb)(spaced, starts)
        row = np.searchsorted(begins, starts, side="right") - 1
        many = [np.bincount(row, n, rows).astype(np.int64) for n in counts]
        doubtful = there & (np.bincount(row[~good], minlength=rows) > 0)
    else:
        some = column.to_pylist()
        lists = [v.encode(some) for v in (va, vb)]
        many = [np.array([len(x) for x in own], np.int64) for own in lists]
        ids = [np.fromiter(chain.from_iterable(own), np.int64, int(n.sum())) for own, n in zip(lists, many)]
    for v, own, n in zip((va, vb), ids, many):
        last = np.cumsum(n)
        for k in np.flatnonzero(doubtful).tolist():
            there[k] &= np.array_equal(v.joined(own[last[k] - n[k] : last[k]]), spaced[begins[k] : begins[k] + size[k]])
    (a, b), (many_a, many_b) = (x[np.repeat(there, n)] for x, n in zip(ids, many)), (np.where(there, n, 0) for n in many)
    link_a, link_b = common_ends(np.cumsum(va.size[a]), np.cumsum(vb.size[b]), steps)
    return Aligned(a, b, many_a, many_b, link_a, link_b)


@lru_cache(maxsize=2)
def _decimals(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """How many digits each number of so many bits has, and the digits, with zero bytes up to one place more than the longest has."""
    n = np.arange(1 << bits)
    digits = np.searchsorted(10 ** np.arange(1, 19), n, side="right") + 1
    out = np.zeros((len(n), int(digits.max()) + 1), np.uint8)
    for k in range(out.shape[1] - 1):
        out[:, k] = np.where(k < digits, n // 10 ** np.maximum(digits - 1 - k, 0) % 10 + ord("0"), 0)
    return digits, out


def _written(x: Aligned) -> Iterator[bytes]:
    """Each text's groups: ids of A by commas, a bar, ids of B by commas; a semicolon between groups."""
    runs_a, runs_b = np.diff(x.link_a, prepend=-1), np.diff(x.link_b, prepend=-1)
    at_a = np.arange(len(x.a)) + np.repeat(x.link_b + 1 - runs_b, runs_a)
    at_b = np.arange(len(x.b)) + np.repeat(x.link_a + 1, runs_b)
    ids, ends = np.empty(len(x.a) + len(x.b), np.int64), np.full(len(x.a) + len(x.b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = x.a, x.b
    ends[at_a[x.link_a]], ends[at_b[x.link_b]] = ord("|"), ord(";")
    digits, spelled = _decimals(max(16, int(ids.max(initial=0)).bit_length()))
    out, digits = spelled[ids], digits[ids]
    out[np.arange(len(ids)), digits] = ends
    data = out[out != 0].tobytes()
    token = np.concatenate(([0], np.cumsum(digits + 1)))
    at = token[np.concatenate(([0], np.cumsum(x.many_a + x.many_b)))].tolist()
    for start, stop in zip(at, at[1:]):
        yield data[start : max(start, stop - 1)]


def _each(batches, a: str, b: str):
    va, vb = vocabularies(a, b)
    for batch in batches:
        for start, stop in words.pieces(batch.column("text"), TOGETHER):
            part = batch.slice(start, stop - start)
            yield part, aligned(part.column("text"), va, vb)


def _lists(values: np.ndarray, many: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), pa.array(values.astype(np.int32)))


def groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_ends, b_ends): both tokenizations of each text of docs (doc_id, text), and where in them each group ends (the first token beyond it).

    Tokens are those of " " + text, in A (a byte-level .json) as in B (a sentencepiece .model, which adds
    the blank). A group ends wherever a token of A and one of B end at the same byte. Texts that are null,
    empty, or not given back byte by byte by both have no tokens; null ids and repeated rows are kept; an
    empty table gives an empty result; other columns are ignored.
    """

    def run(batches):
        for part, x in _each(batches, a, b):
            before_a, before_b = (np.repeat(np.cumsum(n) - n, x.links) for n in (x.many_a, x.many_b))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "a_ids": _lists(x.a, x.many_a), "b_ids": _lists(x.b, x.many_b), "a_ends": _lists(x.link_a + 1 - before_a, x.links), "b_ends": _lists(x.link_b + 1 - before_b, x.links)})

    return texts(docs).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n) from rows with arrays of pair numbers (links): how often each occurs. A task adds up its own in a table as long as the pairs it met."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(batch.column("links").flatten().to_numpy(), minlength=len(total))
            own[: len(total)] += total
            total = own
        met = np.flatnonzero(total)
        yield pa.record_batch({"pair": pa.array(met.astype(np.int32)), "n": pa.array(total[met])})

    return linked.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment_counts(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text of docs (doc_id, text).

    A link is a token of A and one of B that end at the same byte. Its count is how often its two ids
    are linked in all texts; n_best counts links whose count no other A id has more of with the same B
    id. Only ids of which one's bytes end the other's can be linked, and those pairs are known from the
    vocabularies alone; so links are stored as numbers of pairs, and the table of counts, no longer than
    the vocabularies' bytes or so, goes to the driver and to every task, and no link is shuffled.

    Texts without tokens (see `groups`) have zeros and an empty digest; null ids and repeated rows are
    counted like others; an empty table gives an empty result; other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    keys = linkable(*vocabularies(a, b))
    known = context.broadcast(keys)

    def link(batches):
        for part, x in _each(batches, a, b):
            pair = np.searchsorted(known.value, x.a[x.link_a] << 32 | x.b[x.link_b])
            digest = [hashlib.sha256(t).hexdigest() if t else "" for t in _written(x)]
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_a": pa.array(x.many_a), "n_b": pa.array(x.many_b), "links": _lists(pair, x.links), "groups_sha256": pa.array(digest, pa.string())})

    linked = stored(texts(docs).mapInArrow(link, "doc_id long, n_a long, n_b long, links array<int>, groups_sha256 string"))
    count = np.zeros(len(keys), np.int64)
    for pair, n in pair_counts(linked).toLocalIterator():  # no more rows than keys
        count[pair] = n
    most = np.zeros(int((keys & 0xFFFFFFFF).max(initial=0)) + 1, np.int64)
    np.maximum.at(most, keys & 0xFFFFFFFF, count)
    counted = context.broadcast((count, count == most[keys & 0xFFFFFFFF]))

    def judge(batches):
        count, best = counted.value
        for batch in batches:
            links = batch.column("links")
            flat = links.flatten().to_numpy()
            many = np.diff(links.offsets.to_numpy())
            row = np.repeat(np.arange(len(links)), many)
            sums = np.zeros((2, len(links)), np.int64)
            np.add.at(sums[0], row, best[flat])
            np.add.at(sums[1], row, count[flat])
            own = {c: batch.column(c) for c in ("doc_id", "n_a", "n_b")}
            n = pa.array(many.astype(np.int64))
            yield pa.record_batch(own | {"n_groups": n, "n_links": n, "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]), "groups_sha256": batch.column("groups_sha256")})

    return linked.mapInArrow(judge, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
