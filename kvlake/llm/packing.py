"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import pretokens, words
from .common import texts

#: Tokens that one group of documents is packed from; groups follow the input, so that no text is shuffled.
GROUP = 1 << 21


def balanced(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int]]:
    """(document, start, length, sequence) pieces of a group's documents, in order of placement.

    A document's full runs of `capacity` tokens are sequences of their own. The rests go by descending
    estimated cost (linear in tokens plus quadratic in attention) each to the sequence of lowest cost
    that has room. Rests that no sequence has room for are cut to fill those rooms, lowest cost first,
    and what is then left (under one capacity) becomes sequences of powers of two, which need no padding.
    """
    out, at = [], 0
    for d in np.flatnonzero(lengths >= capacity):
        for start in range(0, int(lengths[d]) - capacity + 1, capacity):
            out.append((int(d), start, capacity, at))
            at += 1
    rest = lengths % capacity
    cost_of = linear * rest + quadratic * rest.astype(float) ** 2
    n = int(rest.sum()) // capacity
    room, cost, spare = np.full(n, capacity, np.int64), np.zeros(n), []
    for d in np.argsort(-cost_of, kind="stable"):
        r = int(rest[d])
        if not r:
            continue
        best = int(np.argmin(np.where(room >= r, cost, np.inf))) if n else 0
        if n and room[best] >= r:
            out.append((int(d), int(lengths[d]) - r, r, at + best))
            room[best] -= r
            cost[best] += cost_of[d]
        else:
            spare.append((int(d), int(lengths[d]) - r, r))
    gaps = [(at + int(k), int(room[k])) for k in np.argsort(cost, kind="stable") if room[k]]
    left = sum(r for _, _, r in spare) - sum(g for _, g in gaps)
    gaps += [(at + n + k, 1 << b) for k, b in enumerate(b for b in range(capacity.bit_length(), -1, -1) if left >> b & 1)]
    gaps.reverse()
    for d, start, r in spare:
        while r:
            seq, gap = gaps.pop()
            take = min(r, gap)
            out.append((d, start, take, seq))
            start, r = start + take, r - take
            if gap > take:
                gaps.append((seq, gap - take))
    return out


def packed(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, group: int = GROUP) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows of docs (doc_id, text).

    A document is its token ids and then end_id, so an empty or null text is one token. Documents are
    packed in groups of about `group` tokens, as a task reads them; all sequences are full but at most
    log2(capacity) of a group, whose lengths are powers of two. Each id is in exactly one piece.
    sequence_id is the task's partition and the sequence's number in it. Null ids and repeated rows are
    documents like others; an empty table gives no pieces; other columns are ignored.
    """
    whole = docs.sparkSession.sparkContext.broadcast(pretokens.whole_tokens(path))

    def run(batches):
        known = pretokens.ids_for(path, whole.value)
        end = end_id.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40
        names, bodies, held = [], [], 0

        def flush():
            nonlocal sequence
            lengths = np.array([len(b) // 4 for b in bodies], np.int64)
            pieces = balanced(lengths, capacity)
            offsets: dict[int, int] = {}
            rows = []
            for d, start, n, seq in pieces:
                offset = offsets.get(seq, 0)
                offsets[seq] = offset + n
                rows.append((names[d], start, n, zlib.crc32(memoryview(bodies[d])[4 * start : 4 * (start + n)]), int(lengths[d]), sequence + seq, offset))
            sequence += len(offsets)
            names.clear()
            bodies.clear()
            kinds = zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), zip(*rows))
            return pa.record_batch({k: pa.array(v, pa.int64()) for k, v in kinds})

        for batch in batches:
            for a, z in words.pieces(batch.column("text")):
                part = batch.slice(a, z - a)
                for name, ids in zip(part.column("doc_id").to_pylist(), known.flat(part.column("text"))):
                    bodies.append(ids.astype("<u4").tobytes() + end)
                    names.append(name)
                    held += len(ids) + 1
                    if held >= group:
                        yield flush()
                        held = 0
        if names:
            yield flush()

    kinds = ", ".join(f"{c} long" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
    return texts(docs).mapInArrow(run, kinds)
