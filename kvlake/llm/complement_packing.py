"""Best-fit packing by exact complements: gaps are filled by one, two or three lengths that sum to them."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pretokens, words
from .common import stored, texts


class Sums:
    """Lengths that are left (their counts) and which numbers are sums of two of them."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.there = (self.left > 0).astype(np.int64)
        n = len(counts)
        self.pairs = np.rint(np.fft.irfft(np.fft.rfft(self.there, 2 * n) ** 2, 2 * n)).astype(np.int64)[:n]  # ordered pairs of lengths by sum

    def take(self, length: int, times: int) -> None:
        self.left[length] -= times
        if not self.left[length]:
            n = len(self.there)
            self.pairs[length:] -= 2 * self.there[: n - length]
            if 2 * length < n:
                self.pairs[2 * length] += 1
            self.there[length] = 0

    def largest(self, room: int) -> int:
        """The largest length that is left and fits, 0 for none."""
        some = np.flatnonzero(self.left[: room + 1] > 0)
        return int(some[-1]) if len(some) else 0

    def _pair(self, gap: int) -> tuple[int, ...]:
        low = np.arange(1, gap // 2 + 1)
        ok = (self.left[low] > 0) & (self.left[gap - low] > 0)
        if gap % 2 == 0 and len(low) and self.left[gap // 2] < 2:
            ok[-1] = False
        at = np.flatnonzero(ok)
        return (gap - int(low[at[0]]), int(low[at[0]])) if len(at) else ()

    def filling(self, gap: int) -> tuple[int, ...]:
        """One, two or three lengths that are left and sum to the gap; the largest lengths first, as small ones fill more gaps."""
        if self.left[gap] > 0:
            return (gap,)
        if self.pairs[gap] > 0 and (found := self._pair(gap)):
            return found
        first = np.flatnonzero((self.left[1:gap] > 0) & (self.pairs[gap - 1 : 0 : -1] > 0)) + 1
        for z in first[::-1].tolist():
            self.left[z] -= 1
            found = self._pair(gap - z)
            self.left[z] += 1
            if found:
                return (z, *found)
        return ()


def planned(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """(times, lengths) of sequences that together use counts[n] pieces of each length n; the capacity is the last index.

    A sequence begins with the largest length left. While one, two or three lengths that are left sum to
    its gap, they fill it; otherwise the largest length that fits goes in (best fit), and a gap that
    nothing fits stays. The sequence is then made as often as the counts allow, so each entry leaves
    some length with fewer pieces than it takes of it. A length n stands in a sequence capacity / n times
    at most, so there are under capacity * (1 + ln capacity) entries, however many pieces there are.
    """
    sums, capacity, out = Sums(counts), len(counts) - 1, []
    while first := sums.largest(capacity):
        own, gap = [], capacity
        add: tuple[int, ...] = (first,)
        while add:
            for n in add:
                own.append(n)
                gap -= n
                sums.left[n] -= 1
            add = ()
            if gap:
                add = sums.filling(gap)
                if not add and (n := sums.largest(gap)):
                    add = (n,)
        for n in own:
            sums.left[n] += 1
        use = {n: own.count(n) for n in own}
        times = min(int(sums.left[n]) // k for n, k in use.items())
        for n, k in use.items():
            sums.take(n, times * k)
        out.append((times, own))
    return out


class Places:
    """Where the k-th piece of a length goes."""

    def __init__(self, plan: list[tuple[int, list[int]]]):
        rows, used, sequence = [], {}, 0
        for times, own in plan:
            offset = 0
            for n in own:
                at = used.get(n, 0)
                rows.append((n << 44 | at, sequence, offset, at))
                used[n], offset = at + times, offset + n
            sequence += times
        rows.sort()
        self.key, self.sequence, self.offset, self.at = (np.array(c, np.int64) for c in (zip(*rows) if rows else ((), (), (), ())))

    def __call__(self, length: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.key, length << 44 | k, side="right") - 1
        return self.sequence[row] + k - self.at[row], self.offset[row]


def cut(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): the pieces of each document's ids and end_id; only documents of more than `capacity` ids have several. nth counts a task's (part) pieces of a length."""
    whole = docs.sparkSession.sparkContext.broadcast(pretokens.whole_tokens(path))
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")

    def run(batches):
        known, end = pretokens.ids_for(path, whole.value), end_id.to_bytes(4, "little")
        part, met = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for a, z in words.pieces(batch.column("text")):
                own, rows = batch.slice(a, z - a), []
                for doc, ids in zip(own.column("doc_id").to_pylist(), known.flat(own.column("text"))):
                    body = memoryview(ids.astype("<u4").tobytes() + end)
                    total = len(body) // 4
                    for k, start in enumerate(range(0, total, capacity)):
                        n = min(capacity, total - start)
                        rows.append((doc, k, start, n, zlib.crc32(body[4 * start : 4 * (start + n)]), part, met[n]))
                        met[n] += 1
                yield pa.record_batch({c: pa.array(v, pa.int32() if c == "piece" else pa.int64()) for c, v in zip(names, zip(*rows))})

    return texts(docs).mapInArrow(run, ", ".join(f"{c} {'int' if c == 'piece' else 'long'}" for c in names))


def packed(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all rows of docs (doc_id, text), packed into few sequences.

    Texts are cut into pieces once, and pieces stored. How many there are of each length, at most
    `capacity` numbers, is all that the plan needs: it says for each length into which sequences its
    first, second, ... pieces go. A piece's number among all of its length is its number in its task plus
    those of the tasks before, so a length of any number of pieces is numbered by all tasks, and each
    finds its place in the plan, whose size the capacity bounds.

    An empty or null text is one end token; null ids and repeated rows are documents like others; an
    empty table gives no pieces; other columns are ignored.
    """
    pieces = stored(cut(docs, path, capacity, end_id))
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    places = docs.sparkSession.sparkContext.broadcast(Places(planned(counts)))

    def place(batches):
        for batch in batches:
            sequence, offset = places.value(batch.column("length").to_numpy(), batch.column("k").to_numpy())
            kept = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.record_batch(kept | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    numbered = pieces.join(by_task.select("length", "part", earlier.alias("before")), ["length", "part"])
    rows = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("k"))
    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
