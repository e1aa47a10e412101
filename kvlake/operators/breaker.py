"""A passive circuit breaker for each node, as a state machine that blocks of requests can be composed of.

Closed: requests pass, and `failures` failed ones in a row open it. Open: requests are rejected for
`pause` seconds. Half-open: requests pass as probes; `probes` good ones in a row close it, a failed one
opens it again.

States are numbers: below `failures` closed, with so many failures; then half-open, with so many good
probes; from there on open, plus the second at which it ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .ordered import PART, ranged


@dataclass(frozen=True)
class Rules:
    failures: int = 3
    probes: int = 2
    pause: int = 30

    @property
    def half(self) -> int:
        return self.failures

    @property
    def open(self) -> int:
        return self.failures + self.probes

    def step(self, state: int, ok: bool, sec: int) -> tuple[int, bool]:
        """(state after a request, whether it passed)."""
        if state >= self.open:
            if sec < state - self.open:
                return state, False
            state = self.half
        if state < self.half:
            state = 0 if ok else state + 1
            return (self.open + sec + self.pause if state == self.failures else state), True
        if not ok:
            return self.open + sec + self.pause, True
        return (state + 1 if state + 1 < self.open else 0), True

    def name(self, state: int, sec: int) -> str:
        """The state at a second: an open breaker whose pause is over is half-open."""
        return "closed" if state < self.half else "half_open" if state < self.open or sec >= state - self.open else "open"


def table_of(sec: np.ndarray, ok: np.ndarray, rules: Rules) -> tuple[list[int], list[int], list[int]]:
    """What a block of requests makes of any state before it: (states after it by closed or half-open state before it, bounds, states after it for open ones).

    An open state that ends at second u has become half-open at the first request from u on, so its result
    is that of half-open there; results are worked out from the last request back, and runs of equal ones are
    one entry: that of u is the first whose bound is not below u. Beyond all bounds the state stays.
    """
    n, finite = len(sec), rules.open
    jump = np.searchsorted(sec, sec + rules.pause, side="left").tolist()
    secs, oks = sec.tolist(), ok.tolist()
    after, half = list(range(finite)), [0] * n
    for i in range(n - 1, -1, -1):
        now = []
        for s in range(finite):
            t, _ = rules.step(s, oks[i], secs[i])
            now.append(after[t] if t < finite else half[jump[i]] if jump[i] < n else t)
        after = now
        half[i] = now[rules.half]
    ends = [i for i in range(n) if i == n - 1 or half[i] != half[i + 1]]
    return after, [secs[i] for i in ends], [half[i] for i in ends]


def applied(state: int, after: list[int], bounds: list[int], values: list[int], rules: Rules) -> int:
    """The state after a block whose table is given."""
    if state < rules.open:
        return after[state]
    k = int(np.searchsorted(bounds, state - rules.open, side="left"))
    return values[k] if k < len(bounds) else state


def decisions(requests: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(node, id, passed, state) for requests (node, sec, id, ok) in order of sec and id: whether each passed, and the node's state after it.

    Requests are dealt to ranges of node and time. Each range's part of a node becomes a table of what it
    makes of any state; a node's tables, a row for each range, are composed in order; and with its state
    before each range known, ranges are decided apart. So a node with most requests is many tasks' work.
    Rows without a node, second or result are left out; seconds are not below 0.
    """
    own = requests.where("node IS NOT NULL AND sec IS NOT NULL AND ok IS NOT NULL").select(F.col("node").cast("long").alias("node"), F.col("sec").cast("long").alias("sec"), F.col("id").cast("long").alias("id"), "ok")
    parts = ranged(own, ["node", "sec", "id"])

    def tables(batches):
        key, held, out = None, [], []

        def close():
            sec, ok = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            out.append((*key, *table_of(sec, ok, rules)))
            held.clear()

        for batch in batches:
            for k, sec, ok, _ in _runs(batch):
                if held and k != key:
                    close()
                key = k
                held.append((sec, ok))
            yield _tables(out)
            out.clear()
        if held:
            close()
        yield _tables(out)

    def chained(batches):
        node, state = None, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["node"] != node:
                    node, state = row["node"], 0
                out.append((row[PART], node, state))
                state = applied(state, row["after"], row["bounds"], row["values"], rules)
            yield pa.record_batch({PART: pa.array([r[0] for r in out], pa.int32()), "node": pa.array([r[1] for r in out], pa.int64()), "before": pa.array([r[2] for r in out], pa.int64())})

    def decided(batches):
        key, state = None, 0
        for batch in batches:
            passed, after = [], []
            for k, sec, ok, before in _runs(batch):
                if k != key:
                    key, state = k, before
                for s, o in zip(sec.tolist(), ok.tolist()):
                    state, let = rules.step(state, o, s)
                    passed.append(let)
                    after.append(rules.name(state, s))
            yield pa.record_batch({"node": batch.column("node"), "id": batch.column("id"), "passed": pa.array(passed, pa.bool_()), "state": pa.array(after, pa.string())})

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition(PART, "node").sortWithinPartitions(PART, "node", "sec", "id")

    blocks = in_order(parts).mapInArrow(tables, f"{PART} int, node long, after array<long>, bounds array<long>, values array<long>")
    before = stored(blocks.repartition("node").sortWithinPartitions("node", PART).mapInArrow(chained, f"{PART} int, node long, before long"))
    return in_order(parts.join(before, [PART, "node"])).mapInArrow(decided, "node long, id long, passed boolean, state string")


def _runs(batch: pa.RecordBatch):
    """((part, node), seconds, results, state before) of the rows of each block in a batch."""
    part, node, sec = (batch.column(c).to_numpy() for c in (PART, "node", "sec"))
    ok = batch.column("ok").to_numpy(zero_copy_only=False)
    cut = np.concatenate(([0], np.flatnonzero((part[1:] != part[:-1]) | (node[1:] != node[:-1])) + 1, [len(part)]))
    before = batch.column("before").to_numpy() if "before" in batch.schema.names else None
    for a, z in zip(cut.tolist(), cut[1:].tolist()):
        if z > a:
            yield (int(part[a]), int(node[a])), sec[a:z], ok[a:z], 0 if before is None else int(before[a])


def _tables(rows: list[tuple]) -> pa.RecordBatch:
    many = pa.list_(pa.int64())
    kinds = {PART: pa.int32(), "node": pa.int64(), "after": many, "bounds": many, "values": many}
    return pa.record_batch({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(kinds.items())})
