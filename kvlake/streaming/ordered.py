"""State machines over streams whose rows come in any order: rows are held until the watermark has passed them.

Micro-batches may bring rows of a key in any order, as long as none is later than the watermark allows;
each machine still sees them in the order of time and id, so results equal the batch form's. Rows that the
watermark has not passed yet are held as state, and give results when it has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.breaker import Rules


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class InOrder(StatefulProcessor):
    """step(state or None, row) -> (state, outputs) over a key's rows (us, id and others) in order; a key's state (us and others) goes when it was not used for `keep` microseconds of event time (0: never)."""

    def __init__(self, step: Callable, row: str, state: str, out: str, keep: int = 0):
        self.step, self.row, self.kept, self.keep = step, row, state, keep
        self.out = Row(*_names(out))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.row)
        self.state = handle.getValueState("state", self.kept)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = _names(self.row)
        new = [tuple(r[c] for c in names) for r in rows]
        self.held.appendList(new)
        self.handle.registerTimer(min(r[0] for r in new) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.held.get())
        due = [r for r in rows if r[0] < now]
        later = rows[len(due) :]
        state = self.state.get()
        state = None if state is None else tuple(state)
        if state is not None and self.keep and not rows and state[0] + self.keep <= now:
            self.state.clear()
            return
        for r in due:
            if state is not None and self.keep and state[0] + self.keep <= r[0]:
                state = None
            state, out = self.step(state, r)
            yield self.out(*key, *out)
        if due:
            self.state.update(state)
            self.held.clear()
            if later:
                self.held.appendList(later)
        if later:
            self.handle.registerTimer(later[0][0] // 1000)
        elif self.keep and state is not None:
            self.handle.registerTimer((state[0] + self.keep) // 1000)


def machine(rows: DataFrame, key: str, late: str, step: Callable, row: str, state: str, out: str, keep: int = 0) -> DataFrame:
    """InOrder over streamed rows (key, ts, id and others) by key, rows later than the watermark left out. State is kept by the RocksDB provider, which such operators need."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    marked = rows.withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    return marked.groupBy(key).transformWithState(InOrder(step, row, state, out, keep), out, "append", "EventTime")


def token_bucket(requests: DataFrame, capacity: float, rate: float, late: str) -> DataFrame:
    """(uid, id, allowed) for streamed requests (uid, id, ts), in whole seconds as in batch. A bucket's state goes after twice the seconds that filling takes, when it is full anyway."""

    def step(state, row):
        sec = row[0] // 1_000_000
        tokens = capacity if state is None else min(capacity, state[1] + max(0, sec - state[0] // 1_000_000) * rate)
        ok = tokens >= 1
        return (row[0], tokens - ok), (row[1], ok)

    return machine(requests, "uid", late, step, "us long, id long", "us long, tokens double", "uid long, id long, allowed boolean", math.ceil(capacity / rate) * 2_000_000)


def node_states(probes: DataFrame, late: str, down: int = 3, up: int = 2) -> DataFrame:
    """(node, id, up) after each streamed probe (node, id, ts, ok): a node that is up goes down after `down` failed probes in a row, and up again after `up` good ones; new nodes are up. Only the run's length up to these numbers is kept."""

    def step(state, row):
        _, is_up, run, last = state or (0, True, 0, row[2])
        run = min(run + 1, max(down, up)) if last == row[2] else 1
        is_up = True if row[2] and run >= up else False if not row[2] and run >= down else is_up
        return (row[0], is_up, run, row[2]), (row[1], is_up)

    return machine(probes, "node", late, step, "us long, id long, ok boolean", "us long, up boolean, run long, ok boolean", "node long, id long, up boolean")


def circuit_breaker(requests: DataFrame, late: str, rules: Rules = Rules()) -> DataFrame:
    """(node, id, passed, state) for streamed requests (node, id, ts, ok), as `breaker.decisions` gives them."""

    def step(state, row):
        sec = row[0] // 1_000_000
        after, passed = rules.step(0 if state is None else state[1], row[2], sec)
        return (row[0], after), (row[1], passed, rules.name(after, sec))

    return machine(requests, "node", late, step, "us long, id long, ok boolean", "us long, state long", "node long, id long, passed boolean, state string")


def refreshes(attempts: DataFrame, late: str, life: int) -> DataFrame:
    """(jti, id, outcome) of streamed attempts (jti, id, ts, exp) to use refresh tokens that end at exp (null: unknown), as `auth.refreshed` gives them: a token works once, before its end. A used token is kept for `life` seconds, the longest that tokens live, after which it has ended anyway."""

    def step(state, row):
        us, id_, exp = row
        if exp is None or us >= exp:
            return state or (us, False), (id_, "invalid")
        return (us, True), (id_, "revoked" if state is not None and state[1] else "ok")

    rows = attempts.withColumn("exp", F.unix_micros("exp"))
    return machine(rows, "jti", late, step, "us long, id long, exp long", "us long, used boolean", "jti long, id long, outcome string", life * 1_000_000)


def not_revoked(requests: DataFrame, logouts: DataFrame, late: str, life: str) -> DataFrame:
    """Streamed requests (id, jti, ts) whose token no streamed logout (jti, ts) came before, within the token's life.

    Both sides have watermarks, and a logout counts for no more than `life`, so what is kept of both ends:
    a logout when no request can be young enough for it, a request when no logout that matters can come.
    """
    r = requests.withWatermark("ts", late)
    b = logouts.select(F.col("jti").alias("__jti"), F.col("ts").alias("__out")).withWatermark("__out", late)
    met = F.expr(f"jti = __jti AND __out <= ts AND __out > ts - INTERVAL {life}")
    return r.join(b, met, "leftOuter").where("__jti IS NULL").drop("__jti", "__out")
