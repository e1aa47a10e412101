"""Upstream pools that change while they are asked: marks up and down, reloads, and the next in turn at each request's time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .ordered import as_of, numbered, ranged

#: A pool's list, in its order.
LIST = "array<struct<host: string, port: bigint, healthy: boolean>>"
#: How many turns a task gathers before it gives them.
GATHERED = 1 << 16


class Listed:
    """A list as it is loaded, any number of times: its upstreams by place, which of them are healthy, and the places of each host and port."""

    def __init__(self, upstreams: list[dict]):
        self.names = [(u["host"], u["port"]) for u in upstreams]
        self.healthy = bytes(bool(u["healthy"]) for u in upstreams)
        self.places: dict[tuple, list[int]] = {}
        for k, name in enumerate(self.names):
            self.places.setdefault(name, []).append(k)


class Pool:
    """A pool's list, which of it is healthy, and whose turn it is."""

    def __init__(self):
        self.reload([])

    @property
    def list(self) -> list[dict]:
        return [{"host": h, "port": p, "healthy": bool(up)} for (h, p), up in zip(self.listed.names, self.healthy)]

    def reload(self, upstreams: list[dict] | Listed) -> None:
        self.listed = upstreams if isinstance(upstreams, Listed) else Listed(upstreams)
        self.healthy, self.turn = bytearray(self.listed.healthy), 0

    def mark(self, host: str, port: int, up: bool) -> None:
        for k in self.listed.places.get((host, port), ()):
            self.healthy[k] = bool(up)

    def served(self, many: int) -> list[tuple]:
        """(host, port) that the next requests get, so many of them: what it gives, again and again if they are more. So it gives no upstream twice, and is no longer than there are requests."""
        at, turn = [], self.turn
        for k, end in ((turn, len(self.healthy)), (0, turn)):
            while len(at) < many and (k := self.healthy.find(1, k, end)) >= 0:
                at.append(k)
                k += 1
        if at:
            self.turn = (at[(many - 1) % len(at)] + 1) % len(self.healthy)
        return [self.listed.names[k] for k in at]


def picked(requests: DataFrame, changes: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """(id, pool, host, port) for requests (id, pool, at): the upstream whose turn it is in the request's pool at its time; nulls where none is healthy.

    changes (pool, at, no, list, host, port, up) come before requests of their time, in order of no: one with
    a list reloads the pool, whose turn is then the first's; others mark all of the pool's upstreams of
    that host and port. Turns go to the next healthy one after the last served. Where lists (list, upstreams)
    are given, that of a change is the name of one of them, which goes to a pool's task once however often it
    is loaded, and is held there from its first load to its last.

    Between two changes of a pool its requests take its healthy upstreams in turn, so only how many they are
    matters for what comes after: a pool's changes and counts of its requests go through one task in order,
    which tells the turns of as many upstreams as there are requests at most, and each request takes its
    place among them. Counts are by time, or by the last change before if a pool has more requests than
    changes; so changes in pools with more of them than requests are shuffled once, counts are never more
    than changes, and a pool with most requests is many tasks' work.
    """
    known = "pool IS NOT NULL AND at IS NOT NULL"
    r = requests.where(known).select("pool", "at", "id")
    c = changes.where(known).select("pool", "at", F.lit(1).alias("step"), "no", "list", "host", F.col("port").cast("long").alias("port"), F.when(F.col("list").isNull(), F.coalesce("up", F.lit(False)).cast("long")).alias("n"))  # n is null where a list is loaded
    asked, changed = (x.groupBy("pool").agg(F.count("*").alias(n)) for x, n in ((r, "asked"), (c, "changed")))
    busy = stored(asked.join(changed, "pool", "left").where("asked > coalesce(changed, 0)").select("pool"))
    since = as_of(r.join(busy, "pool", "left_semi"), c.join(busy, "pool", "left_semi").select("pool", F.col("at").alias("since")), ["pool"], F.col("at"), F.col("since"), ["since"])
    dealt = ranged(since.unionByName(r.join(busy, "pool", "left_anti").withColumn("since", F.col("at"))), ["pool", "since", "at", "id"])
    own = numbered(dealt, ["at", "id"], "k", ["pool", "since"])
    many = dealt.where("since IS NOT NULL").groupBy("pool", F.col("since").alias("at")).agg(F.lit(2).alias("step"), F.count("*").alias("n"))
    if lists is None:
        c = c.withColumns({"upstreams": F.col("list").cast(LIST), "list": F.lit(None).cast("long")})
    else:
        loaded = c.where("list IS NOT NULL").groupBy("pool", "list").agg(F.min("at").alias("at"), F.lit(0).alias("step"), F.count("*").alias("n"))
        c = c.unionByName(loaded.join(lists.select("list", F.col("upstreams").cast(LIST).alias("upstreams")), "list", "left"), allowMissingColumns=True)
    steps = c.unionByName(many, allowMissingColumns=True).withColumn("upstreams", F.coalesce("upstreams", F.array().cast(LIST)))  # Spark's Arrow writer passes a batch's null lists again at each row

    def run(batches):
        key, pool, held = None, Pool(), {}
        for batch in batches:
            rows, ends, turns = [], [0], []

            def given():
                named = pa.StructArray.from_arrays([pa.array([h for h, _ in turns], pa.string()), pa.array([p for _, p in turns], pa.int64())], ["host", "port"])
                at = pa.array(rows, pa.int64())
                return pa.record_batch({"pool": batch.column("pool").take(at), "since": batch.column("at").take(at), "turns": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), named)})

            columns = (batch.column(c).to_pylist() for c in ("pool", "step", "list", "host", "port", "n"))
            for k, (p, step, name, host, port, n) in enumerate(zip(*columns)):
                if p != key:
                    key, pool, held = p, Pool(), {}
                if step == 0:
                    held[name] = [Listed(batch.column("upstreams")[k].as_py()), n]
                elif step == 2:
                    rows.append(k)
                    turns += pool.served(n)
                    ends.append(len(turns))
                    if len(turns) >= GATHERED:
                        yield given()
                        rows, ends, turns = [], [0], []
                elif name is not None:
                    pool.reload(held[name][0])
                    held[name][1] -= 1
                    if not held[name][1]:
                        del held[name]
                elif n is None:
                    pool.reload(batch.column("upstreams")[k].as_py())
                else:
                    pool.mark(host, port, n)
            yield given()

    kinds = dict(steps.dtypes)
    turns = steps.repartition("pool").sortWithinPartitions("pool", "at", "step", "no").mapInArrow(run, f"pool {kinds['pool']}, since {kinds['at']}, turns array<struct<host: string, port: bigint>>")
    turn = F.get("turns", (F.col("k") % F.greatest(F.size("turns"), F.lit(1))).cast("int"))
    return own.join(turns, ["pool", "since"], "left").select("id", "pool", turn["host"].alias("host"), turn["port"].alias("port"))
