"""Request policies: limits, roles, tokens, routing, balancing, health."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashes import murmur2
from ..sources.tables import stored
from .ordered import as_of, carried, ranged, summed

#: Permissions of each role.
ROLES = {
    "admin": ("kv:get", "kv:put", "kv:delete", "collection:create", "collection:delete", "user:manage", "apikey:issue"),
    "writer": ("kv:get", "kv:put", "collection:create"),
    "reader": ("kv:get",),
}


def role_permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, p) for r, ps in ROLES.items() for p in ps], "role string, perm string")


def needed_permission(method: Column) -> Column:
    return F.when(method == "GET", "kv:get").when(method.isin("POST", "PUT"), "kv:put").when(method == "DELETE", "kv:delete")


#: What a task tells of a range of requests: counts of stretches folded there (n), the bucket at the range's end (end), and requests whose bucket it can't know (open).
FOLDED = "kind string, uid long, sec long, id long, tokens double, allowed long, denied long"


def _spent(tokens: float, last: int, sec: int, capacity: float, rate: float) -> tuple[float, bool]:
    """(tokens after a request, whether it is allowed)."""
    tokens = min(capacity, tokens + max(0, sec - last) * rate)
    return (tokens - 1, True) if tokens >= 1 else (tokens, False)


def folded(requests: DataFrame, capacity: float, rate: float) -> DataFrame:
    """Ranges of requests (uid, sec, id) in order, each folded as far as it can be by itself (FOLDED).

    A pause in which the bucket surely fills begins a stretch that knows nothing of those before, and so does
    a uid's first request, if it isn't the range's. So only a range's first stretch stays open, and a range
    tells what the next one begins with; a uid with most requests is many tasks' work.
    """

    def run(batches):
        uid, known, tokens, last, at, n, out = None, False, capacity, 0, 0, [0, 0], []
        for batch in batches:
            for u, sec, id_ in zip(*(batch.column(c).to_pylist() for c in ("uid", "sec", "id"))):
                if u != uid:
                    if uid is not None:
                        out.append(("n", uid, last, at, None, *n))
                    known, uid, tokens, last, n = uid is not None, u, capacity, sec, [0, 0]
                elif not known and (sec - last) * rate >= capacity:
                    known, tokens = True, capacity
                if known:
                    tokens, ok = _spent(tokens, last, sec, capacity, rate)
                    n[not ok] += 1
                else:
                    out.append(("open", u, sec, id_, None, 0, 0))
                last, at = sec, id_
            yield _bucket_rows(out)
            out = []
        yield _bucket_rows([("end" if known else "n", uid, last, at, tokens, *n)] if uid is not None else [])

    rows = requests.select(*(F.col(c).cast("long").alias(c) for c in ("uid", "sec", "id"))).where("uid IS NOT NULL AND sec IS NOT NULL")
    return rows.repartitionByRange("uid", "sec", "id").sortWithinPartitions("uid", "sec", "id").mapInArrow(run, FOLDED)


def bucketed(requests: DataFrame, capacity: float, rate: float) -> DataFrame:
    """(uid, allowed, denied) of a token bucket for each uid over whole seconds, ties by id; rows without a uid or second are left out.

    Ranges of requests are folded apart, see `folded`; what they leave open, at most what lies between a
    range's beginning and the first long pause, goes on from the bucket that the range before tells. That
    passes one task for each uid, in order, which holds a bucket and a batch of rows.
    """
    capacity, rate = float(capacity), float(rate)
    parts = stored(folded(requests, capacity, rate))

    def close(batches):
        uid, tokens, last, n, out = None, capacity, 0, [0, 0], []
        for batch in batches:
            for kind, u, sec, start in zip(*(batch.column(c).to_pylist() for c in ("kind", "uid", "sec", "tokens"))):
                if u != uid:
                    if uid is not None:
                        out.append(("n", uid, last, 0, None, *n))
                    uid, tokens, last, n = u, capacity, sec, [0, 0]
                if kind == "end":
                    tokens = start
                else:
                    tokens, ok = _spent(tokens, last, sec, capacity, rate)
                    n[not ok] += 1
                last = sec
            yield _bucket_rows(out)
            out = []
        yield _bucket_rows([("n", uid, last, 0, None, *n)] if uid is not None else [])

    border = parts.where("kind != 'n'").select("kind", "uid", "sec", "id", "tokens").repartition("uid").sortWithinPartitions("uid", "sec", "id").mapInArrow(close, FOLDED)
    return parts.unionByName(border).groupBy("uid").agg(F.sum("allowed").alias("allowed"), F.sum("denied").alias("denied"))


def _bucket_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    return pa.record_batch({c.split()[0]: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(FOLDED.split(", "), kinds))})


def limit_key(uid: Column, ip: Column) -> Column:
    """The bucket a request falls under: its user's if known, or else its address's."""
    return F.coalesce(F.concat(F.lit("rl:uid:"), uid.cast("string")), F.concat(F.lit("rl:ip:"), ip.cast("string")))


def limit_states(requests: DataFrame, capacity: float, rate: float) -> DataFrame:
    """(key, last, expires) of the buckets of requests (uid, ip, sec): when each was last used, and when its state may go, after twice the seconds that filling takes."""
    return requests.groupBy(limit_key(F.col("uid"), F.col("ip")).alias("key")).agg(F.max("sec").alias("last")).withColumn("expires", F.col("last") + math.ceil(capacity / rate) * 2)


def permitted(requests: DataFrame, roles: DataFrame) -> DataFrame:
    """Requests (role, method) whose role has the method's permission; methods without one pass unchecked, unknown roles have none."""
    rows = requests.withColumn("perm", needed_permission(F.col("method")))
    held = F.broadcast(roles.withColumn("held", F.lit(True)))  # eleven rows
    return rows.join(held, ["role", "perm"], "left").where(F.col("perm").isNull() | F.col("held")).drop("held")


def routed(requests: DataFrame, routes: list[tuple[str, str]]) -> DataFrame:
    """Each request (path) with the target of the first route (prefix, target) whose prefix its path has, else 404. Routes are part of the plan, so nothing is shuffled and repeated rows stay."""
    found = F.lit("404")
    for prefix, target in reversed(routes):
        found = F.when(F.col("path").startswith(prefix), target).otherwise(found)
    return requests.withColumn("target", found)


def _pattern(pattern: str) -> str:
    return "^" + "/".join("([^/]+)" if s.startswith(":") else re.sub(r"([^A-Za-z0-9_])", r"\\\1", s) for s in pattern.split("/")) + "$"


def matched(requests: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Each request with the target of the first pattern that its path has, with :name for a segment, and params, what stood for the names; nulls if none. Patterns are part of the plan."""
    found, params = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for pattern, target in reversed(patterns):
        fits, names = F.col("path").rlike(_pattern(pattern)), [s[1:] for s in pattern.split("/") if s.startswith(":")]
        own = F.create_map(*(x for k, n in enumerate(names) for x in (F.lit(n), F.regexp_extract("path", _pattern(pattern), k + 1)))).cast("map<string,string>")
        found, params = F.when(fits, target).otherwise(found), F.when(fits, own).otherwise(params)
    return requests.withColumns({"target": found, "params": params})


def parsed_requests(raw: DataFrame) -> DataFrame:
    """(method, path, query, version, headers, body, state) added to raw HTTP requests (raw).

    The request line is split at its first two blanks, without which there is no path or version, and the target at its first ?. Headers are lines up to the
    empty one, `name: value`, of a repeated name the last; the body has Content-Length characters.
    state is ok, more (not all is there yet) or error (a header line without a colon, as soon as that line
    is there). Of a request whose head is not all there, nothing but its state is given, unless it is an error.
    """
    head_end = F.instr("raw", "\r\n\r\n")
    there = F.split("raw", "\r\n")
    lines = F.when(head_end > 0, F.split(F.substring(F.col("raw"), F.lit(1), head_end - 1), "\r\n")).otherwise(F.slice(there, F.lit(1), F.size(there) - 1))  # without one that is not all there
    bad = F.exists(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.instr(x, ":") == 0)
    lines = F.when((head_end > 0) | bad, lines)
    line = F.get(lines, 0)
    target = F.get(F.split(line, " ", 3), 1)
    at = F.instr(target, "?")
    fields = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    entries = F.transform(fields, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.substring(x, F.instr(x, ":") + 2, F.length(x)).alias("v")))
    last = F.filter(entries, lambda e, k: ~F.exists(F.slice(entries, k + 2, F.greatest(F.size(entries) - k - 1, F.lit(0))), lambda o: o["k"] == e["k"]))
    out = raw.withColumns({"__line": line, "__target": target, "headers": F.map_from_entries(last)})
    size = F.coalesce(F.expr("try_cast(headers['Content-Length'] AS int)"), F.lit(0))
    body = F.substring(F.col("raw"), head_end + 4, F.length("raw"))
    state = F.when(bad, "error").when(head_end == 0, "more").when(F.length(body) < size, "more").otherwise("ok")
    return out.withColumns({
        "method": F.get(F.split("__line", " ", 3), 0), "path": F.when(at > 0, F.substring(target, F.lit(1), at - 1)).otherwise(target), "query": F.when(at > 0, F.substring(target, at + 1, F.length(target))).otherwise(F.when(target.isNotNull(), "")),
        "version": F.get(F.split("__line", " ", 3), 2), "body": F.when(state == "ok", F.substring(body, F.lit(1), size)), "state": state,
    }).drop("__line", "__target")


def smooth_weighted(weights: dict[str, int], n: int) -> list[str]:
    """The repeating order of smooth weighted round robin: each pick takes the node that is most behind its share, the first of equals."""
    total, behind, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for _ in range(n):
        for node, w in weights.items():
            behind[node] += w
        best = max(behind, key=behind.get)
        behind[best] -= total
        out.append(best)
    return out


def balanced(requests: DataFrame, order: list[str]) -> DataFrame:
    """Requests numbered from 0 (n) to the nodes of a repeating order."""
    return requests.withColumn("node", F.element_at(F.array(*map(F.lit, order)), (F.col("n") % len(order) + 1).cast("int")))


def ring(nodes: DataFrame, points: int) -> DataFrame:
    """(hash, node): the points of each node (node) on the hash ring; of points that collide the least node's."""
    rows = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    return rows.select(murmur2(F.concat_ws(":", "node", F.col("k").cast("string")), 0).alias("hash"), "node").groupBy("hash").agg(F.min("node").alias("node"))


def on_ring(keys: DataFrame, ring: DataFrame) -> DataFrame:
    """(key, node): the node of the first point at or after the key's hash, or else of the first point of all: an as-of join from above, so rings of any size and keys go through one ordered pass."""
    own, ring = stored(keys.select("key", murmur2(F.col("key"), 0).alias("h"))), stored(ring.select("hash", "node"))  # hashed once
    met = as_of(own, ring, [], -F.col("h"), -F.col("hash"), ["node"])
    least = F.broadcast(ring.agg(F.min_by("node", "hash").alias("least")))  # one row
    return met.crossJoin(least).select("key", F.coalesce("node", "least").alias("node"))


def moved_arcs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(from, to, source, target) of two rings (hash, node): the disjoint runs of hashes, both ends included, whose node changes.

    The points of both rings cut the hashes into runs, and the node of a run in each ring is that of the
    ring's next point, carried down from it; no key is looked up.
    """
    points = before.select("hash", F.col("node").alias("source")).unionByName(after.select("hash", F.col("node").alias("target")), allowMissingColumns=True)
    points = points.groupBy("hash").agg(F.max("source").alias("source"), F.max("target").alias("target"))
    first = [F.broadcast(r.agg(F.min_by("node", "hash").alias(n))) for r, n in ((before, "__source"), (after, "__target"))]  # one row each
    top = points.sparkSession.createDataFrame([(1 << 32,)], "hash long").crossJoin(first[0]).crossJoin(first[1]).select("hash", F.col("__source").alias("source"), F.col("__target").alias("target"))
    # what lies above a ring's last point belongs to its first
    known = carried(points.unionByName(top).withColumn("down", -F.col("hash")), [], ["down"], ["source", "target"])
    runs = carried(known.withColumn("before", F.col("hash")), [], ["hash"], ["before"], own=False)
    arcs = runs.select((F.coalesce("before", F.lit(-1)) + 1).alias("from"), F.least("hash", F.lit((1 << 32) - 1)).alias("to"), "source", "target")
    return arcs.where("source != target AND from <= to")


def moves(arcs: DataFrame) -> DataFrame:
    """(source, target, share): what part of all hashes goes from one node to the other."""
    return arcs.groupBy("source", "target").agg((F.sum(F.col("to") - F.col("from") + 1) / (1 << 32)).alias("share"))


def moved_keys(keys: DataFrame, arcs: DataFrame) -> DataFrame:
    """(key, source, target) of the keys in arcs that move."""
    own = keys.select("key", murmur2(F.col("key"), 0).alias("__h"))
    return as_of(own, arcs, [], F.col("__h"), F.col("from"), ["to", "source", "target"]).where("__h <= to").select("key", "source", "target")


def marked(upstreams: DataFrame, marks: DataFrame) -> DataFrame:
    """Upstreams (host, port, healthy and others) after marks (mark_no, host, port, up): the last mark of each decides, unknown ones have no effect."""
    last = marks.groupBy("host", "port").agg(F.max_by("up", "mark_no").alias("__up"))
    return upstreams.join(last, ["host", "port"], "left").withColumn("healthy", F.coalesce("__up", "healthy")).select(*upstreams.columns)


def next_upstreams(requests: DataFrame, upstreams: DataFrame) -> DataFrame:
    """Requests (pool, n from 0) with the healthy upstream (pool, idx, host, port) that is next in turn in their pool; nulls where none is healthy."""
    order = Window.partitionBy("pool").orderBy("idx")
    up = upstreams.where("healthy").select("pool", "host", "port", (F.row_number().over(order) - 1).alias("turn"))
    many = up.groupBy("pool").agg(F.count("*").alias("many"))
    return requests.join(many, "pool", "left").withColumn("turn", F.col("n") % F.col("many")).join(up, ["pool", "turn"], "left").drop("turn", "many")


def health(probes: DataFrame, down: int = 3, up: int = 2) -> DataFrame:
    """Runs (node, ok, from, n) of equal probe results (node, id, ok), and the state a long enough run sets."""
    all_, own = Window.partitionBy("node").orderBy("id"), Window.partitionBy("node", "ok").orderBy("id")
    runs = probes.withColumn("run", F.row_number().over(all_) - F.row_number().over(own)).groupBy("node", "ok", "run").agg(F.min("id").alias("from"), F.count("*").alias("n"))
    return runs.select("node", "ok", "from", "n", F.when(F.col("ok") & (F.col("n") >= up), "up").when(~F.col("ok") & (F.col("n") >= down), "down").alias("sets"))


def node_states(probes: DataFrame, down: int = 3, up: int = 2) -> DataFrame:
    """(node, id, up) after each probe (node, id, ok): a node that is up goes down after `down` failed probes in a row, and up again after `up` good ones; new nodes are up.

    A probe's run is as long as its distance from the last one of the other result; the last run that was
    long enough sets the state. All are ordered passes over ranges, so a node's probes are many tasks' work.
    """
    rows = ranged(probes.where("node IS NOT NULL").select("node", "id", "ok", F.lit(1).alias("n")), ["node", "id"])
    rows = summed(rows, ["node"], ["id"], ["n"])
    rows = carried(rows.withColumns({"good": F.when(F.col("ok"), F.col("n")), "bad": F.when(~F.col("ok"), F.col("n"))}), ["node"], ["id"], ["good", "bad"])
    run = F.col("n") - F.coalesce(F.when(F.col("ok"), F.col("bad")).otherwise(F.col("good")), F.lit(0))
    sets = F.when(F.col("ok") & (run >= up), True).when(~F.col("ok") & (run >= down), False)
    return carried(rows.withColumn("up", sets), ["node"], ["id"], ["up"]).select("node", "id", F.coalesce("up", F.lit(True)).alias("up"))


def error_class(status: Column) -> Column:
    return F.when(status < 400, "ok").when(status == 400, "bad_request").when(status == 401, "unauthorized").when(status == 403, "forbidden").when(status == 404, "not_found").when(status == 409, "conflict").when(status == 429, "rate_limited").otherwise("internal")


def backoff_ms(attempt: Column) -> Column:
    """The fixed part of the wait before a retry."""
    return (F.pow(F.lit(2), attempt) * 100).cast("long")


def retried(status: Column, method: Column) -> Column:
    return (method == "GET") & ((status >= 500) | (status == 429))


def last_headers(headers: DataFrame) -> DataFrame:
    """(id, header, value): of headers (id, pos, name, value) that repeat, whatever their case, the last one with a value."""
    return headers.where("value IS NOT NULL").groupBy("id", F.lower("name").alias("header")).agg(F.max_by("value", "pos").alias("value"))
