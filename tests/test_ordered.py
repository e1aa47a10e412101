"""Ordered passes and what is built on them, against plain Python, with keys that have most of the rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kvlake.operators import breaker, catalog, ordered, policy, ranges, reads, stitch, transactions
from kvlake.streaming import ordered as streams
from kvlake.streaming.state import drained


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one range
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def keyed(rng, n):
    """Half of the rows have one key."""
    return [("hot" if rng.random() < 0.5 else f"k{rng.randrange(9)}", k) for k in range(n)]


def test_running_sums_and_last_values(spark, many_ranges):
    rng = random.Random(1)
    data = [(key, k, rng.randrange(5) if rng.random() < 0.2 else None) for key, k in keyed(rng, 400)]
    df = spark.createDataFrame(data, "key string, at long, x long").repartition(5)
    dealt = ordered.ranged(df, ["key", "at"])
    assert dealt.where("key = 'hot'").select("__part").distinct().count() > 1
    for own in (True, False):
        last, total, want = {}, defaultdict(int), {}
        for key, at, x in data:
            before = last.get(key), total[key]
            last[key], total[key] = x if x is not None else last.get(key), total[key] + (x or 0)
            want[key, at] = (last[key], total[key]) if own else before
        assert {(r["key"], r["at"]): r["x"] for r in ordered.carried(df, ["key"], ["at"], ["x"], own).collect()} == {k: v[0] for k, v in want.items()}
        assert {(r["key"], r["at"]): r["x"] for r in ordered.summed(dealt, ["key"], ["at"], ["x"], own).collect()} == {k: v[1] for k, v in want.items()}
    assert sorted(r["n"] for r in ordered.numbered(df, ["at"], "n").collect()) == list(range(400))
    empty = df.limit(0)
    assert ordered.carried(empty, ["key"], ["at"], ["x"]).count() == 0 == ordered.numbered(empty, ["at"], "n").count()


def test_reads_at_many_snapshots(spark, many_ranges):
    rng = random.Random(2)
    log = [(key, seq // 2 * 2, 1 + seq % 2 if seq > 300 else 1 + (rng.random() < 0.3), str(seq)) for key, seq in keyed(rng, 600)]  # from 300 on a key may have two types of one number
    log = list({(k, s, t): (k, s, t, v) for k, s, t, v in log}.values())
    asked = [(n, rng.choice(["hot", "hot", "k3", "k5", "none"]), rng.choice([0, 5, 299, 301, 600, rng.randrange(600)])) for n in range(500)] + [(900, None, 5), (901, "hot", None)]
    asked += [(n, "hot", 333) for n in range(1000, 1200)]  # one request many times
    df = spark.createDataFrame(log, "user_key string, seq long, type int, value string").repartition(5)
    got = reads.snapshot_get(df, spark.createDataFrame(asked, "id long, user_key string, snapshot long").repartition(3))
    want = []
    for n, key, at in asked:
        seen = [(s, -t, v) for k, s, t, v in log if k == key and at is not None and s <= at]
        best = max(seen, default=None)
        want.append((n, key, at, best[2] if best and best[1] == -1 else None))
    assert rows(got) == sorted(want, key=repr)
    assert {r["id"]: r["value"] for r in reads.snapshot_get(df.limit(0), spark.createDataFrame(asked, "id long, user_key string, snapshot long")).collect()} == {n: None for n, _, _ in asked}


def test_as_of_open_side(spark):
    asked, known = spark.createDataFrame([(1, 5), (2, 6), (3, 4)], "id long, at long"), spark.createDataFrame([(5, "a"), (4, "b")], "t long, v string")
    assert rows(ordered.as_of(asked, known, [], F.col("at"), F.col("t"), ["v"], closed=False)) == [(1, 5, "b"), (2, 6, "a"), (3, 4, None)]


@pytest.mark.parametrize("seed", [0, 2])
def test_range_tombstones(spark, many_ranges, seed):
    rng = random.Random(seed)
    spans = [(f"k{a:03d}", f"k{a + rng.randrange(-1, [3, 30, 200][seed]):03d}", rng.randrange(100)) for a in (rng.randrange(200) for _ in range(120))]
    spans += [("k000", "k999", 7), ("", "k001", 60), (None, "k5", 99), ("k1", None, 99), ("k100", "k120", None)] + [("k050", "k060", 55)] * 40
    live = [(f"k{rng.randrange(260):03d}", s) for s in range(200)] + [("", 3), (None, 1), ("k010", None)]
    covers = [(a, z, d) for a, z, d in spans if None not in (a, z, d) and a < z]
    df = spark.createDataFrame(spans, "start string, end string, del_seq long").repartition(4)
    got = ranges.range_deleted(spark.createDataFrame(live, "user_key string, seq long"), df)
    assert rows(got) == sorted([(k, s) for k, s in live if k is None or s is None or not any(a <= k < z and s < d for a, z, d in covers)], key=repr)
    bounds = sorted({b for a, z, _ in covers for b in (a, z)})
    want = {b: max((d for a, z, d in covers if a <= b < z), default=None) for b in bounds}
    assert {r["start"]: r["del_seq"] for r in ranges.segments(df).collect()} == want
    assert ranges.range_deleted(spark.createDataFrame(live, "user_key string, seq long"), df.limit(0)).count() == len(live)


def brute_outcomes(txns, reads_, writes):
    out, stood = {}, defaultdict(list)
    own_r, own_w = defaultdict(set), defaultdict(set)
    for t, k in reads_:
        own_r[t].add(k)
    for t, k in writes:
        own_w[t].add(k)
    for t, began, committed in sorted(txns, key=lambda x: (x[2] is None, x[2])):
        if committed is None:
            out[t] = "rolled_back"
            continue
        bad = any(began < c < committed for k in own_r[t] if k is not None for c in stood[k])
        out[t] = "aborted" if bad else "committed"
        if not bad:
            for k in own_w[t]:
                stood[k].append(committed)
    return out


def outcome(spark, txns, reads_, writes):
    make = lambda x, s: spark.createDataFrame(x, s).repartition(3)
    return transactions.outcomes(make(txns, "txn long, began long, committed long"), make(reads_, "txn long, key string"), make(writes, "txn long, key string"))


def test_transactions_that_depend_on_aborted_ones(spark):
    # each reads what the one before writes, all overlap: every second one commits
    chain = [(k, k, 100 + k) for k in range(7)]
    reads_, writes = [(k, f"x{k - 1}") for k in range(7)], [(k, f"x{k}") for k in range(7)]
    got = {r["txn"]: r["outcome"] for r in outcome(spark, chain, reads_, writes).collect()}
    assert got == {k: "aborted" if k % 2 else "committed" for k in range(7)} == brute_outcomes(chain, reads_, writes)


def test_transactions(spark):
    rng = random.Random(6)
    txns = [(t, t * 10, t * 10 + 3 + 10 * rng.randrange(6) + rng.randrange(3) if rng.random() < 0.9 else None) for t in range(80)]
    sets = lambda n: [(t, "hot" if rng.random() < 0.1 else f"k{rng.randrange(40)}") for t in range(80) for _ in range(rng.randrange(n))]
    reads_, writes = sets(4) + [(5, None), (6, "k1"), (6, "k1")], sets(3) + [(7, None)]
    got = {r["txn"]: r["outcome"] for r in outcome(spark, txns, reads_, writes).collect()}
    want = brute_outcomes(txns, reads_, writes)
    assert got == want and set(want.values()) == {"committed", "aborted", "rolled_back"}
    ops = spark.createDataFrame([(t, n, 1 + n % 2, k or "", f"{t}") for n, (t, k) in enumerate(writes)], "txn long, op_no long, type int, key string, value string")
    log = transactions.committed_log(spark.createDataFrame(txns, "txn long, began long, committed long"), spark.createDataFrame(reads_, "txn long, key string"), ops, 10)
    assert sorted(r["seq"] for r in log.collect()) == list(range(11, 11 + sum(want[t] == "committed" for t, _ in writes)))
    assert outcome(spark, [(1, 1, 2)], [(1, "a")], [(1, "a")]).collect()[0]["outcome"] == "committed"


def chunked(rng, streams_, size):
    out = []
    for s, text in streams_.items():
        at = k = 0
        while at < len(text):
            n = size if isinstance(size, int) else rng.randrange(1, size[0])
            out.append((s, k * 3, text[at : at + n]))
            at, k = at + n, k + 1
        out.append((s, k * 3 + 1, ""))
    rng.shuffle(out)
    return out


def split_frames(text):
    out = []
    while (at := text.find("\n\n")) >= 0:
        out.append((text[:at], "ok"))
        text = text[at + 2 :]
    return out + ([(text, "more")] if text else [])


@pytest.mark.parametrize("size", [1, (7,), 4096])
def test_frames_of_chunks_of_any_length(spark, many_ranges, size):
    rng = random.Random(9)
    word = lambda: rng.choice(["a", "\n", "\n\n", "data: x", "é", "\n\n\n"])
    texts = {k: "".join(word() for _ in range(rng.randrange(30))) for k in range(12)} | {50: "".join(f'data: {{"key":"k{n}","value":"v"}}\n\n' for n in range(60)), 51: "\n", 52: "\n\n", 53: "\n\n\n\nx", 54: "no end"}
    chunks = spark.createDataFrame(chunked(rng, texts, size) + [(None, 1, "x\n\n"), (50, 10**6, None)], "stream long, chunk long, data string").repartition(4)
    want = sorted((s, n, text, state) for s, t in texts.items() for n, (text, state) in enumerate(split_frames(t)))
    assert sorted(tuple(r) for r in stitch.frames(chunks).collect()) == want
    if size == (7,):
        assert [(r["n"], r["key"]) for r in stitch.streamed_pairs(chunks).where("stream = 50").orderBy("n").collect()] == [(n + 1, f"k{n}") for n in range(60)]
        assert stitch.frames(chunks.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, (9,), 4096])
def test_requests_of_chunks_of_any_length(spark, size):
    rng = random.Random(3)
    request = lambda n: f"GET /{n}?q={n} HTTP/1.1\r\nHost: a\r\n\r\n" if n % 3 else f"POST /{n} HTTP/1.1\r\nContent-Length: {5 + n}\r\n\r\n{'x' * n}\r\n\r\nz"
    texts = {c: "".join(request(n) for n in range(c)) for c in range(6)}
    texts |= {10: request(1) + "GET / HTTP/1.1\r\nno colon\r\nA: b\r\n\r\n" + request(2), 11: request(3) + "POST / HTTP/1.1\r\nContent-Length: 9\r\n\r\nshort", 12: "GET", 13: request(1) + "GET / HTTP/1.1\r\nbad", 14: "x\r\nnocolon\r\n"}
    chunks = spark.createDataFrame(chunked(rng, texts, size), "conn long, chunk long, data string").repartition(3)
    got = stitch.stitched_requests(chunks).select("conn", "n", "path", "query", "body", "state").collect()
    want = [(c, n, f"/{n}", f"q={n}" if n % 3 else "", "" if n % 3 else f"{'x' * n}\r\n\r\nz", "ok") for c in range(6) for n in range(c)]
    want += [(10, 0, "/1", "q=1", "", "ok"), (10, 1, "/", "", None, "error"), (11, 0, "/3", "", "xxx\r\n\r\nz", "ok"), (11, 1, "/", "", None, "more"), (12, 0, None, None, None, "more"), (13, 0, "/1", "q=1", "", "ok"), (13, 1, None, None, None, "more"), (14, 0, None, None, None, "error")]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_watched_values(spark):
    raw = [(1, "PUT", "/c/a", '{"ttl_seconds":5}'), (2, "PUT", "/c/b", '{"name":"other"}'), (3, "PUT", "/c/c", "broken"), (4, "PUT", "/c/d", "[1]"), (5, "DELETE", "/c/e", None), (6, "PUT", "/x/f", "{}"), (7, "PUT", "/c/g", "{}"), (8, "PUT", "/c/h", "7")]
    got = catalog.parsed_watch(spark.createDataFrame(raw, "event_no long, op string, key string, value string"), "/c/")
    assert [tuple(r) for r in got.orderBy("event_no").collect()] == [(1, "PUT", "a", '{"ttl_seconds":5}'), (2, "PUT", "b", '{"name":"other"}'), (3, "PUT", "c", None), (4, "PUT", "d", None), (5, "DELETE", "e", None), (7, "PUT", "g", "{}"), (8, "PUT", "h", None)]


def requests_of(rng, n):
    """One node has half of the requests; seconds repeat."""
    return [(0 if rng.random() < 0.5 else rng.randrange(1, 5), rng.randrange(3 * n), k, rng.random() < 0.6) for k in range(n)]


@pytest.mark.parametrize("rules", [breaker.Rules(1, 1, 5), breaker.Rules(2, 3, 400)])
def test_circuit_breaker(spark, many_ranges, rules):
    data = requests_of(random.Random(rules.pause), 700)
    want, state = {}, defaultdict(int)
    for node, sec, k, ok in sorted(data):
        state[node], passed = rules.step(state[node], ok, sec)
        want[k] = (passed, rules.name(state[node], sec))
    df = spark.createDataFrame(data, "node long, sec long, id long, ok boolean").repartition(5)
    assert {r["id"]: (r["passed"], r["state"]) for r in breaker.decisions(df, rules).collect()} == want
    assert {False, True} == {p for p, _ in want.values()}
    assert breaker.decisions(df.limit(0)).count() == 0


def test_breaker_rules():
    rules = breaker.Rules(failures=2, probes=2, pause=10)
    seen, state = [], 0
    for sec, ok in [(0, False), (1, True), (2, False), (3, False), (4, True), (12, True), (13, True), (14, True), (15, False), (16, False), (26, False), (30, True), (36, True), (37, False)]:
        state, passed = rules.step(state, ok, sec)
        seen.append((passed, rules.name(state, sec)))
    assert seen == [(True, "closed")] * 3 + [(True, "open"), (False, "open"), (False, "open"), (True, "half_open"), (True, "closed"), (True, "closed"), (True, "open"), (True, "open"), (False, "open"), (True, "half_open"), (True, "open")]


def test_token_bucket_of_one_user_is_many_parts(spark, many_ranges):
    rng = random.Random(4)
    secs, at = [], 0
    for _ in range(600):
        at += rng.choice([0, 0, 1, 2, 3, 25])
        secs.append(at)
    data = [(7, s, k) for k, s in enumerate(secs)] + [(8, 5, k) for k in range(1000, 1010)] + [(9, None, 1), (None, 1, 2)]
    df = spark.createDataFrame(data, "uid long, sec long, id long").repartition(5)
    want = {}
    for uid in (7, 8):
        tokens, last, n = 2.0, None, [0, 0]
        for _, sec, _ in sorted(r for r in data if r[0] == uid):
            tokens, last = min(2.0, tokens + (0 if last is None else sec - last) * 0.1), sec
            n[tokens < 1] += 1
            tokens -= tokens >= 1
        want[uid] = tuple(n)
    assert {r["uid"]: (r["allowed"], r["denied"]) for r in policy.bucketed(df, 2.0, 0.1).collect()} == want
    # all ranges fold most of the one user's requests by themselves
    parts = policy.folded(df.where("uid = 7"), 2.0, 0.1).groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.col("allowed") + F.col("denied")).alias("n"), F.count(F.when(F.col("kind") == "open", 1)).alias("open")).collect()
    assert len(parts) > 3 and all(r["n"] > 3 * r["open"] for r in parts) and sum(r["n"] + r["open"] for r in parts) == 600
    steady = spark.createDataFrame([(1, k // 2, k) for k in range(300)], "uid long, sec long, id long")  # never pauses
    tokens, n = 2.0, [0, 0]
    for k in range(300):
        tokens, ok = policy._spent(tokens, max(0, k - 1) // 2, k // 2, 2.0, 0.1)
        n[not ok] += 1
    assert [tuple(r) for r in policy.bucketed(steady, 2.0, 0.1).collect()] == [(1, *n)]
    assert policy.bucketed(df.limit(0), 2.0, 0.1).count() == 0


def brute_states(data, down=3, up=2):
    out, run, state = {}, {}, defaultdict(lambda: True)
    for node, _, k, ok in data:
        last, n = run.get(node, (ok, 0))
        run[node] = (ok, n + 1 if last == ok else 1)
        if run[node][1] >= (up if ok else down):
            state[node] = ok
        out[k] = state[node]
    return out


def test_health_after_each_probe(spark, many_ranges):
    data = requests_of(random.Random(12), 500)
    df = spark.createDataFrame(data, "node long, sec long, id long, ok boolean").repartition(5)
    want = brute_states(data)
    assert {r["id"]: r["up"] for r in policy.node_states(df).collect()} == want and set(want.values()) == {True, False}


def test_rings_that_change(spark, many_ranges):
    nodes = lambda *ns: spark.createDataFrame([(f"n{k}",) for k in ns], "node string")
    before, after = policy.ring(nodes(1, 2, 3, 4), 10), policy.ring(nodes(2, 3, 4, 5), 10)
    keys = spark.createDataFrame([(f"key{k}",) for k in range(400)], "key string")
    points = {r["hash"]: r["node"] for r in before.collect()}
    at = {r["key"]: r["node"] for r in policy.on_ring(keys, before).collect()}
    assert set(at.values()) == {"n1", "n2", "n3", "n4"}
    to = {r["key"]: r["node"] for r in policy.on_ring(keys, after).collect()}
    arcs = policy.moved_arcs(before, after).cache()
    assert {r["key"]: (r["source"], r["target"]) for r in policy.moved_keys(keys, arcs).collect()} == {k: (at[k], to[k]) for k in at if at[k] != to[k]}
    order = sorted(points)
    held = defaultdict(int)
    for a, b in zip([-1, *order], [*order, (1 << 32) - 1]):
        held[points[b] if b in points else points[order[0]]] += b - a
    moved = {(r["source"], r["target"]): r["share"] for r in policy.moves(arcs).collect()}
    assert abs(sum(v for (s, _), v in moved.items() if s == "n1") - held["n1"] / (1 << 32)) < 1e-12  # all that the lost node held
    spans = sorted((r["from"], r["to"]) for r in arcs.collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and all(a <= z for a, z in spans)
    assert policy.moved_arcs(before, before).count() == 0


@pytest.mark.parametrize("name", ["ring_moved_keys", "ring_moves"])
def test_a_ring_loses_points_that_collided(spark, tmp_path, name):
    """Point 1 of the first supplier, who leaves, has the hash of point 4 of the second."""
    import duckdb

    from kvlake.plans import extended, queries  # noqa: F401

    spark.createDataFrame([("Supplier#000000437",), ("Supplier#000024863",), ("Supplier#000000001",)], "s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(2000).select(F.format_string("Customer#%09d", "id").alias("c_name")).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert rows(got) == sorted(want, key=repr) and want


def run_stream(spark, tmp_path, make, batches, schema):
    """The stream's rows after micro-batches given as lists of rows, in their order."""
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:04d}"))
    source = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    stream = make(source)
    drained(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()


def jumbled(rng, data, late):
    """data (key, sec, id, ...) in micro-batches of 500 seconds, each row up to `late` seconds too late."""
    batches = defaultdict(list)
    for r in data:
        batches[(r[1] + rng.randrange(late)) // 500].append(r)
    for b in batches.values():
        rng.shuffle(b)
    return [batches[k] for k in sorted(batches)]


def test_streams_in_any_order_equal_batch(spark, tmp_path):
    rng = random.Random(5)
    data = requests_of(rng, 400)
    final = max(r[1] for r in data) - 100
    batches = [[(*r, None) for r in b] for b in jumbled(rng, data, 100)]
    schema = "node long, sec long, id long, ok boolean, none string"
    with_ts = lambda df: df.select("node", "id", "ok", F.timestamp_seconds("sec").alias("ts"))
    df = spark.createDataFrame(data, "node long, sec long, id long, ok boolean")
    done = {r[2] for r in data if r[1] < final}
    rules = breaker.Rules(2, 2, 60)
    got = run_stream(spark, tmp_path / "a", lambda s: streams.circuit_breaker(with_ts(s), "100 seconds", rules), batches, schema)
    want = {r["id"]: (r["passed"], r["state"]) for r in breaker.decisions(df, rules).collect()}
    assert len(got) == len(done) and {r["id"]: (r["passed"], r["state"]) for r in got} == {k: want[k] for k in done}
    got = run_stream(spark, tmp_path / "b", lambda s: streams.node_states(with_ts(s), "100 seconds"), batches, schema)
    want = brute_states(sorted(data))
    assert len(got) == len(done) and {r["id"]: r["up"] for r in got} == {k: want[k] for k in done}
    # state of buckets that are full again goes, and makes no difference
    got = run_stream(spark, tmp_path / "c", lambda s: streams.token_bucket(with_ts(s).withColumnRenamed("node", "uid"), 2.0, 0.1, "100 seconds"), batches, schema)
    want, tokens, last = {}, {}, {}
    for node, sec, k, _ in sorted(data):
        t = min(2.0, tokens.get(node, 2.0) + (sec - last.get(node, sec)) * 0.1)
        want[k], tokens[node], last[node] = t >= 1, t - (t >= 1), sec
    assert len(got) == len(done) and {r["id"]: r["allowed"] for r in got} == {k: want[k] for k in done}


def test_refreshes_as_a_stream(spark, tmp_path):
    rng = random.Random(15)
    data = [(rng.randrange(8), rng.randrange(1000, 4000), k, rng.choice([None, 1500, 2500, 9000])) for k in range(300)]
    schema = "jti long, sec long, id long, exp long"
    make = lambda s: streams.refreshes(s.select("jti", "id", F.timestamp_seconds("sec").alias("ts"), F.timestamp_seconds("exp").alias("exp")), "100 seconds", 3000)
    got = run_stream(spark, tmp_path, make, jumbled(rng, data, 100), schema)
    want, used = {}, set()
    for jti, sec, k, exp in sorted(data, key=lambda r: (r[1], r[2])):
        want[k] = "invalid" if exp is None or sec >= exp else "revoked" if jti in used else "ok"
        used |= {jti} if want[k] == "ok" else set()
    final = max(r[1] for r in data) - 100
    assert {r["id"]: r["outcome"] for r in got} == {k: want[k] for _, sec, k, _ in data if sec < final} and set(want.values()) == {"ok", "revoked", "invalid"}


def test_state_of_ended_tokens_goes(spark, tmp_path):
    rows_ = [[(k, b * 1000 + 1000 + k, k, k % 3 == 0) for k in range(40)] for b in range(6)]
    schema = "jti long, sec long, id long, out boolean"
    for k, batch in enumerate(rows_):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:04d}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    timed = lambda kind: source.where(kind).select("jti", "id", F.timestamp_seconds("sec").alias("ts"))
    stream = streams.not_revoked(timed("NOT out"), timed("out").drop("id"), "100 seconds", "400 SECONDS")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    assert max(held) <= 3 * 40 and held[-1] <= max(held)  # of 240 rows, those of a batch or two are kept


def test_revocation_as_a_stream(spark, tmp_path):
    rng = random.Random(8)
    data = [(rng.randrange(12), rng.randrange(1000, 4000), k, rng.random() < 0.15) for k in range(400)]  # a stream begins with its watermark at 0
    schema = "jti long, sec long, id long, out boolean"
    make = lambda s: streams.not_revoked(s.where("NOT out").select("jti", "id", F.timestamp_seconds("sec").alias("ts")), s.where("out").select("jti", F.timestamp_seconds("sec").alias("ts")), "100 seconds", "400 SECONDS").select("id")
    got = sorted(r["id"] for r in run_stream(spark, tmp_path, make, jumbled(rng, data, 100), schema))
    outs = defaultdict(list)
    for jti, sec, _, out in data:
        if out:
            outs[jti].append(sec)
    final = min(max(r[1] for r in data if r[3] == kind) for kind in (True, False)) - 100
    clean = lambda jti, sec: not any(sec - 400 < o <= sec for o in outs[jti])
    want = sorted(k for jti, sec, k, out in data if not out and clean(jti, sec))
    assert set(got) <= set(want) and len(got) == len(set(got)) and {k for jti, sec, k, out in data if not out and clean(jti, sec) and sec < final} <= set(got)


def test_bucketed_percentiles_are_near(spark):
    from kvlake.operators import percentiles

    rng = random.Random(7)
    data = [(k * 7, rng.lognormvariate(3, 2) if k % 9 else rng.choice([0.0, -1.0, None])) for k in range(3000)]
    df = spark.createDataFrame(data, "sec long, latency_ms double").select(F.timestamp_seconds("sec").alias("ts"), "latency_ms").repartition(4)
    got = percentiles.sliding(df, "60 minutes", "20 minutes", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, 0.01)
    seen = 0
    for r in got.select(F.unix_seconds("start").alias("s"), "n", "p10", "p50", "p99").collect():
        own = sorted(max(x, 0.0) for t, x in data if x is not None and r["s"] <= t < r["s"] + 3600)
        assert r["n"] == len(own)
        for c, q in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            want = own[max(1, -int(-q * len(own) // 1)) - 1]
            assert abs(r[c] - want) <= 0.0101 * want
        seen += 1
    assert seen == len({(t // 1200) - k for t, _ in data for k in range(3)})
    # however many values there are, a sketch has no more buckets than their range has
    many = spark.range(50000).select(F.lit(5).cast("timestamp").alias("ts"), (F.pow(F.lit(10.0), F.col("id") % 13 - 3) * (1 + F.rand(1))).alias("latency_ms"))
    assert many.select(percentiles.bucket(F.col("latency_ms"), 0.01)).distinct().count() < 1500


def test_alerts_are_runs(spark, many_ranges):
    from kvlake.operators import percentiles

    values = [1, 9, 9, 1, None, 9, 9, 9, 1, 9]
    windows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "start long, p99 int").repartition(3)
    assert rows(percentiles.alerts(windows, "p99", 5, 2)) == [(1, 2, 2, 9), (5, 7, 3, 9)]
    assert rows(percentiles.alerts(windows, "p99", 5)) == [(1, 2, 2, 9), (5, 7, 3, 9), (9, 9, 1, 9)]
    assert percentiles.alerts(windows.limit(0), "p99", 5).count() == 0


def test_streamed_percentiles_and_latest_equal_batch(spark, tmp_path):
    from kvlake.operators import percentiles
    from kvlake.streaming import state

    rng = random.Random(9)
    data = [(rng.randrange(4), rng.randrange(1000, 9000), k, rng.lognormvariate(2, 1)) for k in range(800)]
    schema = "node long, sec long, id long, latency_ms double"
    timed = lambda s: s.select("node", "id", "latency_ms", F.timestamp_seconds("sec").alias("ts"))
    make = lambda s, late=None: percentiles.sliding(timed(s), "30 minutes", "10 minutes", {"p50": 0.5}, 0.01, late)
    got = run_stream(spark, tmp_path / "a", lambda s: make(s, "200 seconds"), jumbled(rng, data, 200), schema)
    final = max(r[1] for r in data) - 200
    batch = {r["start"]: (r["n"], r["p50"]) for r in make(spark.createDataFrame(data, schema)).where((F.unix_seconds("start") + 1800 <= final)).collect()}
    assert {r["start"]: (r["n"], r["p50"]) for r in got} == batch and len(got) == len(batch) > 8
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "a" / "in" / "*"))
    drained(state.latest(stream, "node", "sec"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), "update")
    seen = spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()
    best = {}
    for r in sorted(seen, key=lambda r: (r["sec"], r["node"], r["sec"], r["id"])):
        best[r["node"]] = r["id"]
    assert best == {n: max((s, n, s, k) for m, s, k, _ in data if m == n)[3] for n in range(4)} and len(seen) > 4


def test_families_are_read_apart(spark, tmp_path):
    from kvlake.operators import families

    ops = [(2, 0, "a", 1, "k", "v2", 20), (1, 1, "b", 1, "k", "w", 10), (1, 0, "a", 1, "k", "v1", 10), (2, 1, "b", 2, "k", "", 20), (3, 0, None, 1, "k", "none", 30), (3, 1, "a", 1, "x", "old", 1)]
    df = spark.createDataFrame(ops, "batch_id long, op_no long, family string, type int, key string, value string, at long").repartition(3)
    log = families.applied(df, 7).cache()
    assert [tuple(r) for r in log.select("seq", "family", "value").orderBy("seq").collect()] == [(8, "a", "v1"), (9, "b", "w"), (10, "a", "v2"), (11, "b", ""), (12, "", "none"), (13, "a", "old")]
    ttl = spark.createDataFrame([("a", 15), ("b", 0)], "family string, ttl long")
    assert rows(families.live(log, ttl, 30)) == [("", "k", 12, "none"), ("a", "k", 10, "v2")]
    assert rows(families.live(log, ttl, 30, snapshot=9)) == [("b", "k", 9, "w")]
    path = str(tmp_path / "log")
    families.write(log, path)
    own = families.read(spark, path, "a")
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "(family#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert {f.split("family=")[1].split("/")[0] for f in own.inputFiles()} <= {"a", "b", "__HIVE_DEFAULT_PARTITION__"}
    assert own.count() == 3 and families.read(spark, path, "").count() == 1 and families.read(spark, path).count() == 6
    assert families.dropped(log, spark.createDataFrame([("a",), ("a",)], "family string")).count() == 3


def test_next_upstream_at_each_time(spark, many_ranges):
    from kvlake.operators import upstreams

    rng = random.Random(13)
    fresh = lambda *hosts: [{"host": h, "port": 1, "healthy": rng.random() < 0.8} for h in hosts]
    changes = [("p", -1, 0, fresh("a", "b", "c"), None, None, None), ("q", 50, 0, fresh("x"), None, None, None), ("p", 120, 0, fresh("c", "d", "a", "a"), None, None, None)]
    changes += [(rng.choice("ppq"), rng.randrange(200), n + 1, None, rng.choice("abcdx"), 1, rng.random() < 0.5) for n in range(60)]
    asked = [(n, rng.choice("pppq"), rng.randrange(220)) for n in range(400)] + [(900, "none", 3), (901, None, 3)]
    pools, want = defaultdict(upstreams.Pool), {}
    order = sorted([(c[1], 0, c[2], c) for c in changes] + [(a[2], 1, a[0], a) for a in asked if a[1]], key=lambda x: x[:3])
    for _, side, _, x in order:
        pool = pools[x[1] if side else x[0]]
        if not side:
            pool.reload(x[3]) if x[3] is not None else pool.mark(*x[4:])
            continue
        n = len(pool.list)
        at = next((k % n for k in range(pool.turn, pool.turn + n) if pool.list[k % n]["healthy"]), None)
        want[x[0]] = None if at is None else pool.list[at]["host"]
        pool.turn = pool.turn if at is None else (at + 1) % n
    got = upstreams.picked(spark.createDataFrame(asked, "id long, pool string, at long").repartition(3), spark.createDataFrame(changes, f"pool string, at long, no long, list {upstreams.LIST}, host string, port long, up boolean").repartition(3))
    assert {r["id"]: r["host"] for r in got.collect()} == want and None in want.values() and len(set(want.values())) > 4


def test_lists_that_are_loaded_again(spark, many_ranges):
    """Lists by name; one pool has more changes than requests, one more requests, and one a list that nobody knows."""
    from kvlake.operators import upstreams

    rng = random.Random(14)
    lists = {k: [(f"h{rng.randrange(12)}", 1, rng.random() < 0.7) for _ in range(n)] for k, n in enumerate((20, 15, 0))}
    changes = [(p, rng.randrange(300), n, rng.choice([0, 1, 1, 2, None]) if n % 9 == 0 else None, f"h{rng.randrange(13)}", 1, rng.choice([True, False, None])) for n, p in enumerate("p" * 400 + "q" * 60)] + [("r", 5, 0, 7, None, None, None)]
    asked = [(n, rng.choice("pqqqqqr"), rng.randrange(320)) for n in range(900)]
    now, want = {p: [[], 0] for p in "pqr"}, {}
    for _, side, no, x in sorted([(c[1], 0, c[2], c) for c in changes] + [(a[2], 1, a[0], a) for a in asked], key=lambda x: x[:3]):
        pool = now[x[1] if side else x[0]]
        if side:
            places = [(pool[1] + k) % len(pool[0]) for k in range(len(pool[0]))]
            at = next((k for k in places if pool[0][k][2]), None)
            want[no] = None if at is None else pool[0][at][0]
            pool[1] = pool[1] if at is None else at + 1
        elif x[3] is not None:
            pool[:] = [lists.get(x[3], []), 0]
        else:
            pool[0] = [(h, p, bool(x[6]) if h == x[4] else up) for h, p, up in pool[0]]
    args = [spark.createDataFrame(asked, "id long, pool string, at int"), spark.createDataFrame(changes, "pool string, at long, no long, list int, host string, port long, up boolean"), spark.createDataFrame(list(lists.items()), f"list int, upstreams {upstreams.LIST}")]
    got = upstreams.picked(*(x.repartition(3) for x in args))
    assert {r["id"]: r["host"] for r in got.collect()} == want and None in want.values() and len(set(want.values())) > 9


def test_upstream_next_at_writes_no_list_at_each_load(spark, tmp_path):
    import os

    from kvlake.plans import extended

    spark.range(600).select(F.col("id").alias("s_suppkey"), F.lit(3).alias("s_nationkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    numbers = [97 * k + 5 for k in range(400)] + [97 * k + 8 for k in range(100)]  # 400 loads of the list backward, 100 requests
    spark.createDataFrame([(k, 3) for k in numbers], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(1000).select((F.col("id") * 97).alias("o_orderkey"), F.when(F.col("id") % 3 > 0, "F").otherwise("O").alias("o_orderstatus")).write.parquet(str(tmp_path / "orders.parquet"))
    size = lambda: sum(os.path.getsize(os.path.join(f, x)) for f, _, names in os.walk(spark.sparkContext.getCheckpointDir().removeprefix("file:")) for x in names)
    before = size()
    got = sorted(tuple(r) for r in extended.upstream_next_at(spark, str(tmp_path)).collect())
    assert got == [(97 * k + 8, 3, "599", 599) for k in range(100)]
    assert 0 < size() - before < 50_000


def test_subscribers_get_the_latest_and_then_changes(spark, tmp_path):
    from kvlake.streaming import state

    schema = "timestamp long, v int"
    for k, batch in enumerate([[(1, 1), (3, 3)], [(4, 4), (9, 9)], [(8, 8)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:04d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    state.subscribed(stream, spark.createDataFrame([(1, 1), (3, 3), (4, 4)], schema), 3, str(tmp_path / "out"), str(tmp_path / "c"))
    got = spark.read.schema("timestamp long, frame string, batch int").parquet(str(tmp_path / "out")).orderBy("batch", "timestamp").collect()
    assert [(r["batch"], r["frame"]) for r in got] == [(b, f'event: metrics\ndata: {{"timestamp":{t},"v":{t}}}') for b, t in ((0, 3), (1, 4), (1, 9), (2, 8))]
