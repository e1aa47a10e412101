"""The engine's queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashes
from ..operators import auth, catalog, metrics, policy, ranges, reads, storage, writes
from ..sources.tables import manifest, oplog, requests, streamed, table, workspace, write_sorted_run
from ..streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions of the SQL side.
LOG = """log AS (
  SELECT printf('u%06d', user_id) AS user_key, event_id + 1 AS seq,
         CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS type,
         CASE WHEN event_type = 'error' THEN '' ELSE props END AS value
  FROM events)"""
NEWEST = f"{LOG}, newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC, type) = 1), live AS (SELECT * FROM newest WHERE type = 1)"
REQUESTS = """requests AS (
  SELECT event_id AS id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sec, user_id AS uid, value AS latency_ms,
         CASE WHEN event_type = 'view' THEN 'GET' WHEN event_type IN ('click', 'purchase') THEN 'POST' WHEN event_type = 'error' THEN 'DELETE' ELSE 'HEAD' END AS method
  FROM events)"""
FILES = f"{LOG}, files AS (SELECT *, (seq - 1) // 1000 AS file_no, CAST(((seq - 1) // 1000) % 3 AS INTEGER) AS level FROM log)"


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- reads -----------------------------------------------------------------------------------------


@query(f"WITH {NEWEST} SELECT user_key, value FROM live")
def kv_live_scan(spark, d):
    return reads.scan(oplog(spark, d))


@query(f"WITH {LOG.replace('FROM events', 'FROM events WHERE event_id < 5000')}, n AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY seq DESC, type) = 1) SELECT user_key, value FROM n WHERE type = 1")
def kv_snapshot_scan(spark, d):
    return reads.scan(oplog(spark, d), snapshot=5000)


@query(f"WITH {NEWEST} SELECT user_key, seq, value FROM live WHERE user_key = 'u000042'")
def kv_point_get(spark, d):
    return reads.get(oplog(spark, d), "u000042").select("user_key", "seq", "value")


@query(f"WITH {NEWEST}, asked AS (SELECT DISTINCT printf('u%06d', c_custkey) AS user_key FROM customer) SELECT a.user_key, l.value FROM asked a LEFT JOIN live l USING (user_key)")
def kv_multi_get(spark, d):
    return reads.multi_get(oplog(spark, d), table(spark, d, "customer").select(F.format_string("u%06d", "c_custkey").alias("user_key")))


@query(f"WITH {LOG} SELECT user_key, seq, type, value FROM log WHERE type = 1")
def kv_exact_get(spark, d):
    log = oplog(spark, d)
    return reads.exact(log, log.select("user_key", "seq", F.lit(1).alias("type"))).select("user_key", "seq", "type", "value")


@query(f"WITH {NEWEST} SELECT user_key, value FROM live WHERE user_key >= 'u000010' AND user_key < 'u000050'")
def kv_scan_half_open(spark, d):
    return reads.scan(oplog(spark, d), "u000010", "u000050")


@query(f"WITH {NEWEST} SELECT user_key, value FROM live WHERE user_key >= 'u000100'")
def kv_scan_unbounded(spark, d):
    return reads.scan(oplog(spark, d), "u000100", "")


@query(f"WITH {FILES} SELECT user_key, seq, type, value FROM files WHERE file_no = 2 AND user_key BETWEEN 'u000010' AND 'u000050'")
def sst_scan_inclusive(spark, d):
    return reads.between(storage.with_files(oplog(spark, d)).where("file_no = 2"), "u000010", "u000050", closed=True).select("user_key", "seq", "type", "value").orderBy("user_key", F.desc("seq"), "type")


@query(f"WITH {FILES}, n AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY file_no, user_key ORDER BY seq DESC, type) = 1) SELECT file_no, user_key, seq FROM n WHERE type = 1")
def sst_newest_per_file(spark, d):
    by = Window.partitionBy("file_no", "user_key").orderBy(F.desc("seq"), "type")
    return storage.with_files(oplog(spark, d)).withColumn("at", F.row_number().over(by)).where("at = 1 AND type = 1").select("file_no", "user_key", "seq")


@query(f"WITH {NEWEST} SELECT user_key, value FROM live WHERE starts_with(user_key, 'u00001')")
def kv_prefix_scan(spark, d):
    return reads.prefix_scan(oplog(spark, d), "u00001")


@query(f"WITH {LOG} SELECT DISTINCT user_key, seq, type FROM log")
def kv_iter_all_versions(spark, d):
    log = oplog(spark, d)
    return reads.merged(log.where("seq % 3 != 0"), log.where("seq % 2 = 0"), log.where("seq % 3 = 0")).select("user_key", "seq", "type")


@query(f"WITH {LOG} SELECT user_key, seq, type FROM log WHERE user_key >= 'u000075'")
def kv_iter_seek(spark, d):
    log = oplog(spark, d)
    return reads.between(reads.merged(log), "u000075").select("user_key", "seq", "type")


@query(f"WITH {LOG} SELECT user_key, count(*) AS versions, count(CASE WHEN type = 2 THEN 1 END) AS tombstones FROM log GROUP BY user_key")
def kv_version_count(spark, d):
    return oplog(spark, d).groupBy("user_key").agg(F.count("*").alias("versions"), F.count(F.when(F.col("type") == 2, 1)).alias("tombstones"))


@query(f"WITH {NEWEST} SELECT type, count(*) AS keys FROM newest GROUP BY type")
def kv_tombstone_stats(spark, d):
    return reads.newest(oplog(spark, d)).groupBy("type").agg(F.count("*").alias("keys"))


@query(f"WITH {NEWEST} SELECT count(*) AS size FROM live")
def kv_size(spark, d):
    return reads.live(oplog(spark, d)).agg(F.count("*").alias("size"))


@query(f"""WITH {NEWEST} SELECT 'data: ' || CAST(json_object('key', user_key, 'value', value) AS VARCHAR) AS frame FROM live
UNION ALL SELECT 'event: end' || chr(10) || 'data: {{"count":' || count(*) || '}}' FROM live""")
def kv_scan_sse_frames(spark, d):
    return reads.frames(reads.live(oplog(spark, d)))


@query(f"WITH {NEWEST} SELECT user_key AS key, value FROM live")
def kv_sse_round_trip(spark, d):
    return reads.parsed_frames(reads.frames(reads.live(oplog(spark, d))))


@query(f"WITH {NEWEST} SELECT user_key, seq, md5(value) AS digest FROM newest WHERE seq > 100 AND type <> 2")
def kv_slice_compare(spark, d):
    return reads.newest(oplog(spark, d)).where("seq > 100 AND type != 2").select("user_key", "seq", F.md5("value").alias("digest"))


@query(f"""WITH {LOG}, p AS (SELECT user_key, value AS b, lag(value) OVER (PARTITION BY user_key ORDER BY seq) AS a FROM log)
SELECT user_key, count(CASE WHEN a = b THEN 1 END) AS eq, count(CASE WHEN a <> b THEN 1 END) AS ne, count(CASE WHEN a < b THEN 1 END) AS lt, count(CASE WHEN a <= b THEN 1 END) AS le, count(CASE WHEN a > b THEN 1 END) AS gt, count(CASE WHEN a >= b THEN 1 END) AS ge FROM p GROUP BY user_key""")
def kv_slice_order(spark, d):
    pairs = oplog(spark, d).select("user_key", F.col("value").alias("b"), F.lag("value").over(Window.partitionBy("user_key").orderBy("seq")).alias("a"))
    return pairs.groupBy("user_key").agg(*(F.count(F.when(c, 1)).alias(n) for n, c in reads.comparisons(F.col("a"), F.col("b")).items()))


# --- writes ----------------------------------------------------------------------------------------


OPS = "ops AS (SELECT o_custkey AS batch, o_orderkey, printf('c%06d', o_custkey) AS k, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS t, o_orderpriority AS v FROM orders)"


def batch_ops(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("op_no"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("type"), F.format_string("c%06d", "o_custkey").alias("key"), F.col("o_orderpriority").alias("value"))


@query(f"WITH {OPS} SELECT k AS user_key, 1000 + row_number() OVER (ORDER BY batch, o_orderkey) AS seq, t AS type, CASE WHEN t = 1 THEN v ELSE '' END AS value FROM ops")
def kv_batch_apply(spark, d):
    return writes.applied(batch_ops(spark, d), 1000)


@query(f"WITH {OPS} SELECT batch AS batch_id, count(*) AS count FROM ops GROUP BY batch")
def kv_batch_count(spark, d):
    return writes.batch_counts(batch_ops(spark, d))


@query(f"WITH {LOG} SELECT user_key, seq, type FROM log WHERE type <> 2")
def kv_erase_versions(spark, d):
    log = oplog(spark, d)
    return writes.erased(log, log.where("type = 2").select("user_key", "seq", "type")).select("user_key", "seq", "type")


@query(f"WITH {NEWEST}, keys AS (SELECT DISTINCT printf('u%06d', c_custkey) AS user_key FROM customer) SELECT k.user_key, l.user_key IS NOT NULL AS existed FROM keys k LEFT JOIN live l USING (user_key)")
def kv_delete_returning(spark, d):
    return writes.existing(oplog(spark, d), table(spark, d, "customer").select(F.format_string("u%06d", "c_custkey").alias("user_key")))


@query(f"WITH {NEWEST} SELECT user_key, value FROM live WHERE CAST(substr(user_key, 2) AS INTEGER) % 5 <> 0")
def kv_delete_then_scan(spark, d):
    log = oplog(spark, d)
    keys = log.select("user_key").distinct().where("cast(substring(user_key, 2) AS int) % 5 = 0").withColumn("ordinal", F.lit(0))
    base = log.agg(F.max("seq").alias("base"))
    dead = writes.deletes(keys, 0).crossJoin(F.broadcast(base)).withColumn("seq", F.col("seq") + F.col("base")).drop("base")  # one row
    return reads.scan(log.unionByName(dead))


@query(f"WITH {NEWEST} SELECT user_key, value FROM live WHERE NOT (user_key >= 'u000010' AND user_key < 'u000030' AND seq < 9000) AND NOT (user_key >= 'u000020' AND user_key < 'u000060' AND seq < 4000)")
def kv_range_delete(spark, d):
    dead = spark.createDataFrame([("u000010", "u000030", 9000), ("u000020", "u000060", 4000)], "start string, end string, del_seq long")
    return ranges.range_deleted(reads.live(oplog(spark, d)), dead).select("user_key", "value")


# --- storage ---------------------------------------------------------------------------------------


@query(f"WITH {FILES} SELECT level, file_no, min(user_key) AS min_key, max(user_key) AS max_key, count(*) AS n FROM files GROUP BY level, file_no")
def sst_file_stats(spark, d):
    return storage.file_stats(storage.with_files(oplog(spark, d)))


@query(f"""WITH {LOG}, sized AS (SELECT seq, CAST(coalesce(sum(strlen(user_key) + strlen(value) + 8) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM log)
SELECT before // 65536 AS run, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM sized GROUP BY 1""")
def lsm_flush_runs(spark, d):
    return storage.flush_runs(oplog(spark, d), 65536, block=4096)


@query(f"WITH {NEWEST} SELECT user_key, seq, type FROM newest")
def lsm_compact_l0(spark, d):
    return storage.compacted(oplog(spark, d), bottom=False).select("user_key", "seq", "type")


@query(f"WITH {NEWEST} SELECT user_key, seq, value FROM live")
def lsm_compact_bottom(spark, d):
    return storage.compacted(oplog(spark, d), bottom=True).select("user_key", "seq", "value")


@query(f"WITH {NEWEST} SELECT user_key, value FROM live")
def lsm_compact_level_live(spark, d):
    return reads.live(storage.compact_level(storage.with_files(oplog(spark, d)), 0, bottom=False)).select("user_key", "value")


@query(f"WITH {FILES} SELECT level, count(DISTINCT file_no) AS files, count(DISTINCT file_no) >= 4 AS due FROM files GROUP BY level")
def lsm_should_compact(spark, d):
    return storage.file_stats(storage.with_files(oplog(spark, d))).groupBy("level").agg(F.count("*").alias("files"), (F.count("*") >= 4).alias("due"))


MANIFEST = """edits AS (SELECT event_id AS edit_no, CASE WHEN event_id % 3000 = 0 THEN 0 WHEN event_type = 'error' THEN 2 ELSE 1 END AS type, CAST(user_id % 4 AS INTEGER) AS level, user_id AS file_no, printf('%06d.sst', user_id) AS path FROM events),
kept AS (SELECT * FROM edits WHERE type <> 0 AND edit_no > (SELECT coalesce(max(edit_no), -1) FROM edits WHERE type = 0) QUALIFY row_number() OVER (PARTITION BY level, path ORDER BY edit_no DESC) = 1)"""


@query(f"WITH {MANIFEST} SELECT level, file_no, path FROM kept WHERE type = 1")
def manifest_fold(spark, d):
    return storage.folded(manifest(spark, d))


@query(f"WITH {MANIFEST} SELECT level, count(*) AS files, max(file_no) + 1 AS next_file_no FROM kept WHERE type = 1 GROUP BY level")
def manifest_level_sizes(spark, d):
    return storage.folded(manifest(spark, d)).groupBy("level").agg(F.count("*").alias("files"), (F.max("file_no") + 1).alias("next_file_no"))


@query("SELECT event_id AS idx, user_id FROM events WHERE event_id < (SELECT coalesce(min(event_id), 1 << 62) FROM events WHERE event_id % 4000 = 3999)")
def wal_valid_prefix(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("idx"), "user_id", (F.col("event_id") % 4000 != 3999).alias("ok"))
    return storage.valid_prefix(log).select("idx", "user_id")


@query(f"WITH {FILES}, s AS (SELECT file_no, min(user_key) AS lo, max(user_key) AS hi FROM files GROUP BY file_no), k AS (SELECT DISTINCT printf('u%06d', c_custkey) AS user_key FROM customer) SELECT k.user_key, count(s.file_no) AS candidates FROM k LEFT JOIN s ON k.user_key BETWEEN s.lo AND s.hi GROUP BY k.user_key")
def lsm_read_candidates(spark, d):
    keys = table(spark, d, "customer").select(F.format_string("u%06d", "c_custkey").alias("user_key")).distinct()
    return storage.read_candidates(keys, storage.file_stats(storage.with_files(oplog(spark, d))))


@query(f"""WITH {FILES}, p AS (SELECT file_no, user_key, lag(user_key) OVER (PARTITION BY file_no ORDER BY user_key, seq DESC) AS prev FROM files)
SELECT file_no, count(*) AS n, CAST(sum(CASE WHEN prev IS NULL THEN 0 ELSE len(list_filter(range(1, 8), lambda k: substr(user_key, 1, k) = substr(prev, 1, k))) END) AS BIGINT) AS shared FROM p GROUP BY file_no""")
def block_prefix_stats(spark, d):
    return storage.shared_prefixes(storage.with_files(oplog(spark, d)))


@query("""WITH a AS (SELECT event_id AS access, user_id AS key, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
h AS (SELECT a.access, count(DISTINCT o.user_id) AS others FROM a LEFT JOIN events o ON o.event_id > a.prev AND o.event_id < a.access GROUP BY a.access)
SELECT a.access, a.key, a.prev IS NOT NULL AND h.others < 20 AS hit FROM a JOIN h USING (access)""")
def lru_hits(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("access"), F.col("user_id").alias("key"))
    return storage.lru_hits(e, 20)


@query(f"WITH {LOG} SELECT user_key, seq, type, value FROM log WHERE user_key >= 'u000020' AND user_key < 'u000040'")
def sorted_run_scan(spark, d):
    path = workspace(spark)
    write_sorted_run(oplog(spark, d), path)
    return reads.between(spark.read.parquet(path), "u000020", "u000040").select("user_key", "seq", "type", "value")


# --- hashes, codecs, sketches ----------------------------------------------------------------------


def murmur_sql(key: str, seed: int) -> str:
    """DuckDB's form of the hash over an ASCII string expression."""
    m, mask = 1540483477, 4294967295
    byte = lambda i: f"ascii(substr(key, CAST({i} AS INTEGER), 1))::BIGINT"
    word = "list_transform(range(0, strlen(key) // 4), lambda w: " + " + ".join(f"{byte(f'4 * w + {k + 1}')} * {256**k}" for k in range(4)) + ")"
    mixed = f"list_transform({word}, lambda x: xor((x * {m}) & {mask}, ((x * {m}) & {mask}) >> 24) * {m} & {mask})"
    fold = f"list_reduce(list_prepend(xor({seed}::BIGINT, strlen(key)), {mixed}), lambda h, k: xor((h * {m}) & {mask}, k))"
    n = "(strlen(key) // 4 * 4)"
    tail = f"(CASE WHEN strlen(key) % 4 >= 1 THEN {byte(n + ' + 1')} ELSE 0 END + CASE WHEN strlen(key) % 4 >= 2 THEN {byte(n + ' + 2')} * 256 ELSE 0 END + CASE WHEN strlen(key) % 4 = 3 THEN {byte(n + ' + 3')} * 65536 ELSE 0 END)"
    a = f"SELECT key, CAST({fold} AS BIGINT) AS h, CAST({tail} AS BIGINT) AS t FROM ({key})"
    b = f"SELECT key, CASE WHEN strlen(key) % 4 > 0 THEN (xor(h, t) * {m}) & {mask} ELSE h END AS h FROM ({a})"
    c = f"SELECT key, (xor(h, h >> 13) * {m}) & {mask} AS h FROM ({b})"
    return f"SELECT key, CAST(xor(h, h >> 15) AS BIGINT) AS h FROM ({c})"


NAMES = "SELECT c_name AS key FROM customer"


@query(f"SELECT key, h AS hash FROM ({murmur_sql(NAMES, 0)})")
def murmur2_keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_name").alias("key"), hashes.murmur2(F.col("c_name"), 0).alias("hash"))


@query(f"SELECT h % 64 AS bucket, count(*) AS n FROM ({murmur_sql(NAMES, 0)}) GROUP BY 1")
def hash_buckets(spark, d):
    return table(spark, d, "customer").groupBy((hashes.murmur2(F.col("c_name"), 0) % 64).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH b AS (SELECT h % 64 AS bucket, count(*) AS n FROM ({murmur_sql(NAMES, 0)}) GROUP BY 1) SELECT round(sum((n - e) * (n - e) / e) + (64 - count(*)) * max(e), 6) AS chi2 FROM b, (SELECT count(*) / 64.0::DOUBLE AS e FROM customer)")
def hash_bucket_chi2(spark, d):
    n = hash_buckets(spark, d)
    e = table(spark, d, "customer").agg((F.count("*") / 64).alias("e"))
    return n.crossJoin(F.broadcast(e)).agg(F.round(F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")) + (64 - F.count("*")) * F.max("e"), 6).alias("chi2"))  # one row


def bloom_sql(key: str) -> str:
    pair = f"SELECT a.key, a.h AS a, b.h AS b FROM ({murmur_sql(key, hashes.SEEDS[0])}) a JOIN ({murmur_sql(key, hashes.SEEDS[1])}) b ON a.key = b.key"
    k, per_key = hashes.bloom_parameters(1, 0.01)[0], hashes.bits_per_key(0.01)
    return f"SELECT p.key, (((p.a + i * p.b) & 4294967295) % ((SELECT greatest(count(*), 1) FROM supplier) * {per_key} // 8 + 1) // 1 * 1) AS pos, i FROM ({pair}) p, range(0, {k}) AS r(i)".replace("// 8 + 1) // 1 * 1", "// 8 * 8 + 8)")


@query(f"""WITH members AS (SELECT DISTINCT pos FROM ({bloom_sql("SELECT replace(s_name, 'Supplier', 'Customer') AS key FROM supplier")})), probes AS ({bloom_sql(NAMES)})
SELECT p.key, bool_and(m.pos IS NOT NULL) AS maybe FROM probes p LEFT JOIN members m ON p.pos = m.pos GROUP BY p.key""")
def bloom_probe(spark, d):
    members = table(spark, d, "supplier").select(F.regexp_replace("s_name", "Supplier", "Customer").alias("key"))
    return hashes.bloom_probed(table(spark, d, "customer").select(F.col("c_name").alias("key")), members, 0.01)


@query("""WITH m AS (SELECT p_partkey, (p_partkey + 1)::DOUBLE AS n, 0.01::DOUBLE AS p FROM part), b AS (SELECT *, -n * ln(p) / pow(ln(2), 2) AS bits FROM m)
SELECT p_partkey, round(bits, 6) AS bits, round(bits / n * ln(2), 6) AS hashes, round(pow(1 - exp(-(bits / n * ln(2)) * n / bits), bits / n * ln(2)), 6) AS fpr FROM b""")
def bloom_exact_math(spark, d):
    n, p = (F.col("p_partkey") + 1).cast("double"), F.lit(0.01)
    b = table(spark, d, "part").select("p_partkey", n.alias("n"), (-n * F.ln(p) / F.pow(F.ln(F.lit(2.0)), F.lit(2.0))).alias("bits"))
    k = F.col("bits") / F.col("n") * F.ln(F.lit(2.0))
    return b.select("p_partkey", F.round("bits", 6).alias("bits"), F.round(k, 6).alias("hashes"), F.round(F.pow(1 - F.exp(-k * F.col("n") / F.col("bits")), k), 6).alias("fpr"))


@query("""WITH RECURSIVE k AS (SELECT c_custkey, c_name, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM customer
  UNION ALL SELECT c_custkey, c_name, i + 1, CAST(list_reduce(list_prepend(xor(c, CAST(ascii(substr(c_name, i + 1, 1)) AS BIGINT)), CAST(range(0, 8) AS BIGINT[])), lambda x, j: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 2197175160::BIGINT ELSE 0::BIGINT END)) AS BIGINT) FROM k WHERE i < strlen(c_name))
SELECT c_name AS key, xor(c, 4294967295) AS crc FROM k WHERE i = strlen(c_name)""")
def crc32c_values(spark, d):
    return table(spark, d, "customer").select(F.col("c_name").alias("key"), hashes.crc32c(F.col("c_name")).alias("crc"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 ELSE 5 END AS size FROM (SELECT *, l_orderkey * l_partkey AS v FROM lineitem)")
def varint_length(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", hashes.varint_length(F.col("l_orderkey") * F.col("l_partkey")).alias("size"))


@query(f"""WITH {LOG}, b AS (SELECT user_key, seq, type, printf('%014x', seq) AS h FROM log)
SELECT user_key, seq, upper(hex(user_key) || printf('%02x', type) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS internal FROM b""")
def internal_key_hex(spark, d):
    return oplog(spark, d).select("user_key", "seq", hashes.internal_key_hex(F.col("user_key"), F.col("seq"), F.col("type")).alias("internal"))


@query("SELECT l_orderkey, l_linenumber, (l_orderkey * l_partkey) % 4294967296 AS fixed32, (l_orderkey * l_partkey) % 4294967296 AS varint, CAST(l_orderkey * l_partkey AS DECIMAL(20,0)) AS fixed64 FROM lineitem")
def codec_round_trip(spark, d):
    v = F.col("l_orderkey") * F.col("l_partkey")
    low = v % (1 << 32)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", hashes.fixed_value(hashes.fixed_hex(low, 4), 4).alias("fixed32"), hashes.varint_value(hashes.varint_hex(low)).alias("varint"), hashes.fixed_value(hashes.fixed_hex(v, 8), 8).alias("fixed64"))


@query(f"WITH {LOG} SELECT user_key, seq, type FROM log UNION ALL SELECT '', 0, 0 FROM orders WHERE strlen(o_orderpriority) < 8")
def internal_key_parts(spark, d):
    keys = oplog(spark, d).select(hashes.internal_key_hex(F.col("user_key"), F.col("seq"), F.col("type")).alias("internal"))
    short = table(spark, d, "orders").where(F.octet_length("o_orderpriority") < 8).select(F.hex(F.col("o_orderpriority").cast("binary")).alias("internal"))
    return keys.unionAll(short).select(*hashes.internal_key_parts(F.col("internal")))


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'OK' WHEN 1 THEN 'NotFound: ' WHEN 2 THEN 'Corruption: ' WHEN 3 THEN 'NotSupported: ' WHEN 4 THEN 'InvalidArgument: ' WHEN 5 THEN 'IOError: ' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS status,
CASE o_custkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'snappy' WHEN 2 THEN 'zstd' ELSE 'unknown' END AS compression FROM orders""")
def status_texts(spark, d):
    o = table(spark, d, "orders")
    message = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", hashes.status_text(F.col("o_orderkey") % 7, message).alias("status"), hashes.compression_name(F.col("o_custkey") % 4).alias("compression"))


# --- catalogue -------------------------------------------------------------------------------------

FEED = "feed AS (SELECT event_id AS event_no, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, printf('c%03d', user_id) AS name, CASE WHEN event_type = 'view' THEN NULL ELSE props END AS value FROM events)"


def feed(spark, d, read=table):
    e = read(spark, d, "events")
    return e.select(F.col("event_id").alias("event_no"), F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"), F.format_string("c%03d", "user_id").alias("name"), F.when(F.col("event_type") != "view", F.col("props")).alias("value"))


@query(f"WITH {FEED} SELECT name, value FROM (SELECT * FROM feed WHERE op = 'DELETE' OR value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY event_no DESC) = 1) WHERE op = 'PUT'")
def catalog_cdc_apply(spark, d):
    return catalog.applied_feed(feed(spark, d))


COLLECTIONS = "coll AS (SELECT c_name AS name, c_nationkey AS ttl_seconds, c_mktsegment AS segment, c_custkey AS created_at, CAST(0 AS BIGINT) AS updated_at FROM customer)"
NAMED = "ord AS (SELECT *, printf('Customer#%09d', o_custkey * 2) AS name FROM orders)"


def collections(spark, d):
    schema = F.create_map(F.lit("segment"), F.col("c_mktsegment"))
    return table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("ttl_seconds"), schema.alias("schema"), F.col("c_custkey").alias("created_at"), F.lit(0).cast("long").alias("updated_at"))


def named_orders(spark, d):
    """Orders with a name of which about half are collections'."""
    return table(spark, d, "orders").withColumn("name", F.format_string("Customer#%09d", F.col("o_custkey") * 2))


@query(f"""WITH {COLLECTIONS}, {NAMED}, f AS (SELECT o_orderkey AS created_at, name, name NOT IN (SELECT name FROM coll) AND row_number() OVER (PARTITION BY name ORDER BY o_orderkey) = 1 AS won FROM ord)
SELECT name, created_at, CASE WHEN won THEN 'created' ELSE 'taken' END AS outcome FROM f""")
def catalog_create_conflicts(spark, d):
    old = collections(spark, d)
    new = named_orders(spark, d).select("name", F.lit(1).alias("ttl_seconds"), F.create_map(F.lit("segment"), F.col("o_orderpriority")).alias("schema"), F.col("o_orderkey").alias("created_at"), F.lit(0).cast("long").alias("updated_at"))
    catalogue, taken = catalog.created(old, new)
    made = catalogue.join(old.select("name"), "name", "left_anti")
    return taken.select("name", "created_at", F.lit("taken").alias("outcome")).unionAll(made.select("name", "created_at", F.lit("created").alias("outcome")))


@query(f"WITH {COLLECTIONS}, {NAMED}, asked AS (SELECT DISTINCT name FROM ord) SELECT a.name, c.ttl_seconds, c.segment, c.name IS NOT NULL AS found FROM asked a LEFT JOIN coll c USING (name)")
def catalog_find(spark, d):
    return catalog.found(collections(spark, d), named_orders(spark, d)).select("name", "ttl_seconds", F.col("schema")["segment"].alias("segment"), "found")


@query(f"WITH {COLLECTIONS} SELECT name, ttl_seconds, (SELECT count(*) FROM coll) AS count FROM coll")
def catalog_list(spark, d):
    return catalog.listed(collections(spark, d)).select("name", "ttl_seconds", "count")


@query(f"""WITH {COLLECTIONS}, {NAMED}, last AS (SELECT * FROM ord QUALIFY row_number() OVER (PARTITION BY name ORDER BY o_orderkey DESC) = 1)
SELECT c.name, CASE WHEN l.name IS NULL THEN c.ttl_seconds ELSE 60 END AS ttl_seconds, CASE WHEN l.name IS NULL THEN c.segment WHEN l.o_orderstatus = 'F' THEN NULL ELSE l.o_orderpriority END AS segment, c.created_at, coalesce(l.o_orderkey, c.updated_at) AS updated_at, 'kept' AS outcome FROM coll c LEFT JOIN last l USING (name)
UNION ALL SELECT name, NULL, NULL, NULL, o_orderkey, 'not_found' FROM ord WHERE name NOT IN (SELECT name FROM coll)""")
def catalog_update(spark, d):
    schema = F.when(F.col("o_orderstatus") != "F", F.create_map(F.lit("segment"), F.col("o_orderpriority")))
    changes = named_orders(spark, d).select("name", F.lit(60).alias("ttl_seconds"), schema.alias("schema"), F.col("o_orderkey").alias("updated_at"))
    out, missing = catalog.updated(collections(spark, d), changes)
    out = out.select("name", "ttl_seconds", F.col("schema")["segment"].alias("segment"), "created_at", "updated_at", F.lit("kept").alias("outcome"))
    return out.unionByName(missing.select("name", "updated_at", F.lit("not_found").alias("outcome")), allowMissingColumns=True)


@query(f"""WITH {COLLECTIONS}, {NAMED}, gone AS (SELECT DISTINCT name FROM ord WHERE o_orderstatus = 'F')
SELECT name, 'kept' AS outcome FROM coll WHERE name NOT IN (SELECT name FROM gone) UNION ALL SELECT name, 'not_found' FROM gone WHERE name NOT IN (SELECT name FROM coll)""")
def catalog_delete(spark, d):
    left, missing = catalog.deleted(collections(spark, d), named_orders(spark, d).where("o_orderstatus = 'F'"))
    return left.select("name", F.lit("kept").alias("outcome")).unionAll(missing.select("name", F.lit("not_found").alias("outcome")))


@query(f"WITH {COLLECTIONS} SELECT name, ttl_seconds FROM coll WHERE ttl_seconds = 0 OR created_at + ttl_seconds > 500")
def catalog_ttl(spark, d):
    return catalog.unexpired(collections(spark, d), 500).select("name", "ttl_seconds")


@query(f"WITH {FEED}, raw AS (SELECT event_no, op, CASE WHEN event_no % 10 = 0 THEN '/other/' ELSE '/titles/' END || name AS key, CASE WHEN value IS NOT NULL AND event_no % 4 = 0 THEN 'broken' WHEN value IS NOT NULL AND event_no % 4 = 1 THEN CAST(json_object('ttl_seconds', event_no) AS VARCHAR) WHEN value IS NOT NULL THEN CAST(json_object('name', name, 'ttl_seconds', event_no) AS VARCHAR) END AS body, event_no % 4 <> 0 AND value IS NOT NULL AS fine FROM feed) SELECT event_no, op, substr(key, 9) AS name, CASE WHEN fine THEN CAST(regexp_extract(body, ':([0-9]+)', 1) AS INTEGER) END AS ttl_seconds FROM raw WHERE starts_with(key, '/titles/')")
def catalog_watch_parse(spark, d):
    f = feed(spark, d)
    key = F.concat(F.when(F.col("event_no") % 10 == 0, "/other/").otherwise("/titles/"), F.col("name"))
    ttl = F.col("event_no").alias("ttl_seconds")
    body = F.when(F.col("event_no") % 4 == 0, "broken").when(F.col("event_no") % 4 == 1, F.to_json(F.struct(ttl))).otherwise(F.to_json(F.struct("name", ttl)))
    parsed = catalog.parsed_watch(f.select("event_no", "op", key.alias("key"), F.when(F.col("value").isNotNull(), body).alias("value")), "/titles/")
    return parsed.select("event_no", "op", "name", F.get_json_object("value", "$.ttl_seconds").cast("int").alias("ttl_seconds"))


# --- metrics ---------------------------------------------------------------------------------------


@query("SELECT t AS timestamp, (1000 + t % 500)::DOUBLE AS qps, (4 + t % 3)::DOUBLE AS p50_ms, (35 + t % 20)::DOUBLE AS p99_ms, round(12.3::DOUBLE + (t % 100) / 100.0::DOUBLE, 6) AS storage_gb FROM (SELECT DISTINCT CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)")
def metrics_formula(spark, d):
    return requests(spark, d).select("sec").distinct().select(*metrics.sample(F.col("sec")))


@query("SELECT t AS timestamp, (1000 + t % 500)::DOUBLE AS qps FROM (SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) AS t FROM events)")
def metrics_current(spark, d):
    return metrics.latest(metrics_formula(spark, d)).select("timestamp", "qps")


@query(f"WITH {REQUESTS} SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM requests GROUP BY 1")
def reqlog_per_day(spark, d):
    return metrics.windowed(requests(spark, d), "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


@query(f"WITH {REQUESTS} SELECT make_timestamp((((sec // 60) - k) * 60) * 1000000) AS start, count(*) AS n FROM requests, range(0, 5) AS r(k) GROUP BY 1")
def reqlog_sliding(spark, d):
    return metrics.windowed(requests(spark, d), "5 minutes", "1 minute").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(f"WITH {REQUESTS} SELECT method, count(*) AS n, count(DISTINCT uid) AS users, round(sum(latency_ms), 2) AS total_ms FROM requests GROUP BY method")
def reqlog_methods(spark, d):
    return requests(spark, d).groupBy("method").agg(F.count("*").alias("n"), F.countDistinct("uid").alias("users"), F.round(F.sum("latency_ms"), 2).alias("total_ms"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS view_value, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS click_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def metrics_forward_fill(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", *(F.when(F.col("event_type") == t, F.col("value")).alias(f"{t}_value") for t in ("view", "click")))
    return metrics.filled(e, "user_id", "event_id", ["view_value", "click_value"])


NODES = "nodes AS (SELECT user_id AS node, CASE WHEN count(CASE WHEN event_type = 'error' THEN 1 END) * 2 > count(*) THEN 'down' WHEN count(CASE WHEN event_type = 'error' THEN 1 END) * 4 > count(*) THEN 'degraded' ELSE 'ok' END AS status FROM events GROUP BY user_id)"


@query(f"WITH {NODES} SELECT node, status FROM nodes")
def health_rollup(spark, d):
    return metrics.node_health(table(spark, d, "events").select(F.col("user_id").alias("node"), (F.col("event_type") != "error").alias("ok")))


@query(f"WITH {NODES} SELECT CASE WHEN count(CASE WHEN status = 'down' THEN 1 END) > 0 THEN 'down' WHEN count(CASE WHEN status = 'degraded' THEN 1 END) > 0 THEN 'degraded' ELSE 'ok' END AS status, count(CASE WHEN status = 'ok' THEN 1 END) AS ok, count(CASE WHEN status = 'degraded' THEN 1 END) AS degraded, count(CASE WHEN status = 'down' THEN 1 END) AS down FROM nodes")
def health_overall(spark, d):
    return metrics.overall_health(health_rollup(spark, d))


SAMPLES = "samples AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, count(*) AS n FROM events GROUP BY 1)"


@query(f"""WITH {SAMPLES} SELECT timestamp, 'event: metrics' || chr(10) || 'data: {{"timestamp":' || timestamp || ',"n":' || n || '}}' AS frame FROM samples
WHERE timestamp > 1704931200 OR timestamp = (SELECT max(timestamp) FROM samples WHERE timestamp <= 1704931200)""")
def metrics_snapshot_then_changes(spark, d):
    return metrics.snapshot_then_changes(requests(spark, d).groupBy(F.col("sec").alias("timestamp")).agg(F.count("*").alias("n")), 1704931200)


@query("SELECT 'r' || event_id AS rid, CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method, '/api/' || user_id AS path, CAST(200 + event_id % 310 AS INTEGER) AS status, round((event_id % 997) * CASE event_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1000.0::DOUBLE ELSE 0.001::DOUBLE END, 6) AS latency_ms, '10.0.0.' || (user_id % 256) AS ip FROM events WHERE event_id % 50 <> 0")
def reqlog_parse(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    unit = F.when(k % 3 == 0, "ms").when(k % 3 == 1, "s").otherwise("µs")
    line = F.format_string("[GIN] rid=r%d %s /api/%d %d %d%s ip=10.0.0.%d", k, F.when(F.col("event_type") == "view", "GET").otherwise("POST"), F.col("user_id"), 200 + k % 310, k % 997, unit, F.col("user_id") % 256)
    lines = e.select(F.when(k % 50 == 0, F.format_string("panic: %d", k)).otherwise(line).alias("line"))
    return metrics.parsed_log(lines).withColumn("latency_ms", F.round("latency_ms", 6))


# --- policies --------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {REQUESTS}, r AS (SELECT uid, sec, row_number() OVER (PARTITION BY uid ORDER BY sec, id) AS k FROM requests),
f AS (SELECT uid, k, sec, 1.0::DOUBLE AS tokens, 1 AS ok FROM r WHERE k = 1
  UNION ALL SELECT r.uid, r.k, r.sec, t - CASE WHEN t >= 1 THEN 1 ELSE 0 END, CASE WHEN t >= 1 THEN 1 ELSE 0 END
  FROM (SELECT r.uid, r.k, r.sec, least(2.0::DOUBLE, f.tokens + greatest(0, r.sec - f.sec) * 0.0001::DOUBLE) AS t FROM f JOIN r ON r.uid = f.uid AND r.k = f.k + 1) r)
SELECT uid, CAST(sum(ok) AS BIGINT) AS allowed, CAST(count(*) - sum(ok) AS BIGINT) AS denied FROM f GROUP BY uid""")
def token_bucket(spark, d):
    return policy.bucketed(requests(spark, d), 2.0, 0.0001)


ROLE = "CASE uid % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'writer' WHEN 2 THEN 'reader' ELSE 'guest' END"


@query(f"WITH {REQUESTS} SELECT id, role, method FROM (SELECT *, {ROLE} AS role FROM requests) WHERE method = 'HEAD' OR role = 'admin' OR role = 'writer' AND method IN ('GET', 'POST') OR role = 'reader' AND method = 'GET'")
def rbac_filter(spark, d):
    return policy.permitted(requests(spark, d).withColumn("role", F.expr(ROLE)), policy.role_permissions(spark)).select("id", "role", "method")


@query("SELECT event_id AS jti, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error' AND event_id + 500 > 4000)")
def revoked_anti(spark, d):
    e = table(spark, d, "events")
    revoked = e.where("event_type = 'error'").select(F.col("event_id").alias("jti"), (F.col("event_id") + 500).alias("expires"))
    return auth.not_revoked(e.select(F.col("event_id").alias("jti"), "user_id"), revoked, 4000)


@query("SELECT event_id AS id, c_custkey AS user_id, sha256('key-' || c_custkey) AS hash FROM events JOIN customer ON user_id = c_custkey WHERE c_custkey % 5 <> 0 AND (c_custkey % 3 <> 0 OR c_custkey > 60)")
def apikey_verify(spark, d):
    plain = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("plain"))
    c = table(spark, d, "customer")
    keys = c.select(F.sha2(F.concat(F.lit("key-"), F.col("c_custkey").cast("string")), 256).alias("hash"), F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 5 == 0).alias("revoked"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("expires_at"))
    return auth.verified_keys(plain, keys, c.select(F.col("c_custkey").alias("user_id")), 60).select("id", "user_id", "hash")


PATHS = "SELECT page_id AS id, coalesce(nullif(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages"


def paths(spark, d):
    path = F.regexp_extract("url", "^[^:]*://[^/?#]*([^?#]*)", 1)
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.when(path == "", "/").otherwise(path).alias("path"))


@query(f"SELECT id, path, CASE WHEN starts_with(path, '/en/') THEN 'english' WHEN starts_with(path, '/de/') THEN 'german' WHEN starts_with(path, '/fr') THEN 'french' ELSE '404' END AS target FROM ({PATHS})")
def route_prefix(spark, d):
    return policy.routed(paths(spark, d), [("/en/", "english"), ("/de/", "german"), ("/fr", "french")])


@query(f"SELECT id, path, CASE WHEN regexp_matches(path, '^/en/[^/]+$') THEN 'page' WHEN regexp_matches(path, '^/[^/]+/[^/]+$') THEN 'foreign' END AS target, CASE WHEN regexp_matches(path, '^/[^/]+/[^/]+$') THEN split_part(path, '/', 3) END AS page, CASE WHEN regexp_matches(path, '^/[^/]+/[^/]+$') AND NOT regexp_matches(path, '^/en/[^/]+$') THEN split_part(path, '/', 2) END AS lang FROM ({PATHS})")
def route_param(spark, d):
    found = policy.matched(paths(spark, d), [("/en/:page", "page"), ("/:lang/:page", "foreign")])
    return found.select("id", "path", "target", F.col("params")["page"].alias("page"), F.col("params")["lang"].alias("lang"))


@query("""WITH p AS (SELECT page_id, page_id % 7 AS k, split_part(url, ' ', 1) AS target, CASE WHEN instr(url, ' ') > 0 THEN substr(url, instr(url, ' ') + 1) || ' ' ELSE '' END || 'HTTP/1.1' AS version FROM pages)
SELECT page_id, CASE WHEN k = 6 THEN NULL WHEN page_id % 5 = 0 THEN 'POST' ELSE 'GET' END AS method, CASE WHEN k = 6 THEN NULL WHEN instr(target, '?') > 0 THEN substr(target, 1, instr(target, '?') - 1) ELSE target END AS path, CASE WHEN k = 6 THEN NULL WHEN instr(target, '?') > 0 THEN substr(target, instr(target, '?') + 1) ELSE '' END AS query,
CASE WHEN k <> 6 THEN version END AS version, CASE WHEN k <> 6 THEN 'b' || page_id END AS tag, CASE WHEN k >= 4 THEN NULL ELSE 'body ' || page_id END AS body, CASE WHEN k = 6 THEN 'more' WHEN k >= 4 THEN 'error' ELSE 'ok' END AS state FROM p""")
def http_request_parse(spark, d):
    pages = table(spark, d, "pages")
    k, body = F.col("page_id"), F.concat(F.lit("body "), F.col("page_id").cast("string"))
    line = F.concat(F.when(k % 5 == 0, "POST ").otherwise("GET "), "url", F.lit(" HTTP/1.1\r\n"))
    # of 7: 4 has a bad line in a head that is not all there, 5 one in a whole head, 6 no end of its head
    heads = F.concat(F.lit("X-Tag: a\r\nX-Tag: b"), k.cast("string"), F.when((k % 7 == 4) | (k % 7 == 5), "\r\nno colon").otherwise(""), F.lit("\r\nContent-Length: "), F.length(body).cast("string"))
    raw = F.concat(line, heads, F.when((k % 7 != 6) & (k % 7 != 4), F.concat(F.lit("\r\n\r\n"), body, F.lit("next"))).otherwise(""))
    got = policy.parsed_requests(pages.select("page_id", raw.alias("raw")))
    return got.select("page_id", "method", "path", "query", "version", F.col("headers")["X-Tag"].alias("tag"), "body", "state")


@query("SELECT page_id, CASE WHEN instr(url, '?') > 0 THEN substr(url, 1, instr(url, '?') - 1) ELSE url END AS path, CASE WHEN instr(url, '?') > 0 THEN substr(url, instr(url, '?') + 1) ELSE '' END AS query FROM pages")
def url_query_parse(spark, d):
    at = F.instr("url", "?")
    return table(spark, d, "pages").select("page_id", F.when(at > 0, F.expr("substring(url, 1, instr(url, '?') - 1)")).otherwise(F.col("url")).alias("path"), F.when(at > 0, F.expr("substring(url, instr(url, '?') + 1)")).otherwise("").alias("query"))


@query("SELECT event_id AS n, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS node FROM events")
def lb_round_robin(spark, d):
    return policy.balanced(table(spark, d, "events").select(F.col("event_id").alias("n")), ["a", "b", "c"])


@query("SELECT CASE event_id % 7 WHEN 2 THEN 'b' WHEN 4 THEN 'c' ELSE 'a' END AS node, count(*) AS picks FROM events GROUP BY 1")
def lb_smooth_weighted(spark, d):
    order = policy.smooth_weighted({"a": 5, "b": 1, "c": 1}, 7)
    return policy.balanced(table(spark, d, "events").select(F.col("event_id").alias("n")), order).groupBy("node").agg(F.count("*").alias("picks"))


@query("SELECT s_nationkey AS nation, arg_min(s_suppkey, (s_acctbal, s_suppkey)) AS node FROM supplier GROUP BY s_nationkey")
def lb_least_connections(spark, d):
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.min_by("s_suppkey", F.struct("s_acctbal", "s_suppkey")).alias("node"))


UPSTREAMS = "marks AS (SELECT l_suppkey AS port, arg_max(l_returnflag <> 'R', l_orderkey * 8 + l_linenumber) AS up FROM lineitem GROUP BY l_suppkey), ups AS (SELECT s_nationkey AS pool, s_suppkey AS idx, s_name AS host, s_suppkey AS port, coalesce(m.up, true) AS healthy FROM supplier LEFT JOIN marks m ON m.port = s_suppkey)"


def upstreams(spark, d):
    ups = table(spark, d, "supplier").select(F.col("s_nationkey").alias("pool"), F.col("s_suppkey").alias("idx"), F.col("s_name").alias("host"), F.col("s_suppkey").alias("port"), F.lit(True).alias("healthy"))
    l = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("mark_no"), F.col("l_suppkey").alias("port"), (F.col("l_returnflag") != "R").alias("up"))
    marks = l.join(ups.select("host", "port"), "port")
    return policy.marked(ups, marks)


@query(f"WITH {UPSTREAMS} SELECT host, port, healthy FROM ups")
def upstream_marks(spark, d):
    return upstreams(spark, d).select("host", "port", "healthy")


@query(f"""WITH {UPSTREAMS}, h AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY idx) - 1 AS turn, count(*) OVER (PARTITION BY pool) AS many FROM ups WHERE healthy), r AS (SELECT c_custkey AS id, c_nationkey AS pool, c_custkey AS n FROM customer)
SELECT r.id, h.host FROM r LEFT JOIN h ON h.pool = r.pool AND h.turn = r.n % h.many""")
def upstream_next(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("pool"), F.col("c_custkey").alias("n"))
    return policy.next_upstreams(asked, upstreams(spark, d)).select("id", "host")


RING = f"SELECT h AS hash, min(node) AS node FROM (SELECT key, h, split_part(key, ':', 1) AS node FROM ({murmur_sql('SELECT s_name || chr(58) || i AS key FROM supplier, range(0, 40) AS r(i)', 0)})) GROUP BY h"


@query(f"WITH ring AS ({RING}), k AS ({murmur_sql(NAMES, 0)}) SELECT k.key, coalesce(r.node, (SELECT arg_min(node, hash) FROM ring)) AS node FROM k ASOF LEFT JOIN ring r ON k.h <= r.hash")
def ring_lookup(spark, d):
    ring = policy.ring(table(spark, d, "supplier").select(F.col("s_name").alias("node")), 40)
    return policy.on_ring(table(spark, d, "customer").select(F.col("c_name").alias("key")), ring)


@query("""WITH p AS (SELECT user_id AS node, event_id AS id, event_type <> 'error' AS ok FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY id) - row_number() OVER (PARTITION BY node, ok ORDER BY id) AS run FROM p)
SELECT node, ok, min(id) AS "from", count(*) AS n, CASE WHEN ok AND count(*) >= 2 THEN 'up' WHEN NOT ok AND count(*) >= 3 THEN 'down' END AS sets FROM g GROUP BY node, ok, run""")
def health_islands(spark, d):
    return policy.health(table(spark, d, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok")))


@query("SELECT event_id AS id, CAST(pow(2, event_id % 6) * 100 AS BIGINT) AS wait_ms FROM events")
def backoff_schedule(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), policy.backoff_ms(F.col("event_id") % 6).alias("wait_ms"))


@query("""WITH s AS (SELECT CAST(200 + event_id % 310 AS INTEGER) AS status, CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method FROM events)
SELECT CASE WHEN status < 400 THEN 'ok' WHEN status = 400 THEN 'bad_request' WHEN status = 401 THEN 'unauthorized' WHEN status = 403 THEN 'forbidden' WHEN status = 404 THEN 'not_found' WHEN status = 409 THEN 'conflict' WHEN status = 429 THEN 'rate_limited' ELSE 'internal' END AS class,
count(*) AS n, count(CASE WHEN method = 'GET' AND (status >= 500 OR status = 429) THEN 1 END) AS retries FROM s GROUP BY 1""")
def http_error_class(spark, d):
    s = table(spark, d, "events").select((200 + F.col("event_id") % 310).cast("int").alias("status"), F.when(F.col("event_type") == "view", "GET").otherwise("POST").alias("method"))
    return s.groupBy(policy.error_class(F.col("status")).alias("class")).agg(F.count("*").alias("n"), F.count(F.when(policy.retried(F.col("status"), F.col("method")), 1)).alias("retries"))


@query("SELECT event_id AS id, coalesce(CASE WHEN user_id % 10 = 0 THEN 401 END, CASE WHEN event_type = 'error' THEN 429 END, 200) AS status FROM events")
def middleware_status(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.coalesce(F.when(F.col("user_id") % 10 == 0, 401), F.when(F.col("event_type") == "error", 429), F.lit(200)).alias("status"))


@query("SELECT event_id AS id, CAST(greatest(1, ceil(value / 10)) AS BIGINT) AS ticks FROM events WHERE value IS NOT NULL")
def timer_ticks(spark, d):
    return table(spark, d, "events").where("value IS NOT NULL").select(F.col("event_id").alias("id"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("value") / 10).cast("long")).alias("ticks"))


@query("SELECT conv_id, lower(role) AS header, arg_max(text, turn) AS value FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, lower(role)")
def headers_last_value(spark, d):
    return policy.last_headers(table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.col("role").alias("name"), F.col("text").alias("value"))).select(F.col("id").alias("conv_id"), "header", "value")


@query(f"WITH {REQUESTS} SELECT id, CASE WHEN uid % 9 = 0 THEN 'rl:ip:' || (uid % 256) ELSE 'rl:uid:' || uid END AS key FROM requests")
def rate_limit_keys(spark, d):
    uid = F.when(F.col("uid") % 9 != 0, F.col("uid"))
    return requests(spark, d).select("id", policy.limit_key(uid, F.col("uid") % 256).alias("key"))


@query(f"WITH {REQUESTS}, k AS (SELECT sec, CASE WHEN uid % 9 = 0 THEN 'rl:ip:10.0.0.' || (uid % 256) ELSE 'rl:uid:' || uid END AS key FROM requests) SELECT key, max(sec) AS last, max(sec) + 1334 AS expires FROM k GROUP BY key")
def rate_limit_states(spark, d):
    r = requests(spark, d)
    return policy.limit_states(r.select(F.when(F.col("uid") % 9 != 0, F.col("uid")).alias("uid"), F.concat(F.lit("10.0.0."), (F.col("uid") % 256).cast("string")).alias("ip"), "sec"), 2.0, 0.003)


# --- who a request is from -------------------------------------------------------------------------

AUTH = """tokens AS (SELECT c_custkey AS jti, c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'writer' WHEN 2 THEN 'reader' ELSE 'guest' END AS role, 100 + c_custkey * 7 % 1000 AS exp FROM customer),
keys AS (SELECT c_custkey AS id, c_custkey AS user_id, sha256('key-' || c_custkey) AS hash, 'key ' || c_name AS name, c_custkey AS created_at, CASE WHEN c_custkey % 3 > 0 THEN c_custkey + c_custkey % 3 * 100 END AS expires_at, c_custkey % 11 = 0 AS revoked FROM customer)"""


def tokens(spark, d):
    role = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'writer' WHEN 2 THEN 'reader' ELSE 'guest' END")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("jti"), F.col("c_custkey").alias("user_id"), role.alias("role"), (100 + F.col("c_custkey") * 7 % 1000).alias("exp"))


def api_keys(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    keys = auth.issued(c.select(k.alias("id"), k.alias("user_id"), F.concat(F.lit("key "), "c_name").alias("name"), F.concat(F.lit("key-"), k.cast("string")).alias("plain"), k.alias("at"), (k % 3 * 100).alias("ttl")))
    return auth.revoked(keys, c.where("c_custkey % 11 = 0").select(k.alias("id")))[0]


@query(f"WITH {AUTH} SELECT id, user_id, hash, name, created_at, expires_at, revoked FROM keys")
def apikey_issue_revoke(spark, d):
    return api_keys(spark, d)


@query("SELECT DISTINCT o_custkey * 2 AS id FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)")
def apikey_revoke_missing(spark, d):
    return auth.revoked(api_keys(spark, d), table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("id")))[1]


@query(f"WITH {AUTH} SELECT id, user_id, '' AS hash, name FROM keys WHERE user_id IN (SELECT user_id FROM events)")
def apikey_list(spark, d):
    return auth.keys_of(api_keys(spark, d), table(spark, d, "events").select("user_id")).select("id", "user_id", "hash", "name")


@query(f"""WITH {AUTH}, r AS (SELECT event_id AS id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS jti, CASE WHEN event_id % 2 = 0 THEN 'key-' || (user_id * 3) END AS api_key FROM events),
b AS (SELECT DISTINCT t.jti FROM events e JOIN tokens t ON t.jti = e.user_id WHERE e.event_type = 'error' AND e.event_id % 100 = 7 AND t.exp > 400),
j AS (SELECT r.id, t.user_id AS t_user, t.role AS t_role, b.jti IS NOT NULL AS gone, k.user_id AS k_user, u.role AS k_role FROM r LEFT JOIN tokens t ON t.jti = r.jti AND t.exp > 400 LEFT JOIN b ON b.jti = r.jti LEFT JOIN keys k ON k.hash = sha256(r.api_key) AND NOT k.revoked AND (k.expires_at IS NULL OR k.expires_at > 400) LEFT JOIN tokens u ON u.user_id = k.user_id)
SELECT id, CASE WHEN t_user IS NOT NULL AND NOT gone THEN t_user WHEN t_user IS NULL THEN k_user END AS user_id, CASE WHEN t_user IS NOT NULL AND NOT gone THEN t_role WHEN t_user IS NULL THEN k_role END AS role,
CASE WHEN t_user IS NOT NULL AND NOT gone THEN 'jwt' WHEN t_user IS NULL AND k_user IS NOT NULL THEN 'apikey' END AS auth_method, CASE WHEN t_user IS NOT NULL AND NOT gone OR t_user IS NULL AND k_user IS NOT NULL THEN 200 ELSE 401 END AS status FROM j""")
def auth_choice(spark, d):
    e, t = table(spark, d, "events"), tokens(spark, d)
    k = F.col("event_id")
    asked = e.select(k.alias("id"), F.when(k % 3 != 0, F.col("user_id")).alias("jti"), F.when(k % 2 == 0, F.concat(F.lit("key-"), (F.col("user_id") * 3).cast("string"))).alias("api_key"))
    out = e.where((F.col("event_type") == "error") & (k % 100 == 7)).select(F.col("user_id").alias("jti"), F.lit(0).alias("at"))
    return auth.identified(asked, t, auth.logged_out(out, t), api_keys(spark, d), t.select("user_id", "role"), 400)


@query(f"""WITH {AUTH}, a AS (SELECT o_orderkey AS id, o_custkey AS jti, o_orderkey % 1200 AS used FROM orders), v AS (SELECT a.*, t.user_id, coalesce(a.used < t.exp, false) AS valid FROM a LEFT JOIN tokens t USING (jti)),
n AS (SELECT *, valid AND row_number() OVER (PARTITION BY jti, valid ORDER BY used, id) = 1 AS first_use FROM v)
SELECT id, CASE WHEN NOT valid THEN 'invalid' WHEN NOT first_use THEN 'revoked' WHEN user_id % 13 = 0 THEN 'no_user' ELSE 'ok' END AS outcome FROM n""")
def token_refresh(spark, d):
    attempts = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("jti"), (F.col("o_orderkey") % 1200).alias("at"))
    t = tokens(spark, d)
    return auth.refreshed(attempts, t, t.where("user_id % 13 != 0").select("user_id"))


@query(f"WITH {AUTH}, l AS (SELECT o_custkey AS jti, o_orderkey % 1200 AS used FROM orders) SELECT DISTINCT jti, exp AS expires FROM l JOIN tokens USING (jti) WHERE exp > used")
def token_logout(spark, d):
    return auth.logged_out(table(spark, d, "orders").select(F.col("o_custkey").alias("jti"), (F.col("o_orderkey") % 1200).alias("at")), tokens(spark, d))


def users(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.md5("c_name").alias("password_hash"), F.lit("reader").alias("role"), F.col("c_custkey").alias("created_at"), F.lit(0).cast("long").alias("updated_at"))


@query(f"""WITH {NAMED}, f AS (SELECT *, name NOT IN (SELECT c_name FROM customer) AND row_number() OVER (PARTITION BY name ORDER BY o_orderkey) = 1 AS won FROM ord), role AS (SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS role, max(o_orderkey) AS at FROM orders GROUP BY o_custkey)
SELECT c_custkey AS id, c_name AS username, coalesce(r.role, 'reader') AS role, coalesce(r.at, 0) AS updated_at FROM customer LEFT JOIN role r ON r.id = c_custkey
UNION ALL SELECT o_orderkey + 1000000000, name, 'writer', 0 FROM f WHERE won""")
def user_store(spark, d):
    new = named_orders(spark, d).select((F.col("o_orderkey") + 1_000_000_000).alias("id"), F.col("name").alias("username"), F.md5("name").alias("password_hash"), F.lit("writer").alias("role"), F.col("o_orderkey").alias("created_at"), F.lit(0).cast("long").alias("updated_at"))
    all_users, _ = auth.users_created(users(spark, d), new)
    changes = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("role"), F.col("o_orderkey").alias("updated_at"))
    return auth.users_listed(auth.roles_set(all_users, changes)[0]).select("id", "username", "role", "updated_at")


@query(f"WITH {NAMED} SELECT DISTINCT o.name AS username, c.c_custkey AS id, c.c_name IS NOT NULL AS found FROM ord o LEFT JOIN customer c ON c.c_name = o.name")
def user_find(spark, d):
    return catalog.found(users(spark, d), named_orders(spark, d).select(F.col("name").alias("username")), key="username").select("username", "id", "found")


# --- streams: run over all that is there, then compared with batch ------------------------------------


def ran(stream: DataFrame, mode: str) -> DataFrame:
    spark, path = stream.sparkSession, workspace(stream.sparkSession)
    state.drained(stream, f"{path}/out", f"{path}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)


@query(f"WITH {NEWEST} SELECT user_key, seq, value FROM live")
def stream_kv_state(spark, d):
    return reads.live(ran(state.newest_state(oplog(spark, d, streamed)), "update")).select("user_key", "seq", "value")


@query(ORACLES["token_bucket"])
def stream_token_bucket(spark, d):
    done = ran(state.token_bucket(requests(spark, d, streamed).select("uid", "id", "sec"), 2.0, 0.0001), "append")
    return done.groupBy("uid").agg(F.count(F.when(F.col("allowed"), 1)).alias("allowed"), F.count(F.when(~F.col("allowed"), 1)).alias("denied"))


@query(ORACLES["catalog_cdc_apply"])
def stream_cdc(spark, d):
    return catalog.applied_feed(ran(state.feed_state(feed(spark, d, streamed)), "update"))
