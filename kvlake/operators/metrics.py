"""Metrics: the sample's formulas, latest values, rates and percentiles over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample(t: Column) -> list[Column]:
    """Columns of the sample at second t."""
    return [
        t.alias("timestamp"), (1000 + t % 500).cast("double").alias("qps"), (4 + t % 3).cast("double").alias("p50_ms"),
        (35 + t % 20).cast("double").alias("p99_ms"), F.round(12.3 + (t % 100) / 100, 6).alias("storage_gb"),
    ]


def latest(samples: DataFrame, by: str = "timestamp") -> DataFrame:
    return samples.agg(F.max_by(F.struct(*samples.columns), by).alias("s")).select("s.*")


def filled(samples: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Partial samples merged over the previous ones: the last known value of each column."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in columns})


def windowed(requests: DataFrame, length: str, slide: str | None = None, accuracy: int = 0) -> DataFrame:
    """Requests and percentiles of latency in each window of ts.

    Percentiles are exact, which keeps a window's different latencies in one task; with accuracy they are
    approximate, to the rank's share 1 / accuracy, and a window of any size is combined in bounded memory.
    """
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    at = lambda p: F.percentile_approx("latency_ms", F.lit(p), F.lit(accuracy)) if accuracy else F.percentile("latency_ms", F.lit(p))
    out = requests.groupBy(w.alias("w")).agg(F.count("*").alias("n"), at(0.5).alias("p50"), at(0.99).alias("p99"))
    return out.select(F.col("w.start").alias("start"), "n", "p50", "p99")


#: Fixed value: the form of a request's line in the log.
LOG_LINE = r"^\[GIN\] rid=(\S*) (\S+) (\S+) (\d+) ([0-9.]+)(ns|µs|ms|s) ip=(\S*)$"


def parsed_log(lines: DataFrame) -> DataFrame:
    """(rid, method, path, status, latency_ms, ip) of each line that has the form of a request's; other lines are left out."""
    part = lambda k: F.regexp_extract("line", LOG_LINE, k)
    unit = F.when(part(6) == "ns", 1e-6).when(part(6) == "µs", 1e-3).when(part(6) == "ms", 1.0).otherwise(1000.0)
    rows = lines.where(F.col("line").rlike(LOG_LINE))
    return rows.select(part(1).alias("rid"), part(2).alias("method"), part(3).alias("path"), part(4).cast("int").alias("status"), (part(5).cast("double") * unit).alias("latency_ms"), part(7).alias("ip"))


def node_health(probes: DataFrame, most: float = 0.25, down: float = 0.5) -> DataFrame:
    """(node, status): degraded where more than `most` of a node's probes (node, ok) failed, down where more than `down` did."""
    failed = F.count(F.when(~F.col("ok"), 1)) / F.count("*")
    return probes.groupBy("node").agg(F.when(failed > down, "down").when(failed > most, "degraded").otherwise("ok").alias("status"))


def overall_health(nodes: DataFrame) -> DataFrame:
    """(status, ok, degraded, down): the worst status of all nodes, ok without any, and how many have each."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1))
    return nodes.agg(F.when(of("down") > 0, "down").when(of("degraded") > 0, "degraded").otherwise("ok").alias("status"), *(of(s).alias(s) for s in ("ok", "degraded", "down")))


def update_frame(samples: DataFrame) -> Column:
    """A sample as the server-sent frame that subscribers get."""
    return F.concat(F.lit("event: metrics\ndata: "), F.to_json(F.struct(*samples.columns)))


def snapshot_then_changes(samples: DataFrame, at: int) -> DataFrame:
    """(timestamp, frame): what a subscriber gets who comes at second `at`, first the latest sample up to then and after that each new one, as server-sent frames."""
    first = samples.where(F.col("timestamp") <= at).agg(F.max("timestamp").alias("timestamp"))
    now = samples.join(F.broadcast(first), "timestamp", "left_semi")  # one row
    return now.unionByName(samples.where(F.col("timestamp") > at)).select("timestamp", update_frame(samples).alias("frame"))
