"""Input tables and the frames derived from them: operation log, catalogue edits, request log, nodes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUT, DELETE = 1, 2


def workspace(spark: SparkSession) -> str:
    """A new folder for what a job writes on its way, in the shared folder of the session (spark.checkpoint.dir); where that is unset, one of this machine's if Spark runs on it alone."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them see")
        shared = tempfile.mkdtemp(prefix="kvlake-")
    return f"{shared}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to a folder of its own and read back, so that what follows does not compute it again."""
    path = workspace(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, a file in each micro-batch. The path is a pattern, as a stream takes a table of a single file only by one."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/{name}.parque[t]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oplog(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """(user_key, seq, type, value): every event is a write to its user's key, an error a tombstone."""
    e = read(spark, sf_dir, "events")
    gone = F.col("event_type") == "error"
    return e.select(F.format_string("u%06d", "user_id").alias("user_key"), (F.col("event_id") + 1).alias("seq"), F.when(gone, DELETE).otherwise(PUT).alias("type"), F.when(gone, "").otherwise(F.col("props")).alias("value"))


def requests(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """(id, ts, sec, uid, method, latency_ms): events read as a request log."""
    e = read(spark, sf_dir, "events")
    method = F.when(F.col("event_type") == "view", "GET").when(F.col("event_type").isin("click", "purchase"), "POST").when(F.col("event_type") == "error", "DELETE").otherwise("HEAD")
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("event_id").alias("id"), ts.alias("ts"), F.unix_seconds(ts).alias("sec"), F.col("user_id").alias("uid"), method.alias("method"), F.col("value").alias("latency_ms"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edit_no, type 0 reset / 1 add / 2 remove, level, file_no, path): events read as manifest edits."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3000 == 0, 0).when(F.col("event_type") == "error", 2).otherwise(1)
    return e.select(F.col("event_id").alias("edit_no"), kind.alias("type"), (F.col("user_id") % 4).cast("int").alias("level"), F.col("user_id").alias("file_no"), F.format_string("%06d.sst", "user_id").alias("path"))


def write_sorted_run(log: DataFrame, path: str, codec: str = "zstd") -> None:
    """A flushed level: range-partitioned by key, sorted as versions are, with a bloom filter on the key, so that reads prune by min-max and by filter."""
    log.repartitionByRange("user_key").sortWithinPartitions("user_key", F.desc("seq"), "type").write.option("compression", codec).option("parquet.bloom.filter.enabled#user_key", "true").parquet(path)
