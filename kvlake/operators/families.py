"""Column families: one log and one numbering, kept apart by family so that a read touches its own files alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import PUT
from .ordered import numbered


def applied(ops: DataFrame, base: int) -> DataFrame:
    """Log rows (family, user_key, seq, type, value, at) of write batches (batch_id, op_no, family, type, key, value, at): consecutive numbers after base in batch and op order, whatever their families, so a batch is whole at one number in all of them. A null family is the empty one."""
    rows = numbered(ops, ["batch_id", "op_no"], "__n")
    return rows.select(F.coalesce("family", F.lit("")).alias("family"), F.col("key").alias("user_key"), (F.col("__n") + base + 1).alias("seq"), "type", F.when(F.col("type") == PUT, F.col("value")).otherwise("").alias("value"), "at")


def write(log: DataFrame, path: str) -> None:
    """The log (family and others) in a folder for each family, sorted by key and newest version in ranges, so that a large family is many files."""
    log.repartitionByRange("family", "user_key", "seq").sortWithinPartitions("family", "user_key", F.desc("seq")).write.mode("append").partitionBy("family").parquet(path)


def read(spark: SparkSession, path: str, family: str | None = None) -> DataFrame:
    """The log, or that of one family, whose folder alone is listed as files to read."""
    rows = spark.read.parquet(path).withColumn("family", F.coalesce(F.col("family").cast("string"), F.lit("")))
    return rows if family is None else spark.read.parquet(path).where(F.col("family") == family if family else F.col("family").isNull())


def live(log: DataFrame, families: DataFrame, now: int, snapshot: int | None = None) -> DataFrame:
    """(family, user_key, seq, value): of each key of each family the newest version up to the snapshot, where it is a write that its family's ttl (families: family, ttl; 0, null or absent is forever) has not ended by `now`.

    A version that ended hides older ones, as it did when it was written. Ties of one number go to the least type.
    """
    seen = log if snapshot is None else log.where(F.col("seq") <= snapshot)
    newest = seen.groupBy("family", "user_key").agg(F.max_by(F.struct("seq", "type", "value", "at"), F.struct("seq", -F.col("type"))).alias("v")).select("family", "user_key", "v.*").where(F.col("type") == PUT)
    ttl = F.coalesce("ttl", F.lit(0))
    rows = newest.join(families.groupBy("family").agg(F.max("ttl").alias("ttl")), "family", "left")
    return rows.where((ttl == 0) | (F.col("at") + ttl > now)).select("family", "user_key", "seq", "value")


def dropped(log: DataFrame, families: DataFrame) -> DataFrame:
    """The log without the families (family) that are dropped: whole folders, no tombstones."""
    return log.join(families.select("family").distinct(), "family", "left_anti")
