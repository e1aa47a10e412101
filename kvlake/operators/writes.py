"""Writes to the operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import DELETE, PUT
from .ordered import numbered
from .reads import live


class WriteBatch:
    """Operations to be written together, in order."""

    def __init__(self):
        self.ops: list[tuple[int, str, str]] = []

    def put(self, key: str, value: str) -> WriteBatch:
        self.ops.append((PUT, key, value))
        return self

    def delete(self, key: str) -> WriteBatch:
        self.ops.append((DELETE, key, ""))
        return self

    def clear(self) -> WriteBatch:
        self.ops.clear()
        return self

    def count(self) -> int:
        return len(self.ops)

    def rows(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """(batch_id, op_no, type, key, value), for `applied`."""
        return spark.createDataFrame([(batch_id, k, *op) for k, op in enumerate(self.ops)], "batch_id long, op_no long, type int, key string, value string")


def batch_counts(ops: DataFrame) -> DataFrame:
    """(batch_id, count) of batches given by their ops."""
    return ops.groupBy("batch_id").agg(F.count("*").alias("count"))


def applied(ops: DataFrame, base: int) -> DataFrame:
    """Log rows of write batches given as ops (batch_id, op_no, type, key, value): consecutive sequence numbers after base, in batch and op order.

    Ops are numbered by an ordered pass over ranges, which hand on their counts; no window sees more than a row for each range.
    """
    rows = numbered(ops, ["batch_id", "op_no"], "__n")
    return rows.select(F.col("key").alias("user_key"), (F.col("__n") + base + 1).cast("long").alias("seq"), "type", F.when(F.col("type") == PUT, F.col("value")).otherwise("").alias("value"))


def deletes(keys: DataFrame, base: int) -> DataFrame:
    """Tombstones for keys (user_key, ordinal), blind to whether they exist."""
    return keys.select("user_key", (F.col("ordinal") + base + 1).cast("long").alias("seq"), F.lit(DELETE).alias("type"), F.lit("").alias("value"))


def erased(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The log without the exact versions (user_key, seq, type)."""
    return log.join(keys, ["user_key", "seq", "type"], "left_anti")


def existing(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(user_key, existed) for each key to delete."""
    there = live(log).select("user_key", F.lit(True).alias("found"))
    return keys.select("user_key").distinct().join(there, "user_key", "left").select("user_key", F.coalesce("found", F.lit(False)).alias("existed"))
