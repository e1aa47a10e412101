"""Reads of the operation log: the newest visible version of each key, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import PUT
from .ordered import as_of


def newest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest version of each key, tombstones included; the snapshot filter comes before ranking."""
    if snapshot is not None:
        log = log.where(F.col("seq") <= snapshot)
    by = Window.partitionBy("user_key").orderBy(F.desc("seq"), "type")
    return log.withColumn("__at", F.row_number().over(by)).where("__at = 1").drop("__at")


def live(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Keys whose newest version is a write; the tombstone filter comes after ranking."""
    return newest(log, snapshot).where(F.col("type") == PUT)


def get(log: DataFrame, key: str, snapshot: int | None = None) -> DataFrame:
    return live(log.where(F.col("user_key") == key), snapshot)


def exact(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The very versions (user_key, seq, type) asked for, whatever came after them."""
    return log.join(keys.select("user_key", "seq", "type").distinct(), ["user_key", "seq", "type"], "left_semi")


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(user_key, value) for each asked key; a null value is not found. The log is cut to asked keys before ranking."""
    asked = keys.select("user_key").distinct()
    return asked.join(live(log.join(asked, "user_key", "left_semi")).select("user_key", "value"), "user_key", "left")


def snapshot_get(log: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (user_key, snapshot and others), each with the value that its key had at its own snapshot; null where the key had none or was deleted.

    Versions and requests go through one ordered pass by key and number, so a key with most of them is many
    tasks' work. A null key or snapshot finds nothing.
    """
    known = log.select("user_key", F.col("seq").alias("__seq"), F.col("type").alias("__type"), F.col("value").alias("__value"))
    found = as_of(asked, known, ["user_key"], F.col("snapshot"), F.col("__seq"), ["__type", "__value"], ties=(-F.col("__type"),))
    return found.select(*asked.columns, F.when(F.col("__type") == PUT, F.col("__value")).alias("value"))


def between(rows: DataFrame, start: str = "", end: str = "", closed: bool = False) -> DataFrame:
    """Half-open [start, end), or closed; an empty bound is none."""
    if start:
        rows = rows.where(F.col("user_key") >= start)
    if end:
        rows = rows.where(F.col("user_key") <= end if closed else F.col("user_key") < end)
    return rows


def scan(log: DataFrame, start: str = "", end: str = "", snapshot: int | None = None) -> DataFrame:
    """Live (user_key, value) of a range in key order; the bounds reach the scan as they are on the ranking's key."""
    return live(between(log, start, end), snapshot).select("user_key", "value").orderBy("user_key")


def prefix_scan(log: DataFrame, prefix: str) -> DataFrame:
    return live(log.where(F.col("user_key").startswith(prefix))).select("user_key", "value").orderBy("user_key")


def merged(*layers: DataFrame) -> DataFrame:
    """All versions of all layers in internal key order (key, newest first, type); of the same internal key the earlier layer's entry stays."""
    rows = None
    for k, layer in enumerate(layers):
        layer = layer.withColumn("layer", F.lit(k))
        rows = layer if rows is None else rows.unionByName(layer)
    same = Window.partitionBy("user_key", "seq", "type").orderBy("layer")
    return rows.withColumn("__at", F.row_number().over(same)).where("__at = 1").drop("__at").orderBy("user_key", F.desc("seq"), "type")


def frames(rows: DataFrame) -> DataFrame:
    """Server-sent frames of key-value rows in key order, and the end frame with their count; no rows are read twice but to count them."""
    data = rows.select(F.lit(0).alias("part"), "user_key", F.concat(F.lit("data: "), F.to_json(F.struct(F.col("user_key").alias("key"), "value"))).alias("frame"))
    end = rows.agg(F.lit(1).alias("part"), F.lit(None).cast("string").alias("user_key"), F.concat(F.lit('event: end\ndata: {"count":'), F.count("*").cast("string"), F.lit("}")).alias("frame"))
    return data.unionAll(end).orderBy("part", "user_key").select("frame")


def comparisons(a: Column, b: Column) -> dict[str, Column]:
    """The six comparisons of two byte strings, in byte order."""
    return {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}


def parsed_frames(frames: DataFrame) -> DataFrame:
    """(key, value) back from data frames."""
    body = F.from_json(F.expr("substring(frame, 7)"), "key string, value string")
    return frames.where(F.col("frame").startswith("data: ")).select(body.alias("kv")).select("kv.*")
