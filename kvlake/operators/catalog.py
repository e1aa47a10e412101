"""Collection catalogue (name, ttl_seconds, schema, created_at, updated_at) and its change feed; users and API keys are kept the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored


def _latest(rows: DataFrame, key: str, order: list[str], first: bool = False) -> DataFrame:
    """One row of each key: the last in order, or the first. Spark combines rows of a key before they move."""
    pick = F.min_by if first else F.max_by
    return rows.groupBy(key).agg(pick(F.struct(*rows.columns), F.struct(*order)).alias("__row")).select("__row.*")


def created(catalog: DataFrame, new: DataFrame, key: str = "name", order: tuple[str, ...] = ("created_at",)) -> tuple[DataFrame, DataFrame]:
    """(catalogue with the new rows, new rows refused because the name was taken, by the catalogue or by an earlier one of the new rows). New rows are numbered once and written, as both results go by the numbers."""
    ranked = stored(new.withColumn("__row", F.monotonically_increasing_id()))
    free = ranked.join(catalog.select(key), key, "left_anti")
    won = _latest(free, key, [*order, "__row"], first=True)
    lost = ranked.join(won.select("__row"), "__row", "left_anti")
    return catalog.unionByName(won.drop("__row").select(*catalog.columns)), lost.drop("__row")


def found(catalog: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """Each asked name with its row and whether it was found; the row's columns are null where not."""
    return names.select(key).distinct().join(catalog.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def listed(catalog: DataFrame) -> DataFrame:
    """All rows, each with the number of rows."""
    return catalog.crossJoin(F.broadcast(catalog.agg(F.count("*").alias("count"))))  # one row


def updated(catalog: DataFrame, changes: DataFrame, columns: tuple[str, ...] = ("ttl_seconds", "schema", "updated_at"), key: str = "name", order: tuple[str, ...] = ("updated_at",)) -> tuple[DataFrame, DataFrame]:
    """(catalogue with `columns` replaced by those of each name's latest change, nulls included and all else kept; changes to names that are not there)."""
    last = _latest(changes, key, list(order)).select(key, F.struct(*columns).alias("__new"))
    out = catalog.join(last, key, "left")
    out = out.select(*(F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in catalog.columns))
    return out, changes.join(catalog.select(key), key, "left_anti")


def deleted(catalog: DataFrame, names: DataFrame, key: str = "name") -> tuple[DataFrame, DataFrame]:
    """(catalogue without the names, names that are not there)."""
    return catalog.join(names.select(key), key, "left_anti"), names.select(key).distinct().join(catalog.select(key), key, "left_anti")


def unexpired(catalog: DataFrame, now: int) -> DataFrame:
    """Rows whose time to live has not passed; 0 or null is forever."""
    return catalog.where(F.col("ttl_seconds").isNull() | (F.col("ttl_seconds") == 0) | (F.col("created_at") + F.col("ttl_seconds") > now))


def applied_feed(events: DataFrame) -> DataFrame:
    """(name, value) after events (event_no, op, name, value): the latest valid event of each name, where it puts. A put without a value is ignored, a delete of a missing name has no effect."""
    valid = events.where((F.col("op") == "DELETE") | F.col("value").isNotNull())
    return _latest(valid, "name", ["event_no"]).where("op = 'PUT'").select("name", "value")


def parsed_watch(raw: DataFrame, prefix: str) -> DataFrame:
    """Feed events (event_no, op, name, value) from raw (event_no, op, key, value): keys under the prefix, whose rest is the name whatever the JSON says; a value that is no JSON object, or has fields of other types, is null."""
    body = F.from_json("value", "name string, ttl_seconds int, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    whole = F.ltrim("value").startswith("{") & body["__bad"].isNull()
    return raw.where(F.col("key").startswith(prefix)).select("event_no", "op", F.expr(f"substring(key, {len(prefix) + 1})").alias("name"), F.when(whole, F.col("value")).alias("value"))
