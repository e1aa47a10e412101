"""Ordered passes over rows of any number: running sums, last values, as-of joins.

Rows are dealt to ranges of their order, so that a key with most of them is spread like many keys. Each
range is passed by itself; what it hands on to later ranges is one row for each of its keys. Rows that
`ranged` has dealt by the same order already are passed as they lie, and stay so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

PART = "__part"


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with the number of the range they are in (__part), written once, as ranges are found from a sample."""
    return stored(rows.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def _passed(rows: DataFrame, by: list[str], order: list[str], names: list[str], inside, handed, before, joined) -> DataFrame:
    parts = rows if PART in rows.columns else ranged(rows, [*by, *order])
    own = Window.partitionBy(PART, *by).orderBy(*order)
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that the key is in
    ends = parts.groupBy(PART, *by).agg(*(handed(n).alias(n) for n in names))
    ends = ends.select(PART, *by, *(before(n).over(earlier).alias(f"__before_{n}") for n in names))
    out = parts.withColumns({f"__in_{n}": inside(n, own) for n in names}).join(ends, [PART, *by], "left")
    return out.select(*(joined(n).alias(n) if n in names else c for n, c in ((c, F.col(c)) for c in rows.columns)))


def carried(rows: DataFrame, by: list[str], order: list[str], names: list[str], own: bool = True) -> DataFrame:
    """rows with each of `names` replaced by its last value that is not null among the rows of equal `by` up to and with each in `order` (own=False: before each). `by` must not be null; rows of equal order are in any order."""
    to = 0 if own else -1
    return _passed(
        rows, by, order, names,
        lambda n, w: F.last(n, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, to)),
        lambda n: F.max_by(n, F.when(F.col(n).isNotNull(), F.struct(*order))),
        lambda n: F.last(n, ignorenulls=True),
        lambda n: F.coalesce(f"__in_{n}", f"__before_{n}"),
    )


def summed(rows: DataFrame, by: list[str], order: list[str], names: list[str], own: bool = True) -> DataFrame:
    """rows with each of `names` replaced by its sum over the rows of equal `by` up to and with each in `order` (own=False: before each)."""
    to = 0 if own else -1
    return _passed(
        rows, by, order, names,
        lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, to)), F.lit(0)),
        lambda n: F.sum(n),
        lambda n: F.sum(n),
        lambda n: F.col(f"__in_{n}") + F.coalesce(f"__before_{n}", F.lit(0)),
    )


def numbered(rows: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """rows with their place in `order` (from 0), among those of equal `by`."""
    return summed(rows.withColumn(name, F.lit(1).cast("long")), by or [], order, [name], own=False)


def as_of(asked: DataFrame, known: DataFrame, by: list[str], at: Column, known_at: Column, columns: list[str], ties: tuple[Column, ...] = (), closed: bool = True) -> DataFrame:
    """asked with `columns` of the last known row of equal `by` whose known_at is not above its own `at` (closed=False: is below it); nulls where there is none.

    Of known rows of one known_at the last by `ties` counts. Neither side is paired with the other: both go
    through one ordered pass, in which a request finds the last row before it. Rows whose `by` or `at` is
    null find nothing. `columns` must not be among those of asked.
    """
    ok = lambda x: F.forall(F.array(*(F.col(c).isNotNull() for c in by), x.isNotNull()), lambda v: v)
    side = 0 if closed else 1
    tie = [f"__tie_{k}" for k in range(len(ties))]
    kinds = dict(asked.dtypes)
    a = asked.where(ok(at)).select(*by, at.alias("__at"), F.lit(1 - side).alias("__side"), F.monotonically_increasing_id().alias("__row"), F.struct(*asked.columns).alias("__asked"))
    k = known.where(ok(known_at)).select(*by, known_at.alias("__at"), F.lit(side).alias("__side"), *(t.alias(n) for t, n in zip(ties, tie)), F.struct(*columns).alias("__known"))
    both = a.unionByName(k, allowMissingColumns=True)
    found = carried(both, by, ["__at", "__side", *tie, "__row"], ["__known"]).where("__asked IS NOT NULL")
    out = found.select(*(F.col("__asked")[c].alias(c) for c in asked.columns), *(F.col("__known")[c].alias(c) for c in columns))
    none = asked.where(~ok(at)).select(*asked.columns, *(F.lit(None).cast(t).alias(c) for c, t in known.select(*columns).dtypes))
    assert not set(columns) & set(kinds), "columns of both sides"
    return out.unionByName(none)
