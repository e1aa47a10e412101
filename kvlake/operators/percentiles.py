"""Percentiles over sliding windows from sketches of panes, and alerts on them; the same over tables and streams.

A sketch counts values by buckets that widen by a constant factor, so a percentile is off by no more than
that factor's share of itself, sketches add up, and one has as many buckets as its range of values asks
for (at one percent some 1,400 for values from a thousandth to a billion), however many values there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import summed

#: Bucket of values that are not above 0.
ZERO = -(1 << 30)


def bucket(value: Column, accuracy: float) -> Column:
    """The bucket of a value: that k for which it lies above g ** (k - 1) and not above g ** k, g being (1 + accuracy) / (1 - accuracy)."""
    return F.when(value > 0, F.ceil(F.ln(value) / F.lit(math.log((1 + accuracy) / (1 - accuracy)))).cast("int")).otherwise(ZERO)


def middle(k: Column, accuracy: float) -> Column:
    """A bucket's value: none in it is further away than `accuracy` of itself."""
    g = (1 + accuracy) / (1 - accuracy)
    return F.when(k == ZERO, 0.0).otherwise(F.pow(F.lit(g), k.cast("double")) * (2 / (1 + g)))


def _at(share: float, accuracy: float) -> Column:
    """The percentile of a sketch (array of bucket and n, sorted; total): the bucket in which the running count first reaches share * total."""
    need = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("total")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("k"))
    step = lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.when(a["k"].isNull() & (a["n"] + x["n"] >= need), x["bucket"]).otherwise(a["k"]).alias("k"))
    return middle(F.aggregate("sketch", start, step)["k"], accuracy)


def sliding(requests: DataFrame, length: str, slide: str, shares: dict[str, float], accuracy: float = 0.01, late: str | None = None) -> DataFrame:
    """(start, n, and a column for each of shares) of latency_ms in each window of ts, `length` a multiple of `slide`.

    Each request is counted once, in its pane of `slide` and its bucket; windows add up their panes' buckets,
    so overlapping windows cost a row for each bucket and not for each request, and no buffer is longer
    than a sketch. For a stream give `late`; windows come once the watermark has passed them. Rows
    without a time or latency don't count.
    """
    rows = requests.where("ts IS NOT NULL AND latency_ms IS NOT NULL").select("ts", bucket(F.col("latency_ms").cast("double"), accuracy).alias("bucket"))
    rows = rows.withWatermark("ts", late) if late else rows
    panes = rows.groupBy(F.window("ts", slide).alias("pane"), "bucket").agg(F.count("*").alias("n"))
    windows = panes.groupBy(F.window(F.window_time("pane"), length, slide).alias("w"), "bucket").agg(F.sum("n").alias("n"))
    # windows end apart by `slide`, so each is the only one in the slot it ends with
    whole = windows.groupBy(F.window(F.window_time("w"), slide).alias("slot")).agg(F.sum("n").alias("total"), F.min("w.start").alias("start"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("sketch"))
    return whole.select("start", F.col("total").alias("n"), *(_at(s, accuracy).alias(c) for c, s in shares.items()))


def alerts(windows: DataFrame, column: str, above: float, least: int = 1) -> DataFrame:
    """(from, to, windows, worst) of the runs of windows (start and others) in which `column` is above a threshold, of `least` windows or more; to is the last one's start.

    A run's number is how many windows before it were not above; runs are found by an ordered pass over ranges.
    """
    rows = windows.where(F.col("start").isNotNull()).select("start", F.col(column).alias("value"), (~F.coalesce(F.col(column) > above, F.lit(False))).cast("long").alias("run"))
    runs = summed(rows, [], ["start"], ["run"]).where(F.col("value") > above)
    found = runs.groupBy("run").agg(F.min("start").alias("from"), F.max("start").alias("to"), F.count("*").alias("windows"), F.max("value").alias("worst"))
    return found.where(F.col("windows") >= least).drop("run")
