"""Range tombstones as an index: overlapping ranges become disjoint segments of the key order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .ordered import as_of, numbered


def segments(ranges: DataFrame) -> DataFrame:
    """(start, del_seq): the key order cut at all bounds of ranges (start, end, del_seq), end exclusive, and the greatest del_seq that covers each segment, null where none does.

    Bounds are numbered. A range is a run of numbers, which splits into nodes of a binary tree over them, at
    most two of each level; so a range that covers everything costs no more than its tree's height, and a
    segment is covered by what stands at the nodes above it. Ranges and segments are never paired.
    Empty ranges and those with a null bound or number cover nothing.
    """
    whole = ranges.where("start < end AND del_seq IS NOT NULL").groupBy("start", "end").agg(F.max("del_seq").alias("del_seq"))
    bounds = stored(numbered(whole.select(F.explode(F.array("start", "end")).alias("bound")).distinct(), ["bound"], "n"))
    spans = whole.join(bounds.select(F.col("bound").alias("start"), F.col("n").alias("a")), "start").join(bounds.select(F.col("bound").alias("end"), F.col("n").alias("b")), "end")
    # of level k: the nodes at the run's ends whose other half is outside the run
    nodes = F.expr("""flatten(transform(sequence(0, cast(floor(log2(b - a)) AS int)), k ->
        transform(array(named_struct('from', shiftright(a + shiftleft(1L, k) - 1, k), 'to', shiftright(b, k))), x ->
          filter(array(if(x.from < x.to AND x.from % 2 = 1, named_struct('level', k, 'node', x.from), null), if(x.from < x.to AND x.to % 2 = 1, named_struct('level', k, 'node', x.to - 1), null)), y -> y IS NOT NULL))[0]))""")
    cover = stored(spans.select(F.explode(nodes).alias("x"), "del_seq").groupBy("x.level", "x.node").agg(F.max("del_seq").alias("del_seq")))
    top = cover.agg(F.max("level")).first()[0]  # one number
    above = bounds.select("n", F.explode(F.sequence(F.lit(0), F.lit(top or 0))).alias("level")).withColumn("node", F.expr("shiftright(n, level)"))
    covered = above.join(cover, ["level", "node"]).groupBy("n").agg(F.max("del_seq").alias("del_seq"))
    return bounds.join(covered, "n", "left").select(F.col("bound").alias("start"), "del_seq")


def range_deleted(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows (user_key, seq) not covered by a newer range tombstone (start, end, del_seq), end exclusive, of any number of ranges. Rows without a key or number stay."""
    found = as_of(rows, segments(ranges).withColumnRenamed("del_seq", "__del_seq"), [], F.col("user_key"), F.col("start"), ["__del_seq"])
    return found.where("__del_seq IS NULL OR seq IS NULL OR seq >= __del_seq").drop("__del_seq")
