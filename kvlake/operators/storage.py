"""Storage life cycle as dataflow: runs, levels, compaction, manifest, log recovery."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import PUT, stored
from .reads import newest


def with_files(log: DataFrame, rows_per_file: int = 1000, levels: int = 3) -> DataFrame:
    """The log with the sorted run (file_no) and level each row lies in."""
    return log.withColumn("file_no", F.floor((F.col("seq") - 1) / rows_per_file).cast("long")).withColumn("level", (F.col("file_no") % levels).cast("int"))


def file_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("level", "file_no").agg(F.min("user_key").alias("min_key"), F.max("user_key").alias("max_key"), F.count("*").alias("n"))


def flush_runs(log: DataFrame, threshold: int, block: int = 1 << 16) -> DataFrame:
    """(run, n, first_seq, last_seq): the run that fills when the running size of writes passes each threshold.

    Sizes are summed within blocks of sequence numbers first, so that the one ordered window sees a row per block.
    """
    rows = log.select("seq", (F.octet_length("user_key") + F.octet_length("value") + 8).cast("long").alias("bytes"), F.floor(F.col("seq") / block).alias("block"))
    sums = rows.groupBy("block").agg(F.sum("bytes").alias("bytes")).withColumn("before", F.coalesce(F.sum("bytes").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("bytes").over(Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    rows = rows.withColumn("at", inside).join(sums.select("block", "before"), "block")
    return rows.groupBy(F.floor((F.col("before") + F.col("at")) / threshold).alias("run")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def compacted(log: DataFrame, bottom: bool) -> DataFrame:
    """The newest version of each key of the inputs; tombstones go only at the bottom level, above it they still hide older versions below."""
    rows = newest(log)
    return rows.where(F.col("type") == PUT) if bottom else rows


def compact_level(log: DataFrame, level: int, bottom: bool) -> DataFrame:
    """Level `level` merged with the files of the next level that its key range overlaps, as rows of the next level; other files unchanged."""
    stats = file_stats(log)
    span = stats.where(F.col("level") == level).agg(F.min("min_key").alias("low"), F.max("max_key").alias("high"))
    taken = stats.join(F.broadcast(span), (F.col("level") == level) | (F.col("level") == level + 1) & (F.col("max_key") >= F.col("low")) & (F.col("min_key") <= F.col("high")), "left_semi").select("level", "file_no")
    inputs, others = log.join(taken, ["level", "file_no"], "left_semi"), log.join(taken, ["level", "file_no"], "left_anti")
    return others.unionByName(compacted(inputs, bottom).withColumn("level", F.lit(level + 1)))


def folded(edits: DataFrame) -> DataFrame:
    """Live files of a manifest (edit_no, type, level, file_no, path): after the last reset, the latest edit of each path in a level, where it adds."""
    reset = edits.where("type = 0").agg(F.coalesce(F.max("edit_no"), F.lit(-1)).alias("reset"))
    last = Window.partitionBy("level", "path").orderBy(F.desc("edit_no"))
    rows = edits.where("type != 0").join(F.broadcast(reset), F.col("edit_no") > F.col("reset"))
    return rows.withColumn("__at", F.row_number().over(last)).where("__at = 1 AND type = 1").select("level", "file_no", "path")


def valid_prefix(records: DataFrame) -> DataFrame:
    """Log records before the first bad one (idx, ok): one minimum, no ordered pass."""
    bad = records.where(~F.col("ok")).agg(F.min("idx").alias("bad"))
    return records.join(F.broadcast(bad), F.col("bad").isNull() | (F.col("idx") < F.col("bad"))).drop("bad")


def shared_prefixes(log: DataFrame) -> DataFrame:
    """(file_no, n, shared): bytes that neighbouring keys of a sorted run share, as prefix coding would save."""
    before = F.lag("user_key").over(Window.partitionBy("file_no").orderBy("user_key", F.desc("seq")))
    steps = F.sequence(F.lit(1), F.least(F.length("user_key"), F.length("prev")))
    shared = F.when(F.length("prev") > 0, F.size(F.filter(steps, lambda k: F.substring(F.col("user_key"), F.lit(1), k) == F.substring(F.col("prev"), F.lit(1), k)))).otherwise(0)
    return log.withColumn("prev", before).withColumn("shared", F.coalesce(shared, F.lit(0))).groupBy("file_no").agg(F.count("*").alias("n"), F.sum("shared").cast("long").alias("shared"))


def read_candidates(keys: DataFrame, stats: DataFrame, prefix: int = 5) -> DataFrame:
    """(user_key, candidates): how many files' key ranges hold each key.

    A file counts from its least key on and no more after its greatest, so a running count over the keys'
    order tells, without pairing keys and files. Counts are summed by keys' first characters first; only a
    row for each of these goes through the one ordered window.
    """
    marks = stats.select(F.col("min_key").alias("user_key"), F.lit(0).alias("kind"), F.lit(1).alias("step")).unionAll(stats.select("max_key", F.lit(2), F.lit(-1))).unionAll(keys.select("user_key", F.lit(1), F.lit(0)))
    marks = marks.withColumn("block", F.substring("user_key", 1, prefix))
    before = F.sum("step").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = marks.groupBy("block").agg(F.sum("step").alias("step")).select("block", F.coalesce(before, F.lit(0)).alias("from"))
    inside = F.sum("step").over(Window.partitionBy("block").orderBy("user_key", "kind"))
    return marks.withColumn("inside", inside).join(blocks, "block").where("kind = 1").select("user_key", (F.col("from") + F.col("inside")).alias("candidates"))


def lru_hits(accesses: DataFrame, capacity: int, block: int = 4096) -> DataFrame:
    """(access, key, hit): whether fewer than `capacity` other keys came since the key's previous access.

    Accesses (numbered by `access`) are cut into blocks. The `capacity` latest keys before a block say all
    that it needs of the past: they are gathered from the blocks before it, over twice as many in each
    round until every block has them or reaches the start; then blocks are judged by themselves.
    """
    rows = accesses.select("access", "key", F.floor(F.col("access") / block).alias("block"))
    latest = Window.partitionBy("block").orderBy(F.desc("last"))

    def top(df: DataFrame) -> DataFrame:
        last = df.join(there, "block", "left_semi").groupBy("block", "key").agg(F.max("last").alias("last"))
        return last.withColumn("at", F.row_number().over(latest)).where(F.col("at") <= capacity).drop("at")

    blocks = rows.select("block").distinct()
    # numbered without gaps: a block's past is in the blocks with the numbers before it
    numbers = blocks.withColumn("number", F.row_number().over(Window.orderBy("block")) - 1)  # a row per block
    rows = rows.join(numbers, "block").select("access", "key", F.col("number").alias("block"))
    there = numbers.select(F.col("number").alias("block"))
    past = stored(top(rows.select((F.col("block") + 1).alias("block"), "key", F.col("access").alias("last"))))
    reach = 1
    while not past.groupBy("block").agg(F.count("*").alias("n")).where((F.col("n") < capacity) & (F.col("block") > reach)).isEmpty():
        past = stored(top(past.unionByName(past.withColumn("block", F.col("block") + reach))))
        reach *= 2

    def judged(group: pa.Table) -> pa.Table:
        order = np.lexsort((group["access"].to_numpy(),))
        cache: OrderedDict = OrderedDict()
        access, key, hit = [], [], []
        for a, k, own in zip(*(group[c].take(pa.array(order)).to_pylist() for c in ("access", "key", "own"))):
            if own:
                access.append(a)
                key.append(k)
                hit.append(k in cache)
            cache[k] = None
            cache.move_to_end(k)
            if len(cache) > capacity:
                cache.popitem(last=False)
        return pa.table({"access": pa.array(access, pa.int64()), "key": pa.array(key, pa.int64()), "hit": pa.array(hit, pa.bool_())})

    both = rows.withColumn("own", F.lit(True)).unionByName(past.select("block", "key", F.col("last").alias("access"), F.lit(False).alias("own")))
    return both.groupBy("block").applyInArrow(judged, "access long, key long, hit boolean")
