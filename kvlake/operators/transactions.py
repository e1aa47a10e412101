"""Optimistic transactions over the operation log: begin, commit, roll back.

A transaction reads as of its begin and writes at its commit. It aborts if a transaction that did commit
wrote a key of its read set after its begin and before its commit; one that aborted does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .ordered import carried
from .writes import applied


def _conflicts(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(txn, sure, maybe) for each transaction of reads (txn, key, began, committed): whether a write (key, committed, sure) between its begin and commit surely stands, or may.

    The last write before the commit tells, as times rise: it is after the begin if any is. So a key's reads
    and writes go through one ordered pass, in which the last sure and the last open write are carried.
    """
    w = writes.select("key", F.col("committed").alias("at"), F.lit(1).alias("side"), F.when(F.col("sure"), F.col("committed")).alias("s"), F.when(~F.col("sure"), F.col("committed")).alias("m"))
    r = reads.select("key", F.col("committed").alias("at"), F.lit(0).alias("side"), "txn", "began")  # before writes of its own time
    seen = carried(w.unionByName(r, allowMissingColumns=True), ["key"], ["at", "side", "txn"], ["s", "m"]).where("side = 0")
    hit = lambda c: F.coalesce(F.max(F.col(c) > F.col("began")), F.lit(False))
    return seen.groupBy("txn").agg(hit("s").alias("sure"), hit("m").alias("maybe"))


def outcomes(txns: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(txn, outcome) of transactions (txn, began, committed) with read and write sets (txn, key): committed, aborted, or rolled_back where committed is null.

    Verdicts depend on verdicts, so they are found as a fixpoint: a transaction aborts once a write against
    it surely stands, and commits once none may stand any more; the others wait for the next round. The
    earliest that waits is always decided, and rounds are as many as the longest chain of transactions of
    which each waits for the one before. Only reads of those that wait and writes to what they read go on.
    Repeated rows of a set count once; transactions of one commit time don't disturb each other; a null
    key is no key.
    """
    live = txns.where("committed IS NOT NULL")
    own = lambda sets: sets.where("key IS NOT NULL").select("txn", "key").distinct().join(live.select("txn", "began", "committed"), "txn")
    reads, writes = stored(own(reads)), stored(own(writes).select("txn", "key", "committed", F.lit(False).alias("sure")))
    idle = live.join(reads.select("txn").distinct(), "txn", "left_anti").select("txn", F.lit("committed").alias("outcome"))
    decided = [txns.where("committed IS NULL").select("txn", F.lit("rolled_back").alias("outcome")), idle]
    done = idle.select("txn", F.lit(True).alias("stands"))
    while True:
        # writes of those just decided stand or go
        now = writes.join(done, "txn", "left").where(F.coalesce("stands", F.lit(True))).withColumn("sure", F.col("sure") | F.col("stands").isNotNull()).drop("stands")
        verdicts = stored(_conflicts(reads, now))
        settled = verdicts.where("sure OR NOT maybe").select("txn", (~F.col("sure")).alias("stands"))
        decided.append(settled.select("txn", F.when(F.col("stands"), "committed").otherwise("aborted").alias("outcome")))
        waiting = stored(reads.join(settled, "txn", "left_anti"))
        if waiting.isEmpty():
            break
        writes = stored(now.join(waiting.select("key").distinct(), "key", "left_semi"))
        reads, done = waiting, settled
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def committed_log(txns: DataFrame, reads: DataFrame, ops: DataFrame, base: int) -> DataFrame:
    """Log rows of the transactions that commit, in order of commit: ops (txn, op_no, type, key, value) as write batches, numbered from base + 1."""
    stand = outcomes(txns, reads, ops.select("txn", "key")).where("outcome = 'committed'").select("txn")
    order = txns.join(stand, "txn").select("txn", F.col("committed").alias("batch_id"))
    return applied(ops.join(order, "txn").select("batch_id", "op_no", "type", "key", "value"), base)
