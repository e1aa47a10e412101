"""Streaming forms: token bucket, change feed, key-value state and windowed counts.

State is kept by key and ordered within a micro-batch; rows of a key must not come in a later micro-batch
than newer ones where their order matters (the token bucket). A key's rows of one micro-batch are in
memory together, which maxFilesPerTrigger or the source's own limits bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.metrics import sample, update_frame


def metrics_stream(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A sample each tick of the rate source."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(*sample(F.unix_seconds("timestamp")))


def token_bucket(requests: DataFrame, capacity: float, rate: float, expire: bool = False) -> DataFrame:
    """(uid, id, allowed) for streamed requests (uid, id, sec): the bucket is the user's state.

    With expire, state goes when it has not been used for twice the seconds that filling takes, by the
    clock; such a query runs on without new requests, so it suits no trigger that ends.
    """
    keep = max(1000, math.ceil(capacity / rate) * 2 * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["sec", "id"])
        out = []
        for sec in rows["sec"]:
            tokens = min(capacity, tokens + max(0, sec - (sec if last is None else last)) * rate)
            last = int(sec)
            out.append(tokens >= 1)
            tokens -= out[-1]
        state.update((tokens, last))
        if expire:
            state.setTimeoutDuration(keep)
        yield pd.DataFrame({"uid": rows["uid"], "id": rows["id"], "allowed": out})

    return requests.groupBy("uid").applyInPandasWithState(step, "uid long, id long, allowed boolean", "tokens double, sec long", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def newest_state(log: DataFrame) -> DataFrame:
    """(user_key, seq, type, value) whenever a key's newest version changes, for a streamed log; of equal numbers the least type, as in batch. Tombstones stay as state, as older versions may still come."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else (-1, 0)
        top = pd.concat(list(batches)).sort_values(["seq", "type"], ascending=[False, True]).head(1)
        seq, kind = int(top["seq"].iloc[0]), int(top["type"].iloc[0])
        if (seq, -kind) > (best[0], -best[1]):
            state.update((seq, kind))
            yield top[["user_key", "seq", "type", "value"]]

    return log.groupBy("user_key").applyInPandasWithState(step, "user_key string, seq long, type int, value string", "seq long, type int", "update", GroupStateTimeout.NoTimeout)


def feed_state(events: DataFrame) -> DataFrame:
    """(event_no, op, name, value) whenever a name's latest valid event changes, for a streamed feed; a put without a value is no event."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        rows = rows[(rows["op"] == "DELETE") | rows["value"].notna()]
        if len(rows):
            top = rows.sort_values("event_no").tail(1)
            if not state.exists or int(top["event_no"].iloc[0]) > state.get[0]:
                state.update((int(top["event_no"].iloc[0]),))
                yield top[["event_no", "op", "name", "value"]]

    return events.groupBy("name").applyInPandasWithState(step, "event_no long, op string, name string, value string", "event_no long", "update", GroupStateTimeout.NoTimeout)


def latest(samples: DataFrame, key: str, by: str) -> DataFrame:
    """The latest sample of each key whenever it changes, for a stream in update mode: the aggregate's state is one sample a key, and ties go to the largest."""
    return samples.where(F.col(by).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*samples.columns), F.struct(by, *samples.columns)).alias("__s")).select("__s.*")


def windowed_requests(requests: DataFrame, late: str, length: str) -> DataFrame:
    """Counts by tumbling window of a streamed request log; rows later than the watermark are left out."""
    return requests.withWatermark("ts", late).groupBy(F.window("ts", length)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def subscribed(samples: DataFrame, known: DataFrame, at: int, path: str, checkpoint: str) -> None:
    """Writes (timestamp, frame) of what a subscriber gets who comes at second `at`: with the first micro-batch the latest of the known samples up to then, and each streamed sample after it. Each micro-batch writes a folder of its own, again if it is run again, so nothing is there twice."""
    frame = lambda df: df.select("timestamp", update_frame(samples).alias("frame"))

    def write(df: DataFrame, k: int) -> None:
        out = frame(df.where(F.col("timestamp") > at))
        if k == 0:
            out = out.unionByName(frame(known.where(F.col("timestamp") <= at).orderBy(F.desc("timestamp")).limit(1)))
        out.write.mode("overwrite").parquet(f"{path}/batch={k}")

    samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now, into Parquet files; in update mode each micro-batch writes a folder of its own again if it is run again, so no row is there twice."""
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{path}/batch={k}")).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
