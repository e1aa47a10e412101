"""Frames and requests out of byte streams that arrive in chunks cut anywhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import carried, numbered, summed
from .policy import parsed_requests


def lines(chunks: DataFrame) -> DataFrame:
    """(stream, line, text, whole) of chunks (stream, chunk, data): the lines of each stream, numbered from 0, their ends taken off; whole is false for what stands after the last end.

    A chunk is split at its own ends of lines; a line's number is how many ends came before it, counted over
    ranges of chunks, so the chunks of one stream are many tasks' work. What a line has in several chunks
    is then joined in their order. Null streams and chunks without data hold nothing.
    """
    parts = chunks.where("stream IS NOT NULL AND data IS NOT NULL").select("stream", "chunk", F.split("data", "\n").alias("parts"))
    parts = parts.select("stream", "chunk", F.posexplode("parts").alias("at", "text"), F.size("parts").alias("many"))
    parts = parts.select("stream", "chunk", "at", "text", (F.col("at") < F.col("many") - 1).cast("long").alias("ends")).withColumn("line", F.col("ends"))
    at = summed(parts, ["stream"], ["chunk", "at"], ["line"], own=False)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "at", "text"))), lambda x: x["text"]), "")
    return at.groupBy("stream", "line").agg(joined.alias("text"), (F.max("ends") > 0).alias("whole"))


def frames(chunks: DataFrame) -> DataFrame:
    """(stream, frame, text, state) of chunks (stream, chunk, data): what stands before each empty line, numbered from 0 in a stream; state is ok, or more for a last frame whose end has not come.

    A frame ends at the first blank line after its first line. So of empty lines that follow each other every
    second one ends a frame, and the others are its text, which their distance from the last line with
    text tells. Chunks of any length give the same frames.
    """
    rows = lines(chunks).withColumn("last", F.when(F.col("text") != "", F.col("line")))
    rows = carried(rows, ["stream"], ["line"], ["last"])
    # before any text, the first line is the first frame's
    closes = F.col("whole") & (F.col("text") == "") & ((F.col("line") - F.coalesce("last", F.lit(-2))) % 2 == 1)
    rows = summed(rows.withColumn("closes", closes).withColumn("frame", F.col("closes").cast("long")), ["stream"], ["line"], ["frame"], own=False)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("closes"), F.struct("line", "text")))), lambda x: x["text"]), "\n")
    whole = rows.groupBy("stream", "frame").agg(text.alias("text"), F.max("closes").alias("ok"))
    return whole.where("ok OR text != ''").select("stream", "frame", "text", F.when(F.col("ok"), "ok").otherwise("more").alias("state"))


def streamed_pairs(chunks: DataFrame) -> DataFrame:
    """(stream, n, key, value) of streams of server-sent frames: each frame with data that is a JSON object, numbered from 1 as a client counts them; other frames, and a last one that is not all there, give nothing."""
    body = F.substring("text", 7, 1 << 30)
    kv = F.from_json(body, "key string, value string, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    rows = frames(chunks).where("state = 'ok' AND text LIKE 'data: _%'").withColumn("kv", kv).where(F.ltrim(body).startswith("{") & F.col("kv.__bad").isNull())
    return numbered(rows, ["frame"], "n", ["stream"]).select("stream", (F.col("n") + 1).alias("n"), F.coalesce("kv.key", F.lit("")).alias("key"), F.coalesce("kv.value", F.lit("")).alias("value"))


def _cut(data: str) -> tuple[int, str]:
    """(length, state) of the request that data begins with: ok, error (a header line without a colon), or more."""
    at = data.find("\r\n")
    size = 0
    while at >= 0:
        start, at = at + 2, data.find("\r\n", at + 2)
        if at < 0:
            break
        line = data[start:at]
        if not line:
            return (at + 2 + size, "ok") if len(data) >= at + 2 + size else (0, "more")
        name, colon, value = line.partition(":")
        if not colon:
            return len(data), "error"
        if name == "Content-Length":
            size = int(value) if value.strip().isdigit() else 0
    return 0, "more"


def requests(chunks: DataFrame) -> DataFrame:
    """(conn, n, raw, state) of chunks (conn, chunk, data): the requests that come one after the other on each connection, numbered from 0.

    state is ok; error where a header line has no colon, which ends the connection as what comes after has
    no beginning; or more for a last request that is not all there. Where a request begins follows from
    the lengths of those before it, so a connection's chunks pass one task in order, which holds the
    unfinished request alone. Chunks of any length give the same requests. Null connections and chunks
    without data hold nothing.
    """

    def run(batches):
        conn, n, held, broken, out = None, 0, [], False, []

        def cut(last: bool):
            nonlocal n, held, broken
            data, at = "".join(held), 0
            while not broken:
                size, state = _cut(data[at:] if at else data)
                if state == "more":
                    break
                out.append((conn, n, data[at : at + size], state))
                n, at, broken = n + 1, at + size, state == "error"
            held = [] if broken or at == len(data) else [data[at:]]
            if last and held:
                out.append((conn, n, held[0], "more"))

        for batch in batches:
            for c, data in zip(batch.column("conn").to_pylist(), batch.column("data").to_pylist()):
                if c != conn:
                    if conn is not None:
                        cut(True)
                    conn, n, held, broken, waits = c, 0, [], False, 0
                if broken:
                    continue
                held.append(data)
                waits += len(data)
                # a long request is looked at again only when it has doubled, so that small chunks cost no more than large ones
                if waits >= sum(map(len, held)) / 2:
                    cut(False)
                    waits = 0
            yield _requests(out)
            out.clear()
        if conn is not None:
            cut(True)
        yield _requests(out)

    rows = chunks.where("conn IS NOT NULL AND data IS NOT NULL").select(F.col("conn").cast("long").alias("conn"), "chunk", "data").repartition("conn").sortWithinPartitions("conn", "chunk")
    return rows.select("conn", "data").mapInArrow(run, "conn long, n long, raw string, state string")


def _requests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch({"conn": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "raw": pa.array([r[2] for r in rows], pa.string()), "state": pa.array([r[3] for r in rows], pa.string())})


def stitched_requests(chunks: DataFrame) -> DataFrame:
    """(conn, n, method, path, query, version, headers, body, state) of the requests in chunks, see `requests` and `parsed_requests`."""
    found = parsed_requests(requests(chunks).select("conn", "n", "raw"))
    return found.drop("raw")
