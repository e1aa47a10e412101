"""Blocks of vectors: how both searches deal vectors and queries to tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Tables that make fewer shards than this get shards of a search's least number of rows; larger ones larger shards, up to a search's number of components.
SPREAD = 64


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, v array<double>, dim) of the rows that take part: no null vector, no null or non-finite component, at least one component; with zero=False no zero vector. A null vec_id takes no part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size("embedding").alias("dim")).where("vec_id IS NOT NULL AND dim > 0")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(whole)
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of one length in a column, without making Python numbers of them."""
    return np.concatenate([np.asarray(c.flatten()) for c in column.chunks] or [np.zeros(0)]).reshape(-1, dim)


def dealt(rows: DataFrame, every: int, per_block: int, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows with `shard`, query blocks (shard, ids, vectors) for every shard).

    Rows of one length are dealt to shards of `least` rows or more, but at most about `most` components; the
    larger the shards, the fewer copies of the queries are sent. Copies and repeated ids are dealt apart.
    Queries are the rows whose id `every` divides, of a repeated id the largest vector; they are packed in
    blocks of about per_block and written once. The join by shard sends each shard every block of its
    length, which is what a query set against all rows asks for; a task holds one shard and one block.
    """
    size = F.greatest(F.lit(least), F.least(F.ceil(F.col("n") / SPREAD), F.floor(F.lit(most) / F.col("dim"))))
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"))
    counts = stored(counts.select("dim", F.ceil(F.col("n") / size).cast("int").alias("shards"), F.ceil(F.col("n") / (every * per_block)).cast("int").alias("blocks")))
    few = F.broadcast(counts)  # n different lengths take n * n / 2 components at least, so even 10**13 of these have under five million rows here
    part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("shards")).cast("int")
    spread = rows.join(few, "dim").select("vec_id", "v", F.struct("dim", part.alias("part")).alias("shard"))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.max("v").alias("v")).withColumn("dim", F.size("v"))
    asked = asked.join(few, "dim").withColumn("block", F.struct("dim", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("part")))

    def pack(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        return pa.table({"dim": group.column("dim")[:1], "ids": pa.array([group.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([matrix(group.column("v"), dim).astype("<f8").tobytes()], pa.binary())})

    packed = stored(asked.groupBy("block").applyInArrow(pack, "dim int, ids binary, vectors binary"))
    each = packed.join(few, "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(F.struct("dim", "part").alias("shard"), "ids", "vectors")
    return spread, each


def block_of(batch, k: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(batch.column("ids")[k].as_py(), "<i8")
    return ids, np.frombuffer(batch.column("vectors")[k].as_py(), "<f8").reshape(len(ids), -1)
