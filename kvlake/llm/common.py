"""What the operators share: table access, the shared folder, and column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Python workers live on from task to task; by this pool the batches that one has freed go back to the system
pa.set_memory_pool(pa.system_memory_pool())

#: With this setting a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir; where that is unset, one of this machine's if Spark runs on it alone."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them see")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="kvlake-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors. Nothing reads the shuffle files of the write again, so they go with its end."""
    path, conf = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}", df.sparkSession.conf
    own = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLES_GO, own) if own is not None else conf.unset(SHUFFLES_GO)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of what stored() gave; nothing may read df any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text, the contract's fold number; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def kept(docs: DataFrame, words: Callable, judge: Callable) -> DataFrame:
    """The rows of docs, unchanged, that judge(words, text numbers, rows) keeps, each by its own text (null as the empty one); ids play no part.

    words splits an iterator of batches with a column text into (part, words, text numbers), in order.
    """

    def run(batches):
        for batch in batches:
            at = 0
            for part, w, doc in words([pa.record_batch({"text": pc.fill_null(batch.column("text"), "")})]):
                yield batch.slice(at, part.num_rows).filter(pa.array(judge(w, doc, part.num_rows)))
                at += part.num_rows

    return docs.mapInArrow(run, docs.schema)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with other columns dropped and a null text as the empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
