"""A training-data pipeline over `documents`: quality, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
back as the next stage's docs. All but the last return the columns of documents.

Rows are judged by their own text: rows with null or reused doc_ids are filtered like others, and repeated
rows alike. A null text is judged as an empty one. Columns that documents has besides stay as they are,
whatever their names. Ties go to the kept side: a score of 0.5 is quality, and below 0.5 is not toxic. An
empty table passes all stages empty; without labels the first stage keeps all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvlake.llm import common, jaccard_join, packing, quality, queries, toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text the quality classifier scores below 0.5. Null ids, repeats and further columns change nothing; a null text is judged as an empty one; an empty table stays empty; without labels of any kind all rows stay."""
    return quality.without_low(docs, common.table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text is scored 0.5 or more for toxicity. Null ids, repeats and further columns change nothing; a null or empty text has no word that tells; an empty table stays empty."""
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, on shingles of five words and a similarity of 0.8: that with the least doc_id, a null being the largest, of ties one. Texts without words, null ones too, have no duplicates and stay; an empty table stays empty."""
    return jaccard_join.one_row_per_component(docs, width=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences. A null text is one end token, like an empty one; null ids and repeated rows are documents like others; an empty table gives no pieces."""
    return packing.packed(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: SQL can't express the classifiers; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's last result, over the documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
