"""Token counts by the whole-token shortcut."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens, words
from .common import texts


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text), as the library counts.

    Before the job, each vocabulary string is encoded alone; those that stay one token are broadcast
    (at most the vocabulary). A task counts pre-tokens found there directly and merges only the rest,
    each distinct one once. Texts with characters on whose normalisation libraries may differ, or that
    may hold special tokens, are encoded by the library whole. A null text counts as empty (0 bytes,
    0 tokens); null ids and repeated rows are kept; other columns are ignored.
    """
    whole = docs.sparkSession.sparkContext.broadcast(pretokens.whole_tokens(path))

    def run(batches):
        ids = pretokens.ids_for(path, whole.value)
        for batch in batches:
            for a, z in words.pieces(batch.column("text")):
                part = batch.slice(a, z - a)
                n = ids.counts(part.column("text"))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes"), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    own = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
