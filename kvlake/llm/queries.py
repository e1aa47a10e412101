"""The operators' queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, complement_packing, conversation_trie, graph_ann, jaccard_join, link_trust, packing, pieces, quality, sharding, token_counts, topk_nra, toxicity
from .common import table


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is; the operators themselves take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.search(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judged(table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_nra.top_products(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complement_packing.packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"), family=20, shared=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_counts, op2_graph_neighbours, op3_link_trust, op4_jaccard_join, op5_nra_topk, op6_histogram_shards, op7_quality, op8_toxicity, op9_pieces, op10_packing, op11_complement_packing, op12_alignment, op13_conversation_trie)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) >= 4 THEN list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))
                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w
), sized AS (SELECT doc_id, len(shingles) AS n FROM sets),
each AS (SELECT doc_id, hash(unnest(shingles)) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sized a ON a.doc_id = x JOIN sized b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sized UNION SELECT r.doc_id, l.y FROM reach r JOIN both_ways l ON l.x = r.other)
SELECT s.doc_id, any_value(s.n) AS n_shingles, min(r.other) AS component_id FROM sized s JOIN reach r USING (doc_id) GROUP BY s.doc_id
""",
        "op5_nra_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
""",
        "op13_conversation_trie": """
WITH k AS (
  SELECT conv_id, turn, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS id,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), l AS (SELECT conv_id, list({'id': id, 'words': words} ORDER BY turn NULLS FIRST, id) AS turns FROM k GROUP BY conv_id),
c AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))),
         lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(0, 8) AS BIGINT[])), lambda x, j: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 4 AS h
  FROM l
), r AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns FROM c LEFT JOIN l b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r),
q AS (SELECT conv_id, depth, array_to_string(list_transform(turns[1:depth], lambda z: z.id), '') AS node, CASE WHEN depth > 0 THEN turns[depth].words ELSE 0 END AS words, depth = len(turns) AS ended FROM p),
n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own, sha256(coalesce(string_agg(CASE WHEN ended THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM q GROUP BY node, depth
), m AS (SELECT n.*, substr(node, 1, 32 * (depth - 1)) AS parent, (SELECT count(*) FROM n o WHERE o.depth = n.depth + 1 AND substr(o.node, 1, 32 * n.depth) = n.node) AS n_children FROM n),
u AS (SELECT substr(node, 1, 32 * a) AS node, a AS depth, sum(own) AS saved, count(CASE WHEN n_children = 0 THEN 1 END) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM m) GROUP BY 1, 2)
SELECT m.conv_id, m.depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN u ON u.node = m.node AND u.depth = m.depth LEFT JOIN n o ON o.depth = m.depth - 1 AND o.node = m.parent
""",
    }
