"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from clauseloom.llm import (
    op1_sharding,
    op2_toxicity,
    op3_line_quality,
    op4_mixing,
    op5_token_counts,
    op6_embedding_dedup,
    op7_ngram_join,
    op8_exact_dedup,
    op9_token_files,
    op10_packing,
    op11_lattice_lm,
    op12_fill_in_middle,
    op13_hard_negatives,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shards small enough for random access, so that small tables split too; the operator's own default is larger.
SHARD_BYTES = 1024 * 1024


def op1_sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op1_sharding.shard_rows(table(spark, sf_dir, "documents"), shard_bytes=SHARD_BYTES)
    return rows.select("doc_id", "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "alone")


def op2_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_line_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op8_exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_exact_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op9_token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_token_files.token_file_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_lattice_lm.lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_fill_in_middle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_fill_in_middle.fill_in_middle_report(table(spark, sf_dir, "documents"))


def op13_hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_hard_negatives.mined_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_sharding": op1_sharding_query,
    "op2_toxicity_scores": op2_toxicity_scores,
    "op3_quality_scores": op3_quality_scores,
    "op4_mix_sources": op4_mix_sources,
    "op5_token_counts": op5_token_counts_query,
    "op6_embedding_links": op6_embedding_links,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_exact_dedup": op8_exact_dedup_query,
    "op9_token_files": op9_token_files_query,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_lattice_scores": op11_lattice_scores,
    "op12_fill_in_middle": op12_fill_in_middle_query,
    "op13_hard_negatives": op13_hard_negatives_query,
}

ORACLE_SQL = {
    # Covers texts up to the shard limit whose hashes part them: it has no row for a larger text (the query returns it
    # with alone = true) and none for shards that chained buckets make. tests/llm checks both by brute force.
    "op1_sharding": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents
), small AS (SELECT * FROM d WHERE n_bytes <= {SHARD_BYTES}),
grow AS (
  SELECT 0 AS depth, CAST(0 AS BIGINT) AS prefix, (SELECT sum(n_bytes) FROM small)::BIGINT AS b
  UNION ALL
  SELECT g.depth + 1, c.prefix, c.b FROM grow g, LATERAL (
    SELECT s.h >> (60 - g.depth - 1) AS prefix, sum(n_bytes)::BIGINT AS b FROM small s
    WHERE s.h >> (60 - g.depth) = g.prefix GROUP BY 1) c
  WHERE g.b > {SHARD_BYTES} AND g.depth < 60
), leaf AS (SELECT * FROM grow WHERE b <= {SHARD_BYTES})
SELECT s.doc_id, s.n_bytes,
       CASE WHEN l.depth = 0 THEN 'root' ELSE lpad(to_binary(l.prefix), l.depth, '0') END AS shard,
       l.depth, l.b AS shard_bytes, false AS alone
FROM small s JOIN leaf l ON s.h >> (60 - l.depth) = l.prefix
""",
    "op8_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
""",
    "op6_embedding_links": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda y: abs(y)))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {op6_embedding_dedup.THRESHOLD}
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(c.c, e.vec_id) AS component_id, e.vec_id = coalesce(c.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN deg d ON d.a = e.vec_id LEFT JOIN comp c ON c.a = e.vec_id
""",
    "op7_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b, k = na.n AND k = nb.n AS same FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE k >= 0.8 * (na.n + nb.n - k) - 1e-9
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n_links, count(*) FILTER (WHERE same) AS copies, min(b) FILTER (WHERE same) AS low FROM links GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_ngrams, coalesce(least(d.doc_id, deg.low), d.doc_id) AS class_id, coalesce(deg.copies, 0) + 1 AS class_size,
       coalesce(deg.n_links, 0) AS n_links, coalesce(c.c, d.doc_id) AS component_id, d.doc_id = coalesce(c.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN deg ON deg.a = d.doc_id LEFT JOIN comp c ON c.a = d.doc_id
""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
""",
}
