"""Thin queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORACLE_SQL: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), words=2, percent=80).drop("n_links")


# Plain SQL over all pairs that share a shingle, as far as the small tables go.
ORACLE_SQL["op1_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
same AS (
  SELECT doc_id, n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS key FROM s JOIN n USING (doc_id) GROUP BY doc_id, n),
rep AS (SELECT key, n, min(doc_id) AS rep FROM same GROUP BY key, n),
r AS (SELECT s.doc_id, s.shingle, rep.n FROM s JOIN rep ON s.doc_id = rep.rep),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT rep AS id, rep AS to_id FROM rep UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.to_id = edges.a),
comp AS (SELECT id, min(to_id) AS component FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n_links FROM edges GROUP BY a)
SELECT d.doc_id, coalesce(same.n, 0) AS n_shingles, coalesce(comp.component, d.doc_id) AS component_id,
  d.doc_id = coalesce(comp.component, d.doc_id) AS kept
FROM documents d LEFT JOIN same ON d.doc_id = same.doc_id LEFT JOIN rep ON same.key = rep.key AND same.n = rep.n LEFT JOIN comp ON rep.rep = comp.id
"""


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnow import compare_with_edits

    return compare_with_edits(_documents(spark, sf_dir)).drop("positions")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_documents(spark, sf_dir))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score

    return score(_documents(spark, sf_dir))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    out = remove_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_documents

    return encode_documents(_documents(spark, sf_dir))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .leaks import find_leaks

    return find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudonyms import pseudonymise

    return pseudonymise(_documents(spark, sf_dir).select("doc_id", "text"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfiles import count_tokens

    return count_tokens(_documents(spark, sf_dir)).select("doc_id", "n_tokens")


def op9_chat_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotes import in_reply_order, link_quotations

    return in_reply_order(link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine

    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), moved)


ORACLE_SQL["op11_hard_negatives"] = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spellings import group_variants

    return group_variants(_documents(spark, sf_dir))
