"""The corpus pipeline: language ID, near-duplicates, decontamination, pseudonyms, SentencePiece ids.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept. All but the last return
the columns of ``documents``; the last returns doc_id, n_tokens, token_ids and round_trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import langid, leaks, minhash, pieces, pseudonyms
from gradeloom.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates share 80 % of their five-word shingles.
SHINGLE_WORDS, PERCENT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the labelled ones teach go: null texts, texts without letters, foreign ones."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    found = langid.predict(docs.select(*COLUMNS), model)
    return found.filter((F.col("lang_pred") != "und") & F.col("known")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; rows that repeat an id and text stay once; rows without an id stay."""
    groups = minhash.near_duplicates(docs.select("doc_id", "text"), words=SHINGLE_WORDS, percent=PERCENT)
    others = groups.filter("doc_id is not null and not kept").select("doc_id").distinct()
    left = docs.select(*COLUMNS).join(others, "doc_id", "left_anti")
    return left.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).union(left.filter("doc_id is null")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = leaks.find_leaks(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.select(*COLUMNS).join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms of the same format."""
    done = pseudonyms.pseudonymise(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, checked by decoding them."""
    return pieces.encode_documents(docs.select("doc_id", "text"))


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII pseudonyms", pseudonym_stage),
    ("SentencePiece encoding", piece_stage),
]

#: The stages learn, hash and encode in ways that SQL cannot state; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
