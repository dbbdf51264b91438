"""Operator chains over the driver's tables that SQL cannot state: guards, recovery, arithmetic, similarity, layout.

Scripts are ``documents``; a judged row asks whether a benchmark passage's first sentence stands in a
script, with the script's own first sentence as evidence. Words get a page position from their place in
the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arithmetic
from ..functions import text as X
from ..operators import finalize, layout, recovery, row_guards
from .queries import query, table


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("submission_id"), "text", F.lit("").alias("reference"))


#: Characters of the scripts that one task gets, whose words, lines and evidence stay in it.
TASK_CHARS = 8_000_000


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts spread over as many tasks as their texts need; what is derived by script is not shuffled again (see marking_view.judged)."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("submission_id"), "text")
    return d.repartition((d.agg(F.sum(F.length("text"))).first()[0] or 0) // TASK_CHARS + spark.sparkContext.defaultParallelism, "submission_id")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each script with the passage that its id points at."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.get(X.sentences(F.col("text")), 0).alias("criterion"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("submission_id"), F.slice(X.sentences(F.col("text")), 1, 2).alias("evidence"), (F.col("doc_id") % 40).alias("item_id"))
    return docs.join(items, "item_id").select(
        "submission_id", F.lit(0).alias("item_pos"), F.col("item_id").cast("string").alias("criterion_id"), "criterion", F.when(F.col("item_id") % 3 == 0, "narrative").otherwise("").alias("category"),
        F.lit(False).alias("exact_match"), F.lit(0.6).alias("marks_awarded"), F.when(F.col("item_id") % 2 == 0, 0.5).otherwise(1.0).alias("max_possible"), F.lit("").alias("reason"), "evidence",
    )


@query()
def d01_row_guard_chain(spark, sf_dir):
    """F5 to F19 on every script: marks, and which guard changed them."""
    out = row_guards.apply(row_guards.prepare(_judged(spark, sf_dir), _scripts(spark, sf_dir)))
    return out.select("submission_id", "criterion_id", "marks_awarded", F.array_join(F.transform("audit", lambda a: a["guard"]), ",").alias("guards"))


@query()
def d04_evidence_lines(spark, sf_dir):
    """L2 on every script: the line that its second sentence stands in."""
    d = _spread(spark, sf_dir)
    line = d.select("submission_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).select("submission_id", "line", F.posexplode(F.split("t", " ")).alias("word", "text")).filter("text <> ''")
    words = line.select("submission_id", (F.floor(F.col("line") / 50) + 1).cast("int").alias("page"), F.lit(0).alias("block"), "line", "word", (F.col("word") * 40.0).alias("x0"), (F.col("line") % 50 * 12.0).alias("y0"), (F.col("word") * 40.0 + 30).alias("x1"), (F.col("line") % 50 * 12.0 + 10).alias("y1"), "text")
    evidence = d.select("submission_id", F.lit(1).alias("evidence_id"), F.get(X.sentences(F.col("text")), 1).alias("evidence")).filter("evidence is not null")
    return layout.find_evidence(layout.lines(words), evidence).select("submission_id", "evidence_id", "tier", "page", "y0")


@query()
def d05_report(spark, sf_dir):
    """The 13-column report of all scripts after the guards."""
    rows = row_guards.apply(row_guards.prepare(_judged(spark, sf_dir), _scripts(spark, sf_dir))).withColumn("position", F.col("criterion_id").cast("int"))
    grades = finalize.totals(rows).withColumn("student", F.concat(F.lit("student "), F.col("submission_id"))).withColumn("question", F.lit("1"))
    return finalize.report(rows, grades)
