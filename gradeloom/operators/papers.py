"""A4: what a question of a paper is worth. Papers are JSON documents of questions with sub-questions of any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rubric import LEVELS, NODES, _view

WALK = """
WITH RECURSIVE node (paper_id, path, v) AS (
  SELECT paper_id, array(pos), value FROM {docs}, LATERAL variant_explode(variant_get(doc, '$.questions', 'variant'))
  UNION ALL
  SELECT n.paper_id, concat(n.path, array(e.pos)), e.value FROM node n, LATERAL variant_explode(variant_get(n.v, '$.sub_questions', 'variant')) e)
SELECT * FROM node
"""
#: Where a question's marks may stand, in their order.
KEYS = ["marks", "maximum_marks", "max_marks", "total_marks"]


def largest(text: Column) -> Column:
    """The largest positive number of a text; null without one."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda n: n.try_cast("double"))
    return F.array_max(F.filter(found, lambda n: n > 0))


def _get(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$.{name}", kind)


def closing(content: Column) -> Column:
    """The number in brackets that a text ends with, "(12)" or "(12 marks)"."""
    return F.regexp_extract(F.trim(content), r"\(([0-9]+(?:\.[0-9]+)?)\s*(?:[Mm]arks?)?\)\s*$", 1).try_cast("double")


def nodes(papers: DataFrame) -> DataFrame:
    """(paper_id, path, question, total, own, closing): all questions and sub-questions of (paper_id, doc JSON text); own is the first stated marks."""
    spark = papers.sparkSession
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(LEVELS))
    spark.conf.set("spark.sql.cteRecursionRowLimit", str(NODES))
    n = spark.sql(WALK.format(docs=_view(papers.select("paper_id", F.try_parse_json("doc").alias("doc")), "papers")))
    own = F.coalesce(*(largest(_get(k)) for k in KEYS))
    return n.select("paper_id", "path", _get("question_number").alias("question"), _get("total_marks").try_cast("double").alias("total"), own.alias("own"), closing(_get("content")).alias("closing"))


def leaf_sums(n: DataFrame) -> DataFrame:
    """(paper_id, top, leaf_sum): marks of all sub-questions of each top question, bottom up.

    A sub-question is worth what its own sub-questions are worth together, or what it states itself where they state nothing. So
    those count that state marks while nothing below them does, and one pass over the paths finds them at any depth.
    """
    worth = n.withColumn("marks", F.coalesce("own", "closing")).filter("marks > 0").select("paper_id", "path", "marks")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda k: F.slice("path", F.lit(1), k))
    covered = worth.filter(F.size("path") > 1).select("paper_id", F.explode(above).alias("path")).distinct()
    counted = worth.filter(F.size("path") > 1).join(covered, ["paper_id", "path"], "left_anti")
    return counted.groupBy("paper_id", F.get("path", 0).alias("top")).agg(F.sum("marks").alias("leaf_sum"))


def question_marks(papers: DataFrame, asked: DataFrame) -> DataFrame:
    """(paper_id, question, marks) of ``asked`` (paper_id, question, judged): the first of these that is positive, 0 without any.

    The paper's own total, "maximum marks: 30" before any other number in it; then of the questions whose digits start with the asked
    ones, or the other way round, in their order: the stated total, the sum of its leaves, its own marks, its closing "(N)"; then
    what the judge said, and the sum of all questions' own marks.
    """
    n = nodes(papers)
    said = F.try_variant_get(F.try_parse_json("doc"), "$.total_marks", "string")
    stated = F.coalesce(*(F.regexp_extract(said, p, 1).try_cast("double") for p in (r"(?i)maximum\s*marks?\s*[:=]?\s*([0-9]+(?:\.[0-9]+)?)", r"(?i)max(?:imum)?\s*[:=]?\s*([0-9]+(?:\.[0-9]+)?)")), largest(said))
    top = n.filter(F.size("path") == 1).withColumn("top", F.get("path", 0)).join(leaf_sums(n), ["paper_id", "top"], "left")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    top = top.withColumns({"worth": F.coalesce(*map(positive, ("total", "leaf_sum", "own", "closing"))), "digits": F.regexp_replace(F.coalesce("question", F.lit("")), "[^0-9]", "")})
    every = top.groupBy("paper_id").agg(F.sum("own").alias("every"))
    wanted = F.regexp_replace(F.col("asked.question").cast("string"), "[^0-9]", "")
    fits = (wanted != "") & (F.col("top.digits") != "") & (F.startswith(wanted, F.col("top.digits")) | F.startswith(F.col("top.digits"), wanted))
    met = asked.alias("asked").join(top.filter("worth is not null").alias("top"), (F.col("asked.paper_id") == F.col("top.paper_id")) & fits)
    first = met.groupBy(F.col("asked.paper_id").alias("paper_id"), F.col("asked.question").alias("question")).agg(F.min(F.struct("top.top", "top.worth"))["worth"].alias("matched"))
    out = asked.join(papers.select("paper_id", stated.alias("stated")), "paper_id", "left").join(first, ["paper_id", "question"], "left").join(every, "paper_id", "left")
    return out.select("paper_id", "question", F.coalesce(*map(positive, ("stated", "matched", "judged", "every")), F.lit(0.0)).alias("marks"))
