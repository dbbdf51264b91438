"""From text to page geometry: lines from words, evidence to lines, values to columns. y grows downwards.

``words``: submission_id, page, block, line, word, x0, y0, x1, y1, text. Drawing is not part of this: the
result is a table of rectangles.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

NEAR, LEAST_NEAR, LEAST_NORM, ROW_GAP, LINE_KEY = 0.82, 12, 10, 6.0, 2.0


def lines(words: DataFrame) -> DataFrame:
    """One row for each text line with its words in order and their bounding box; blank lines are left out."""
    order = F.array_sort(F.collect_list(F.struct("word", "text")))
    g = words.groupBy("submission_id", "page", "block", "line").agg(F.array_join(F.transform(order, lambda w: w["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return g.filter(F.trim("text") != "").withColumn("line_key", F.floor(F.col("y0") / LINE_KEY))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two strings, 0 to 1."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def rank_pages(lines: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pages of each piece of evidence by shared tokens, then page number. ``evidence``: submission_id, evidence_id, evidence."""
    pages = lines.groupBy("submission_id", "page").agg(F.array_distinct(F.flatten(F.collect_list(X.tokens(F.col("text"))))).alias("on_page"))
    both = evidence.join(pages, "submission_id").withColumn("shared", F.size(F.array_intersect(X.tokens(F.col("evidence")), "on_page")))
    order = Window.partitionBy("submission_id", "evidence_id").orderBy(F.desc("shared"), "page")
    return both.withColumn("page_rank", F.row_number().over(order)).select("submission_id", "evidence_id", "page", "shared", "page_rank")


def with_shared(met: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (submission_id, page, evidence, ...) with ``_shared``: the tokens of the evidence on the page. W4's order of pages for those that
    were met; it needs no pair of each piece of evidence with each page."""
    pages = lines.groupBy("submission_id", "page").agg(F.array_distinct(F.flatten(F.collect_list(X.tokens(F.col("text"))))).alias("_on_page"))
    return met.join(pages, ["submission_id", "page"], "left").withColumn("_shared", F.size(F.array_intersect(X.tokens(F.col("evidence")), "_on_page"))).drop("_on_page")


def find_evidence(lines: DataFrame, evidence: DataFrame, near_misses: bool = True) -> DataFrame:
    """L2: the line each piece of evidence stands in: literally (1), normalised (2), as a table row (3), nearly (4).

    Tier, then page rank, then position decide. Near misses share a figure of two digits, have twelve
    characters and a ratio of 0.82; only pairs that share a figure, of evidence that stands nowhere, are compared in Python. ``fragment``
    is the longest part of the evidence that the line has literally, null without one.

    Evidence meets the lines of its script once, for all tiers, and no word or line is shuffled where both come spread by scripts.
    """
    e = evidence.withColumn("e_norm", X.symbol_norm(F.col("evidence"))).select("*", F.posexplode(X.candidate_fragments(F.col("evidence"))).alias("_nth", "fragment"))
    # What each side alone decides is worked out before they meet.
    e = e.withColumns({"f_low": F.lower("fragment"), "f_norm": X.symbol_norm(F.col("fragment")), "f_rows": F.transform(X.row_variants(F.col("fragment")), F.lower)})
    line = lines.withColumns({"l_norm": X.symbol_norm(F.col("text")), "l_low": F.lower("text"), "l_heading": X.is_heading_line(F.col("text"))})
    literal = F.contains("l_low", F.col("f_low"))
    normal = (F.length("e_norm") >= LEAST_NORM) & (F.contains("l_norm", F.col("f_norm")) | (F.contains("e_norm", F.col("l_norm")) & (F.length("l_norm") >= LEAST_NORM)))
    row = F.exists("f_rows", lambda v: F.contains("l_low", v))
    tier = F.when(~F.col("l_heading"), F.when(literal, 1).when(normal, 2).when(row, 3))
    if not near_misses:
        exact = e.join(line.filter("not l_heading"), "submission_id").withColumn("tier", tier).filter("tier is not null")
        return _best_line(exact.withColumns({"score": F.lit(1.0), "fragment": F.when(F.col("tier") == 1, F.col("fragment"))}), lines)
    # A near miss is one of the whole evidence, for which its first fragment's row stands.
    e = e.withColumn("e_numbers", F.when((F.col("_nth") == 0) & (F.length("e_norm") >= LEAST_NEAR), X.salient_numbers(F.col("evidence"))))
    pairs = e.join(line.withColumn("l_numbers", X.salient_numbers(F.col("text"))), "submission_id").withColumn("tier", tier)
    met = pairs.filter(F.col("tier").isNotNull() | F.coalesce(F.arrays_overlap("e_numbers", "l_numbers"), F.lit(False))).drop("e_numbers", "l_numbers", "l_low", "f_low", "f_norm", "f_rows")
    met = met.withColumn("_exact", F.count("tier").over(Window.partitionBy("submission_id", "evidence_id")) > 0).filter("tier is not null or not _exact")
    asked = lambda c: F.when(F.col("tier").isNull(), F.col(c))
    met = met.withColumn("score", F.when(F.col("tier").isNotNull(), 1.0).otherwise(ratio(asked("e_norm"), asked("l_norm")))).filter(F.col("score") >= NEAR)
    return _best_line(met.withColumns({"tier": F.coalesce("tier", F.lit(4)), "fragment": F.when(F.col("tier") == 1, F.col("fragment"))}), lines)


def _best_line(every: DataFrame, lines: DataFrame) -> DataFrame:
    keys = ["submission_id", "evidence_id"]
    every = with_shared(every, lines)
    best = Window.partitionBy(*keys).orderBy("tier", F.desc("score"), F.desc("_shared"), "page", "y0", "x0", F.desc(F.length("fragment")))
    return every.withColumn("r", F.row_number().over(best)).filter("r = 1").select(*keys, "evidence", "tier", "score", "page", "x0", "y0", "x1", "y1", "text", "block", "line", "fragment")


def value_rows(labels: DataFrame, words: DataFrame, gap: float = 18.0) -> DataFrame:
    """Figures on a label's row (middle within 3) or on the nearest row below it (``gap``).

    ``labels``: submission_id, label_id, page, x0, y0, x1, y1.
    """
    figure = words.filter(F.col("text").rlike("[0-9]")).select("submission_id", "page", F.col("x0").alias("vx0"), F.col("y0").alias("vy0"), F.col("x1").alias("vx1"), F.col("y1").alias("vy1"), F.col("text").alias("value"))
    middle = F.abs((F.col("y0") + F.col("y1")) / 2 - (F.col("vy0") + F.col("vy1")) / 2)
    met = labels.join(figure, ["submission_id", "page"]).withColumn("level", F.when((middle <= 3) & (F.col("vx0") >= F.col("x0")), 0).when((F.col("vy0") >= F.col("y1") - 1) & (F.col("vy0") - F.col("y1") <= gap), 1)).filter("level is not null")
    first = Window.partitionBy("submission_id", "label_id")
    met = met.withColumn("_level", F.min("level").over(first)).filter("level = _level").withColumn("_y", F.min(F.floor(F.col("vy0") / LINE_KEY)).over(first))
    return met.filter((F.col("level") == 0) | (F.floor(F.col("vy0") / LINE_KEY) == F.col("_y"))).select("submission_id", "label_id", "page", "value", "vx0", "vy0", "vx1", "vy1")


def column_values(targets: DataFrame, words: DataFrame, headers: DataFrame) -> DataFrame:
    """Of several figures on a row, the one under the nearest header above (left edge from header's left - 3, then by distance).

    ``targets``: submission_id, target_id, page, y0, y1, column; ``headers``: submission_id, page, column, x0, y0, x1, y1.
    """
    head = headers.select("submission_id", F.col("page").alias("hpage"), "column", F.col("x0").alias("hx0"), F.col("x1").alias("hx1"), F.col("y1").alias("hy1"))
    above = targets.join(head, ["submission_id", "column"]).filter((F.col("hpage") < F.col("page")) | ((F.col("hpage") == F.col("page")) & (F.col("hy1") <= F.col("y0") + 1)))
    nearest = Window.partitionBy("submission_id", "target_id").orderBy(F.desc("hpage"), F.desc("hy1"), "hx0")
    above = above.withColumn("r", F.row_number().over(nearest)).filter("r = 1").drop("r")
    figure = words.filter(F.col("text").rlike("[0-9]")).select("submission_id", "page", F.col("x0").alias("vx0"), F.col("x1").alias("vx1"), F.col("y0").alias("vy0"), F.col("text").alias("value"))
    met = above.join(figure, ["submission_id", "page"]).filter(F.abs(F.col("vy0") - F.col("y0")) <= 2)
    under = F.col("vx0") >= F.col("hx0") - 3
    distance = F.when(under, F.abs(F.col("vx0") - F.col("hx0"))).otherwise(F.abs((F.col("vx0") + F.col("vx1")) / 2 - (F.col("hx0") + F.col("hx1")) / 2))
    best = Window.partitionBy("submission_id", "target_id").orderBy(F.desc(under), distance, "vx0")
    return met.withColumn("r", F.row_number().over(best)).filter("r = 1").select("submission_id", "target_id", "column", "page", "value", "vx0", "vy0", "vx1")


def question_bounds(lines: DataFrame, questions: DataFrame, left: float = 250.0) -> DataFrame:
    """Where each question starts and the next one ends it, by heading lines near the left margin.

    ``questions``: submission_id, question (its number as text). Neighbours are the questions of the data, whatever
    their numbers. Returns page, y_min, and next_page, next_y (null for the last).
    """
    number = X.title_number(F.col("text"))
    head = lines.filter(F.col("x0") < left).withColumn("question", number).filter("question <> ''").join(questions.select("submission_id", "question").distinct(), ["submission_id", "question"], "left_semi")
    first = head.groupBy("submission_id", "question").agg(F.min(F.struct("page", "y0")).alias("at"))
    order = Window.partitionBy("submission_id").orderBy("at")
    return first.withColumn("next", F.lead("at").over(order)).select("submission_id", "question", F.col("at.page").alias("page"), F.col("at.y0").alias("y_min"), F.col("next.page").alias("next_page"), F.col("next.y0").alias("next_y"))


def belonging(found: DataFrame) -> DataFrame:
    """for Dr/Cr criteria, lines of the other side and working lines go, unless nothing would be left.

    ``found``: submission_id, item_pos, criterion, text (of the line), ...
    """
    side = F.regexp_extract(F.lower("criterion"), r"^(dr|cr)\b", 1)
    other = F.when(side == "dr", F.lower("text").rlike(r"\bcr\b")).otherwise(F.lower("text").rlike(r"\bdr\b"))
    working = F.col("text").rlike(r"[0-9] ?[x×*/+] ?[0-9(£]|=")
    df = found.withColumn("_ok", (side == "") | ~(other | working))
    by = Window.partitionBy("submission_id", "item_pos")
    return df.withColumn("_any", F.count_if("_ok").over(by) > 0).filter(F.col("_ok") | ~F.col("_any")).drop("_ok", "_any")


def number_context(numbers: DataFrame, words: DataFrame) -> DataFrame:
    """Of several places of a figure, the one with most of its context words on the same line (within ``ROW_GAP``).

    ``numbers``: submission_id, number_id, context (array of lower-case words), page, x0, y0, x1, y1.
    """
    near = words.select("submission_id", "page", F.col("y0").alias("wy0"), F.lower(F.regexp_replace("text", "[^A-Za-z0-9]", "")).alias("w"))
    met = numbers.join(near, ["submission_id", "page"], "left")
    hit = F.when((F.abs(F.col("wy0") - F.col("y0")) <= ROW_GAP) & F.array_contains("context", F.col("w")), F.col("w"))
    scored = met.groupBy("submission_id", "number_id", "page", "x0", "y0", "x1", "y1").agg(F.count_distinct(hit).alias("shared"))
    best = Window.partitionBy("submission_id", "number_id").orderBy(F.desc("shared"), "page", "y0", "x0")
    return scored.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")
