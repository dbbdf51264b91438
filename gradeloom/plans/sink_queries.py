"""Queries that write and read back: reports, results, uploads; the entry point; and the last parsing functions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import finalize, geometry, holistic, layout, marking
from ..sources import tables
from ..streaming.uploads import mark_uploads
from .chain_queries import _PLACED, _leaves, _marks_sql
from .guard_queries import KEY, prepared
from .layout_queries import WORDS, words
from .marking_view import VIEW, judged, scripts
from .queries import query, table


def folder(spark, name: str) -> str:
    """A new folder where all executors can write: below ``spark.checkpoint.dir``, or in a single process a temporary one."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = f"file://{tempfile.mkdtemp(prefix='gradeloom-')}"
    return f"{own.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _report(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    grades = finalize.totals(rows).withColumn("student", F.concat(F.lit("student "), "submission_id")).withColumn("question", F.lit("1"))
    return rows, grades, finalize.report(rows, grades)


@query(f"""{VIEW}, p AS ({_PLACED}), g AS (SELECT submission_id, floor(sum(marks_awarded) * 2 + 0.5) / 2 AS total, sum(max_possible) AS most FROM r GROUP BY submission_id)
SELECT 'student ' || submission_id AS student, 'TOTAL' AS criterion, '' AS student_text, {_marks_sql('total')} AS marks_awarded FROM g
UNION ALL SELECT 'student ' || submission_id, criterion, coalesce(array_to_string(evidence, chr(10)), ''), {_marks_sql('marks_awarded')} FROM p""")
def s13_written_report(spark, sf_dir):
    """The report as CSV files, read back."""
    path = folder(spark, "report")
    tables.write_report(_report(spark, sf_dir)[2], path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select("student", "criterion", F.coalesce("student_text", F.lit("")).alias("student_text"), F.col("marks_awarded").cast("string").alias("marks_awarded"))


@query(f"{VIEW} SELECT submission_id, floor(sum(marks_awarded) * 2 + 0.5) / 2 AS total, submission_id % 2 = 0 AS reported FROM r GROUP BY submission_id")
def s12_updated_grades(spark, sf_dir):
    rows, grades, _ = _report(spark, sf_dir)
    path = folder(spark, "grades")
    tables.update_reports(grades, grades.filter("submission_id % 2 = 0").select("submission_id", F.lit("a,b").alias("csv")), path)
    back = spark.read.parquet(path)
    return back.select("submission_id", F.col("total_marks_awarded").alias("total"), (F.col("report_at").isNotNull() & (F.coalesce("report_csv", F.lit("")) == "a,b")).alias("reported"))


@query("SELECT c_custkey, count(*) AS copies, 1::BIGINT AS ids FROM (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY c_custkey")
def s11_saved(spark, sf_dir):
    """Rows appended in two turns: equal rows get equal ids."""
    path, c = folder(spark, "saved"), table(spark, sf_dir, "customer")
    tables.saved(c, path, "c_custkey")
    ids = tables.saved(c.filter("c_custkey % 3 = 0"), path, "c_custkey")
    stored = spark.read.parquet(path)
    return stored.groupBy("c_custkey").agg(F.count("*").alias("copies"), F.count_distinct("id").alias("ids")).join(ids.select("c_custkey").distinct().withColumn("known", F.lit(True)), "c_custkey", "left").drop("known")


def _uploads(spark, sf_dir) -> str:
    doc = F.to_json(F.struct(F.concat(F.lit("Q"), F.col("event_id") % 7).alias("question"), F.concat(F.lit("user "), "user_id").alias("student_name"), F.array(F.struct(F.lit("1").alias("question_number"), F.col("event_type").alias("answer"))).alias("sub_parts")))
    path = folder(spark, "uploads")
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("broken "), F.col("event_id"))).otherwise(doc).alias("value")).write.text(path)
    return path


_UPLOADS = "SELECT 'Q' || (event_id % 7) AS question, 'user ' || user_id AS student_name, event_type AS answer, true AS good FROM events WHERE event_id % 5 <> 0"


@query(f"SELECT question, student_name, answer, count(*) AS n FROM ({_UPLOADS}) GROUP BY 1, 2, 3 UNION ALL SELECT NULL, NULL, 'broken', count(*) FROM events WHERE event_id % 5 = 0")
def s16_submissions(spark, sf_dir):
    """Uploads as files, read with their file name and time; broken lines apart."""
    good, bad = tables.submissions(spark, _uploads(spark, sf_dir))
    good = good.filter("source_filename is not null and extracted_at is not null").select("question", "student_name", F.get("sub_parts", 0)["answer"].alias("answer")).groupBy("question", "student_name", "answer").agg(F.count("*").alias("n"))
    return good.unionByName(bad.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("student_name"), F.lit("broken").alias("answer"), "n"))


@query(f"SELECT question, answer, count(*) AS n FROM ({_UPLOADS}) GROUP BY 1, 2 UNION ALL SELECT 'quarantine', '', count(*) FROM events WHERE event_id % 5 = 0")
def s07_stream(spark, sf_dir):
    """The same uploads as a stream of files, marked batch by batch, broken lines to a quarantine."""
    out, bad = folder(spark, "marked"), folder(spark, "quarantine")
    q = mark_uploads(spark, _uploads(spark, sf_dir), out, bad, folder(spark, "progress"), lambda df: df.select("question", F.get("sub_parts", 0)["answer"].alias("answer")))
    q.awaitTermination()
    marked = spark.read.parquet(out).groupBy("question", "answer").agg(F.count("*").alias("n"))
    return marked.union(spark.read.parquet(bad).agg(F.count("*").alias("n")).select(F.lit("quarantine"), F.lit(""), "n"))


@query(f"{VIEW} SELECT submission_id, item_pos, grp AS parent_section, 1.5::DOUBLE AS section_cap, max_possible AS leaf_max FROM r WHERE item_pos % 4 <> 3 UNION ALL SELECT submission_id, item_pos, NULL, NULL, NULL FROM r WHERE item_pos % 4 = 3")
def j18_leaf_data(spark, sf_dir):
    leaves = _leaves(spark, sf_dir).withColumn("model_answer_id", F.col("submission_id"))
    items = leaves.select("submission_id", "item_pos", "model_answer_id", "sub_question")
    out = holistic.with_leaf(items, leaves.filter("item_pos % 4 <> 3").drop("submission_id", "item_pos"))
    return out.select(*KEY, "parent_section", "section_cap", "leaf_max")


@query("""SELECT p_partkey, 2::BIGINT AS n, p_name AS title, CAST(p_size AS DOUBLE) AS marks, p_type || chr(10) || p_brand AS body, p_brand || ' x' AS second FROM part""")
def p09_inline_sections(spark, sf_dir):
    said = F.concat(F.lit("intro\n"), "p_name", F.lit(" ("), "p_size", F.lit(" Marks)\n"), "p_type", F.lit("\n"), "p_brand", F.lit("\nNext (1.5 mks)\n"), "p_brand", F.lit(" x"))
    found = X.inline_sections(said)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(found).cast("long").alias("n"), F.get(found, 0)["title"].alias("title"), F.get(found, 0)["marks"].alias("marks"), F.get(found, 0)["body"].alias("body"), F.get(found, 1)["body"].alias("second"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE event_type END AS kind FROM events")
def p16_tool_arguments(spark, sf_dir):
    k, args = F.col("event_id") % 4, F.struct(F.col("event_type").alias("kind"))
    call = lambda f: F.to_json(F.struct(F.array(f).alias("tool_calls")))
    plain = call(F.struct(args.alias("args")))
    nested = call(F.struct(F.struct(F.to_json(args).alias("arguments")).alias("function")))
    older = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.to_json(args).alias("arguments")).alias("function"))).alias("tool_calls")).alias("additional_kwargs")))
    said = F.when(k == 0, plain).when(k == 1, nested).when(k == 2, older).otherwise("no call")
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(X.tool_arguments(said), "$.kind").alias("kind"))


@query("SELECT p_partkey, CAST(CASE p_partkey % 7 WHEN 0 THEN p_size WHEN 1 THEN p_size + 1 WHEN 2 THEN p_size + 2 WHEN 3 THEN p_size + 3 WHEN 4 THEN p_size WHEN 5 THEN p_size + 5 ELSE p_size + 6 END AS DOUBLE) AS marks FROM part")
def a04_question_max_marks(spark, sf_dir):
    k, n = F.col("p_partkey") % 7, F.col("p_size")
    said = F.when(k == 0, F.concat(F.lit("Explain. Maximum marks: "), n)).when(k == 4, F.concat(F.lit("Explain ("), n, F.lit(" marks)"))).otherwise("Explain")
    given = lambda i: F.when(k <= i, n + i).cast("double")
    only = lambda i: F.when(k == i, n + i).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", X.question_max_marks(said, only(1), only(2), only(3), F.when(k >= 5, only(5)), given(6)).alias("marks"))


@query(f"{WORDS}, f AS (SELECT submission_id, page, line, text, x1, y0, y1, (SELECT max(w.x1) FROM words w WHERE w.submission_id = l.submission_id AND w.line = l.line AND w.word = 0) AS r1 FROM lines l) SELECT submission_id, count(*) AS labels, 0::BIGINT AS touching FROM f GROUP BY submission_id")
def l07_place_scores(spark, sf_dir):
    """A label for each line: as many come back, and none touches another of its page."""
    w = words(spark, sf_dir)
    labels = w.filter("word = 0").select("submission_id", F.col("line").alias("rect_id"), "page", *geometry.BOX, F.col("line").alias("order"), F.lit("0.5").alias("label"))
    out = geometry.place_scores(labels, w, 1200.0, 800.0).select("submission_id", "page", "rect_id", "x", "y")
    # A page's labels meet in one list, so that they are placed once.
    pages = out.groupBy("submission_id", "page").agg(F.collect_list(F.struct("rect_id", "x", "y")).alias("at"))
    near = lambda a, b: (a["rect_id"] < b["rect_id"]) & (F.abs(a["x"] - b["x"]) < 52) & (F.abs(a["y"] - b["y"]) < 13)
    pairs = F.aggregate("at", F.lit(0).cast("long"), lambda n, a: n + F.size(F.filter("at", lambda b: near(a, b))))
    return pages.groupBy("submission_id").agg(F.sum(F.size("at")).alias("labels"), F.sum(pairs).alias("touching"))


@query(f"{WORDS} SELECT submission_id, page, count(*) AS notes, true AS apart FROM (SELECT * FROM lines WHERE line % 2 = 0) GROUP BY 1, 2")
def l10_place_notes(spark, sf_dir):
    """Notes on every second line: as many come back, each fourteen points from the others of its page."""
    lines = layout.lines(words(spark, sf_dir)).filter("line % 2 = 0")
    notes = lines.select("submission_id", F.col("line").alias("rect_id"), "page", F.col("line").alias("order"), "x1", "y0", F.lit(None).cast("double").alias("y_min"), F.lit(None).cast("double").alias("y_max"))
    out = geometry.place_notes(notes, 600.0, 800.0).groupBy("submission_id", "page").agg(F.count("*").alias("notes"), F.array_sort(F.collect_list("y")).alias("ys"))
    gaps = F.transform("ys", lambda y, i: F.when(i > 0, y - F.get("ys", i - 1)).otherwise(99.0))
    return out.select("submission_id", "page", "notes", F.forall(gaps, lambda g: g > 14).alias("apart"))


@query()
def s20_marking(spark, sf_dir):
    """Every script marked against its own criteria by the offline judge, from judging to the totals."""
    rows = judged(spark, sf_dir)
    criteria = rows.select(
        F.col("submission_id").cast("string").alias("model_answer_id"), F.lit("1").alias("question_number"), "criterion_id", F.col("criterion").alias("description"), F.col("max_possible").alias("marks"), "category", "exact_match",
        "of_source_ids", "of_component_of", "of_produces", F.lit(None).cast("array<string>").alias("keywords"), "expected_amount", "sign_sensitive", F.lit(None).cast("string").alias("column"), (F.col("item_pos") + 1).alias("pos"),
    )
    submissions = scripts(rows).select("submission_id", F.col("submission_id").cast("string").alias("model_answer_id"), "text", "reference", F.concat(F.lit("student "), "submission_id").alias("student"), F.lit("1").alias("question"))
    return marking.mark(submissions, criteria, marking.keeper(folder(spark, "marking")))["grades"].select("submission_id", "total_marks_awarded", "total_max_possible")


_PAPER = (
    '{{"total_marks": {total}, "questions": [{{"question_number": "Question 1", "marks": "99", "sub_questions": [{{"marks": "2"}}, {{"marks": "5 of 60", "sub_questions": [{{"marks": {inner}}}, {{"content": "Explain it. (4 marks)", '
    '"sub_questions": [{{"content": "nothing stated"}}]}}]}}, {{"content": "none"}}]}}, {{"question_number": "2", "max_marks": "7"}}]}}'
)


@query("SELECT p_partkey AS paper_id, CASE p_partkey % 4 WHEN 0 THEN 30.0 WHEN 1 THEN 6.0 + p_size % 3 WHEN 2 THEN 7.0 ELSE CASE WHEN p_partkey % 8 = 3 THEN 6.5 ELSE 106.0 END END AS marks FROM part")
def a04_leaf_sums(spark, sf_dir):
    """A paper for each part: with a total, asked for its nested question, for its plain one, or for one that it does not have."""
    from ..operators import papers

    k, inner = F.col("p_partkey") % 4, (F.col("p_size") % 3).cast("string")
    text = _PAPER.replace("{{", "{").replace("}}", "}")
    doc = F.replace(F.replace(F.lit(text), F.lit("{inner}"), inner), F.lit("{total}"), F.when(k == 0, '"54 in all, maximum marks: 30"').otherwise("null"))
    p = table(spark, sf_dir, "part")
    asked = p.select(F.col("p_partkey").alias("paper_id"), F.when(k == 1, "Q1").when(k == 2, "2").when(k == 3, "9").otherwise("1").alias("question"), F.when(F.col("p_partkey") % 8 == 3, 6.5).alias("judged"))
    return papers.question_marks(p.select(F.col("p_partkey").alias("paper_id"), doc.alias("doc")), asked).select("paper_id", "marks")
