"""Reading submissions and rubrics, validating them, and writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

SUBMISSION = "question string, sub_parts array<struct<question_number:string,answer:string>>, question_heading_text string, page_texts array<struct<page:int,text:string>>, pages array<int>, student_name string"
NUMERICAL = "grades array<struct<question_number:string,score:double,total_marks:double,comments:array<string>,breakdown:array<struct<criterion_id:string,criterion:string,marks_awarded:double,max_possible:double,reason:string,evidence:string,column_header:string>>>>"


def submissions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of JSON lines below ``path``: unknown keys are dropped, the file name and time added; lines that do not parse or have no parts are bad."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("source_filename"))
    parsed = raw.withColumn("doc", F.from_json("value", SUBMISSION)).withColumn("extracted_at", F.current_timestamp())
    good = F.coalesce(F.size("doc.sub_parts") >= 1, F.lit(False))
    return parsed.filter(good).select("doc.*", "source_filename", "extracted_at"), parsed.filter(~good).select("value", "source_filename")


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of rows with a JSON ``value``: the submission's own keys as columns, unknown ones and nulls dropped; rows that do not parse or have no parts are bad."""
    doc = lines.withColumn("doc", F.from_json("value", SUBMISSION))
    good, bad = quarantine(doc, F.size("doc.sub_parts") >= 1)
    return good.select(*(c for c in lines.columns if c != "value"), "doc.*"), bad.drop("doc")


def judged(raw: DataFrame) -> DataFrame:
    """Rows of the judge's answers (submission_id, response): JSON isolated from chat, also where its grades are a string of JSON; none where there is none."""
    said = X.isolate_json(F.col("response"))
    whole = F.from_json(said, NUMERICAL)
    inner = F.from_json(F.concat(F.lit('{"grades":'), F.get_json_object(said, "$.grades"), F.lit("}")), NUMERICAL)
    doc = raw.withColumn("doc", F.coalesce(F.when(F.size(whole["grades"]) >= 1, whole), inner))
    grade = doc.select("submission_id", F.explode("doc.grades").alias("g"))
    return grade.select("submission_id", "g.question_number", F.posexplode("g.breakdown").alias("item_pos", "b")).select("submission_id", "question_number", "item_pos", "b.criterion_id", "b.criterion", "b.marks_awarded", "b.max_possible", "b.reason", X.evidence_list(F.col("b.evidence")).alias("evidence"), "b.column_header")


def pruned(df: DataFrame, keys: list[str]) -> DataFrame:
    """S3: the columns of an allow-list that the table has, so that the scan reads no others."""
    return df.select(*(k for k in keys if k in df.columns))


def lookup(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` with the row of ``df`` that has their key; keys that ``df`` lacks, and null ones, find nothing."""
    return wanted.join(df, key)


def load(jobs: DataFrame, students: DataFrame, models: DataFrame, grades: DataFrame | None = None) -> DataFrame:
    """Jobs (submission_id, model_answer_id, grade_id) with their three documents; a job whose student's document is missing fails the query."""
    found = jobs.join(students.withColumn("_student", F.lit(True)), "submission_id", "left")
    found = found.withColumn("_checked", F.assert_true(F.col("_student").isNotNull(), F.concat(F.lit("no student document "), F.coalesce(F.col("submission_id").cast("string"), F.lit("null")))))
    found = found.filter(F.col("_checked").isNull()).drop("_student", "_checked").join(models, "model_answer_id", "left")
    return found if grades is None else found.join(grades, "grade_id", "left")


def question_block(parts: DataFrame, question: str) -> DataFrame:
    """The parts of one question: from a label with its number on, up to one with another; parts before any number belong to it."""
    number = F.nullif(F.regexp_extract("label", "([0-9]+)", 1), F.lit(""))
    before = Window.partitionBy("submission_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("_q", F.coalesce(F.last(number, ignorenulls=True).over(before), F.lit(question))).filter(F.col("_q") == question).drop("_q")


def saved(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows appended to a table with an id made of their key and content; returns (key, id)."""
    made = df.withColumn("id", F.sha2(F.to_json(F.struct(*df.columns)), 256))
    made.write.mode("append").parquet(path)
    return made.select(key, "id")


def letter_labels(parts: DataFrame, question: str) -> DataFrame:
    """Lone letters take the number before them, "4.2" then "A)" is "4.2(A)"; before any number they take "<question>.1".

    ``parts``: submission_id, pos, label.
    """
    before = Window.partitionBy("submission_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    number = F.when(F.col("label").rlike(r"^\s*[0-9]"), F.regexp_extract("label", r"([0-9]+(?:\.[0-9]+)*)", 1))
    letter = F.regexp_extract("label", r"^\s*\(?([A-Za-z])[).]?\s*$", 1)
    held = F.coalesce(F.last(number, ignorenulls=True).over(before), F.lit(f"{question}.1"))
    return parts.withColumn("full_label", F.when(letter != "", F.concat(held, F.lit("("), letter, F.lit(")"))).otherwise(F.trim("label")))


def flat_text(parts: DataFrame) -> DataFrame:
    """One text for each submission of (submission_id, pos, label, answer): "--- label ---" and the answer, in order."""
    piece = F.concat(F.lit("--- "), F.coalesce("label", F.lit("")), F.lit(" ---\n"), F.coalesce("answer", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"))))
    return parts.groupBy("submission_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "\n").alias("text"))


def write_report(report: DataFrame, path: str) -> None:
    """The report as CSV with a header, a folder for each question whose files, by name, have its rows in report order.

    Tasks take ranges of the whole order, so a question with most rows is written by many of them.
    """
    order = ["question", "submission_id", "_order"]
    report.repartitionByRange(*order).sortWithinPartitions(*order).drop("_order", "submission_id").write.mode("overwrite").partitionBy("question").option("header", True).option("encoding", "UTF-8").csv(path)


def question_list(model_answers: DataFrame) -> DataFrame:
    """Id, title ("Untitled" if blank), marks (max_marks, else total_marks, else "?"; zero counts as missing), description."""
    given = lambda c: F.when(~F.trim(F.col(c).cast("string")).isin("", "0", "0.0"), F.col(c).cast("string"))
    return model_answers.select("model_answer_id", F.coalesce(F.nullif(F.trim("question_title"), F.lit("")), F.lit("Untitled")).alias("question_title"), F.coalesce(given("max_marks"), given("total_marks"), F.lit("?")).alias("total_marks"), "description")


def update_reports(grades: DataFrame, reports: DataFrame, path: str) -> None:
    """Grades with the CSV text of their report and the time it was made, as a new table at ``path``; others stay as they are.

    ``reports``: submission_id, csv. Read the result, then move it into place: a plain folder of files has no transactions.
    """
    new = reports.select("submission_id", F.col("csv").alias("_csv"))
    out = grades.drop("report_csv", "report_at").join(new, "submission_id", "left")
    out.withColumn("report_at", F.when(F.col("_csv").isNotNull(), F.current_timestamp())).withColumnRenamed("_csv", "report_csv").write.mode("overwrite").parquet(path)


def quarantine(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a test, and the others; a null test fails."""
    good = F.coalesce(ok, F.lit(False))
    return df.filter(good), df.filter(~good)
