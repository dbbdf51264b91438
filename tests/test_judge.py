import pandas as pd

from gradeloom.operators import judge
from gradeloom.sources import tables


def test_offline_judge(spark, tmp_path):
    text = "Goodwill at acquisition is 12,000\nReserves rose"
    rows = [("s", text, 1, "A", "Goodwill at acquisition 12,000", 1.0, "", True), ("s", text, 2, "B", "Goodwill at acquisition 13,000", 1.0, "", True), ("s", text, 3, "C", "Reserves movement explained fully", 1.0, "", False), ("t", None, 1, "A", "Goodwill", 1.0, "", None)]
    pairs = spark.createDataFrame(rows, "submission_id string, text string, pos int, criterion_id string, description string, marks double, category string, exact_match boolean")
    out = {(r.submission_id, r.item_pos): r for r in judge.run(pairs, f"{tmp_path}/judged").collect()}
    assert [out[k].marks_awarded for k in sorted(out)] == [1.0, 0.0, 0.0, 0.0]
    assert out["s", 1].evidence == ["Goodwill at acquisition is 12,000"] and out["t", 1].evidence == []

    def none(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"submission_id": batch.submission_id, "item_pos": batch.pos, "criterion_id": batch.criterion_id, "criterion": batch.description, "category": "", "exact_match": False, "marks_awarded": 0.0, "max_possible": batch.marks, "reason": "", "evidence": [[] for _ in range(len(batch))]})

    assert judge.with_function(pairs, none).count() == 4
    twice = spark.createDataFrame([("s", 0, "A", "x", 0.5), ("s", 1, "A", "x", 1.0), ("s", 2, None, "y", 0.5)], "submission_id string, item_pos int, criterion_id string, criterion string, marks_awarded double")
    assert sorted(r.item_pos for r in judge.once_each(twice).collect()) == [1, 2]


def test_sentences_feed_one_leaf(spark):
    scored = spark.createDataFrame([("s", "a", 0, 0.9, 1.0), ("s", "b", 0, 0.5, 1.0), ("s", "a", 1, 0.8, 1.0), ("s", "b", 2, 0.7, 1.5)], "submission_id string, leaf string, sentence_pos int, score double, marks double")
    caps = spark.createDataFrame([("a", 1.5, "1", 2.0), ("b", 2.0, "1", 2.0)], "leaf string, max_marks double, section string, section_cap double")
    assert {r.leaf: r.marks_awarded for r in judge.sentence_leaves(scored, caps).collect()} == {"a": 1.5, "b": 0.5}


def test_question_list_and_updates(spark, tmp_path):
    m = spark.createDataFrame([("1", " ", "0", "12", "d"), ("2", "T", None, None, None)], "model_answer_id string, question_title string, max_marks string, total_marks string, description string")
    assert [tuple(r)[1:3] for r in tables.question_list(m).orderBy("model_answer_id").collect()] == [("Untitled", "12"), ("T", "?")]
    grades = spark.createDataFrame([("s", 1.0), ("t", 2.0)], "submission_id string, total double")
    tables.update_reports(grades, spark.createDataFrame([("s", "a,b")], "submission_id string, csv string"), f"{tmp_path}/g")
    assert {r.submission_id: (r.report_csv, r.report_at is not None) for r in spark.read.parquet(f"{tmp_path}/g").collect()} == {"s": ("a,b", True), "t": (None, False)}
