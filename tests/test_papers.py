"""Marks of questions from papers of mixed depth, against a recursive version; the report's files in order."""

import json
import random

from gradeloom.operators import papers
from gradeloom.sources import tables


def worth(q):
    own = next((float(q[k]) for k in papers.KEYS if q.get(k) and float(q[k]) > 0), 0.0)
    below = sum(map(worth, q.get("sub_questions") or []))
    return below if below > 0 else own


def test_leaf_sums_at_any_depth(spark):
    rng = random.Random(6)

    def question(depth):
        q = {rng.choice(papers.KEYS): rng.choice([None, 0, 1, 2.5, "3"])}
        if depth and rng.random() < 0.6:
            q["sub_questions"] = [question(depth - 1) for _ in range(rng.randint(0, 3))]
        return q

    docs = [{"questions": [{"question_number": str(k), "sub_questions": [question(4) for _ in range(3)]} for k in (1, 2)]} for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "paper_id int, doc string")
    got = {(r.paper_id, r.top): r.leaf_sum for r in papers.leaf_sums(papers.nodes(df)).collect()}
    want = {(i, k): v for i, d in enumerate(docs) for k, q in enumerate(d["questions"]) if (v := sum(map(worth, q["sub_questions"]))) > 0}
    assert got == want and len(want) > 60


def test_the_chain(spark):
    doc = {"questions": [{"question_number": "Q1", "content": "Explain (12 marks)"}, {"question_number": "2(a)", "total_marks": 9, "sub_questions": [{"marks": 4}]}, {"question_number": "3", "marks": "x"}]}
    rows = [(0, json.dumps(doc)), (1, json.dumps(doc | {"total_marks": "maximum 40 of 54"})), (2, "not json"), (3, None)]
    asked = [(0, "1", None), (0, "2", 5.0), (0, "3", 5.0), (0, "3b", None), (1, "2", None), (2, "1", 3.0), (3, "1", None)]
    out = papers.question_marks(spark.createDataFrame(rows, "paper_id int, doc string"), spark.createDataFrame(asked, "paper_id int, question string, judged double"))
    assert {(r.paper_id, r.question): r.marks for r in out.collect()} == {(0, "1"): 12.0, (0, "2"): 9.0, (0, "3"): 5.0, (0, "3b"): 9.0, (1, "2"): 40.0, (2, "1"): 3.0, (3, "1"): 0.0}


def test_report_of_one_question_is_written_by_several_tasks(spark, tmp_path):
    rows = [("1" if k % 10 else "2", k, j, f"row {k} {j}") for k in range(400) for j in range(5)]
    random.Random(1).shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task's otherwise
    tables.write_report(spark.createDataFrame(rows, "question string, submission_id int, _order int, criterion string").repartition(4), f"{tmp_path}/report")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "report" / "question=1").glob("*.csv"))
    lines = [x for f in files for x in f.read_text().splitlines()[1:]]
    assert len(files) > 1 and lines == [f"row {k} {j}" for k in range(400) if k % 10 for j in range(5)]
