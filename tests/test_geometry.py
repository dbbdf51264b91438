import json

from pyspark.sql import functions as F

from gradeloom.operators import geometry, layout, marking, rubric

WORD = "submission_id string, page int, block int, line int, word int, x0 double, y0 double, x1 double, y1 double, text string"


def words(spark, *lines, page=1):
    rows = [("s", page, 0, i, j, 20.0 + 60 * j, 20.0 + 14 * i, 70.0 + 60 * j, 30.0 + 14 * i, w) for i, t in enumerate(lines) for j, w in enumerate(t.split())]
    return spark.createDataFrame(rows, WORD)


def test_scores_touch_neither_each_other_nor_text(spark):
    w = words(spark, "Sales 1,250 300", "Plain words only here", "Last 9")
    r = w.filter("word = 0").select("submission_id", F.col("line").alias("rect_id"), "page", *geometry.BOX)
    labels = r.withColumn("order", F.col("rect_id")).withColumn("label", F.lit("0.5"))
    twice = labels.union(labels.withColumn("rect_id", F.col("rect_id") + 10))
    out = geometry.place_scores(twice, w, 600.0, 800.0).collect()
    boxes = [(x.x, x.y - 10, x.x + 52, x.y + 3) for x in out]
    assert len(out) == 6 and all(not geometry._hits(b, boxes[:i]) for i, b in enumerate(boxes))
    first = next(x for x in out if x.rect_id == 0)
    assert first.x == 193.0 and first.y == 28.0  # behind the last figure of the row
    text = [(x.x0, x.y0, x.x1, x.y1) for x in w.collect()]
    assert not any(geometry._hits(b, text) for b in boxes)
    assert geometry.place_scores(labels.limit(0), w, 600.0, 800.0).count() == 0


def test_notes_keep_their_distance(spark):
    rows = [("s", i, 1, i, 300.0, 50.0 + i, None, None) for i in range(4)] + [("s", 9, 1, 9, None, None, 100.0, 400.0)]
    df = spark.createDataFrame(rows, "submission_id string, rect_id int, page int, order int, x1 double, y0 double, y_min double, y_max double")
    out = {r.rect_id: (r.x, r.y) for r in geometry.place_notes(df, 600.0, 800.0).collect()}
    ys = sorted(y for _, y in out.values())
    assert all(b - a > 14 for a, b in zip(ys, ys[1:])) and out[0] == (306.0, 49.0) and out[9][0] == 576.0 and 100 <= out[9][1] <= 385


def test_anchor_tiers(spark):
    w = words(spark, "Goodwill on acquisition is 1,250 thousand", "Depreciation 14 million", "the consolidated retained earnings moved", "Reserves 77")
    lines = layout.lines(w)
    asked = [(1, "goodwill ON acquisition"), (2, "nobody wrote Goodwill on acquisition is 1,250 thousand here today at all"), (3, "£14m of"), (3_1, "depreciation £14m"), (4, "consolidated earnings"), (5, "reserves without words"), (6, "nothing of it")]
    out = {r.evidence_id: (r.tier, r.y0) for r in geometry.resolve_anchors(spark.createDataFrame([("s", *x) for x in asked], "submission_id string, evidence_id int, evidence string"), lines).collect()}
    assert out[1] == (1, 20.0) and out[2] == (2, 20.0) and out[31] == (3, 34.0) and out[4] == (4, 48.0) and out[5] == (4, 62.0) or out[5] == (5, 62.0)
    assert 6 not in out
    bounds = spark.createDataFrame([("s", 1, 40.0, 100.0)], "submission_id string, page int, y_min double, y_max double")
    inside = geometry.resolve_anchors(spark.createDataFrame([("s", *x) for x in asked], "submission_id string, evidence_id int, evidence string"), lines, bounds).collect()
    assert 1 not in {r.evidence_id for r in inside} and all(r.y0 >= 40 for r in inside)


def test_one_entry_point(spark, tmp_path):
    doc = {"answers": [{"question_number": "1", "marking_criteria": [
        {"description": "Goodwill is the excess of the consideration over net assets", "marks": 0.5, "criterion_id": "MM01", "category": "narrative"}, {"description": "Dr Goodwill 12,000", "marks": 1, "criterion_id": "MM02", "category": "journal"},
        {"description": "Depreciation for the year 900", "marks": 1, "criterion_id": "MM03"}]}]}
    criteria = rubric.criteria(spark.createDataFrame([("m", json.dumps(doc))], "model_answer_id string, doc string"))
    text = "Goodwill is the excess of consideration over net assets\nDr Goodwill 12,000"
    scripts = spark.createDataFrame([("s", "m", text, "", "Ann", "1"), ("t", "m", None, None, "Bob", "1")], "submission_id string, model_answer_id string, text string, reference string, student string, question string")
    out = marking.mark(scripts, criteria, marking.keeper(str(tmp_path)))
    grades = {r.submission_id: (r.total_marks_awarded, r.total_max_possible) for r in out["grades"].collect()}
    assert grades["s"] == (1.5, 2.5) and grades["t"][0] == 0.0
    rows = out["breakdown"].filter("submission_id = 's'").orderBy("rubric_rank").collect()
    assert [(r.criterion_id, r.marks_awarded) for r in rows] == [("MM01", 0.5), ("MM02", 1.0), ("MM03", 0.0)]
    report = out["report"].filter("submission_id = 's'").orderBy("_order").collect()
    assert [r.criterion for r in report][:2] == ["TOTAL", "Goodwill is the excess of the consideration over net assets"] and report[0].marks_awarded == "1.5"


def test_rectangles_are_not_joined_back(spark):
    """what is sought for a rectangle was joined back to all of them, so underlines worked out their input seven times."""
    boxes = spark.createDataFrame([("s", 1, 0, 10.0 * i, 10.0, 10.0 * i + 8, 20.0, f"w{i}") for i in range(3)], "submission_id string, page int, block int, x0 double, y0 double, x1 double, y1 double, text string")
    rects = spark.createDataFrame([("s", 7, 1, 12.0, 11.0, 19.0, 19.0), ("s", 8, 2, 0.0, 0.0, 5.0, 5.0)], "submission_id string, rect_id int, page int, x0 double, y0 double, x1 double, y1 double")
    out = geometry.underlines(rects, boxes, boxes, 600.0)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3
    assert sorted(tuple(r) for r in out.collect()) == [("s", 7, 1, 10.0, 28.0, 22.0), ("s", 8, 2, 10.0, 5.0, 7.0)]
