from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.operators import layout, restatements

L = F.lit


def values(spark, *columns):
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).head()
    return [row[i] for i in range(len(columns))]


def test_labels_sections_and_points(spark):
    assert values(spark, *(X.same_question(L(a).cast("string"), L(b)) for a, b in (("4.1", "Q4(1)"), ("4", "4.2"), (None, "1"), ("3", "4")))) == [True, True, True, False]
    found = values(spark, X.inline_sections(L("intro\nRisk (3 Marks)\nbody one\nControls (1.5 mks)\nmore")))[0]
    assert [tuple(s) for s in found] == [("Risk", 3.0, "body one"), ("Controls", 1.5, "more")]
    assert values(spark, X.body_points(L("- first point here\n- second point here\n\nshort")))[0] == ["first point here", "second point here"]


def test_spellings(spark):
    a, n, c = values(spark, X.anchor_variations(L("GBP 5m x 20%")), X.number_variations(L("1,250.00")), X.context_words(L("The cost of 250 shares and shares issued")))
    assert a[0] == "GBP 5m x 20%" and {"£5m x 20%", "GBP 5 million x 20%", "GBP 5m × 20%"} <= set(a) and len({x.lower() for x in a}) == len(a)
    assert {"1250", "1,250", "1 250", "1,250.00"} <= set(n) and c == ["cost", "shares", "issued"]


def test_anchors_and_marks(spark):
    text = L("The parent controls  the assets of the group")
    assert values(spark, X.grounded_anchor(L("controls the assets"), text), X.grounded_anchor(L("so parent controls the assets of it"), text), X.grounded_anchor(L("nothing of that kind here"), text)) == ["controls the assets", "parent controls the assets of", "nothing of that kind"]
    none = L(None).cast("double")
    cases = [(L("Maximum marks: 12"), none, none), (L("Discuss. (8 marks)"), none, none), (L("x"), L(7.0), none), (L("x"), none, L(0.0))]
    assert values(spark, *(X.question_max_marks(d, m, s, none, none, none) for d, m, s in cases)) == [12.0, 8.0, 7.0, None]
    assert values(spark, X.tool_arguments(L('{"tool_calls":[{"function":{"arguments":"{1}"}}]}')), X.tool_arguments(L("no"))) == ["{1}", None]


def test_unmarked_lines(spark):
    s = spark.createDataFrame([("s", "Cost is 12\nCost is 12\nTotal cost is 12 altogether\nProfit 9")], "submission_id string, text string")
    paid = spark.createDataFrame([("s", "cost IS 12"), ("s", "Profit")], "submission_id string, evidence string")
    assert [r.line for r in restatements.unmarked_lines(s, paid).collect()] == ["Total cost is 12 altogether"]
    rows = spark.createDataFrame([("s", ["Cost is 12"])], "submission_id string, evidence array<string>")
    flagged = spark.createDataFrame([("s", "A", "Profit 9"), ("s", "A", "Cost is 12"), ("s", "A", "not there")], "submission_id string, criterion_id string, line string")
    assert [r.evidence for r in restatements.accept_restatements(flagged, s, rows).collect()] == [["Profit 9"]]


def test_bounds_and_belonging(spark):
    lines = spark.createDataFrame([("s", 1, 0, 0, "Question 4.1 Risk", 10.0, 50.0, 90.0, 60.0), ("s", 1, 0, 1, "some 4 text", 10.0, 70.0, 90.0, 80.0), ("s", 2, 0, 0, "4.2 Next", 10.0, 20.0, 90.0, 30.0)], "submission_id string, page int, block int, line int, text string, x0 double, y0 double, x1 double, y1 double")
    b = layout.question_bounds(lines, spark.createDataFrame([("s", "4.1"), ("s", "4.2")], "submission_id string, question string")).orderBy("question").collect()
    assert [(r.page, r.y_min, r.next_page, r.next_y) for r in b] == [(1, 50.0, 2, 20.0), (2, 20.0, None, None)]
    found = spark.createDataFrame([("s", 0, "Dr Cash 5", "Cr Cash 5"), ("s", 0, "Dr Cash 5", "Dr Cash 5"), ("s", 1, "Dr Loan", "Cr Loan")], "submission_id string, item_pos int, criterion string, text string")
    assert sorted(r.text for r in layout.belonging(found).collect()) == ["Cr Loan", "Dr Cash 5"]
