import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import finalize, holistic, recovery, resolve, row_guards, rubric, set_guards

COLUMNS = "submission_id string, item_pos int, criterion_id string, criterion string, category string, exact_match boolean, marks_awarded double, max_possible double, reason string, evidence array<string>"
TEXT = "--- 1 ---\nGoodwill is the excess of consideration over net assets\nDr Goodwill 12,000\nShares 416,000 x 25 = 10,400,000\n--- 2 ---\nshare of post acq reserves 3,850,000.00"


def judged(spark, *rows):
    return spark.createDataFrame([("s", i, None, *r) for i, r in enumerate(rows)], COLUMNS)


def scripts(spark, text=TEXT, reference="Define goodwill for the group"):
    return spark.createDataFrame([("s", text, reference)], "submission_id string, text string, reference string")


def marks(df):
    return [r.marks_awarded for r in df.orderBy("item_pos").collect()]


def test_row_guards(spark):
    rows = judged(
        spark,
        ("Goodwill definition stated", "narrative", False, 0.6, 0.5, "", ["Goodwill is the excess of consideration over net assets"]),
        ("No evidence", "", False, 0.5, 0.5, "", []),
        ("Invented", "", False, 0.5, 0.5, "", ["this sentence stands nowhere in the script at all"]),
        ("Copied", "", False, 0.5, 0.5, "", ["Define goodwill for the group"]),
        ("Cr Goodwill 12,000", "journal", False, 1.0, 1.0, "", ["Dr Goodwill 12,000"]),
        ("Cost of shares GBP10.4m (416,000 x 25)", "calculation", False, 0.0, 1.0, "", []),
        ("Dr Goodwill 12,000", "journal", False, 0.0, 1.0, "", []),
        (None, None, None, None, None, None, None),
    )
    out = row_guards.apply(row_guards.prepare(rows, scripts(spark))).cache()
    assert marks(out) == [0.5, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0]
    audit = {r.item_pos: [a.guard for a in r.audit] for r in out.collect()}
    assert audit[1] == ["F6"] and audit[2] == ["F7"] and audit[4] == ["F16"] and audit[5] == ["F12"] and audit[6] == ["F17"]
    empty = row_guards.apply(row_guards.prepare(rows.limit(0), scripts(spark)))
    assert empty.count() == 0


def test_negation_reads_number_of(spark):
    rows = judged(spark, ("Number of shares is required", "", False, 0.5, 0.5, "", ["no of shares 100"]), ("An impairment review is required", "", False, 0.5, 0.5, "", ["no impairment is needed"]))
    assert marks(row_guards.negation(row_guards.prepare(rows, scripts(spark)))) == [0.5, 0.0]


def set_rows(spark, rows):
    base = row_guards.prepare(judged(spark, *[r[0] for r in rows]), scripts(spark))
    extra = spark.createDataFrame([(i, *r[1]) for i, r in enumerate(rows)], "item_pos int, group string, position int, column_header string, of_component_of string, of_source_ids array<string>, expected_amount double, sign_sensitive boolean, column string, blocked boolean")
    return base.join(extra, "item_pos")


def test_set_guards(spark):
    none = ("g", 1, None, None, None, None, None, None, None)
    rows = set_rows(
        spark,
        [
            (("Investment 12,000 13,000 14,000", "", False, 1.0, 1.0, "", ["12,000 13,000 14,000 15,000"]), none),
            (("Investment 12,000 again", "", False, 0.5, 0.5, "", ["12,000 13,000 14,000"]), none),
            (("'40% x £9.6m x 5/12 = 1,600'.", "", False, 0.5, 0.5, "", ["1,400"]), none),
            (("Reserves", "", False, 0.5, 0.5, "", ["Less 3,125"]), ("h", 2, None, None, None, 3125.0, True, None, None)),
            (("Point", "", False, 0.5, 0.5, "No share working present here", ["x"]), ("k", 3, None, None, None, None, None, None, None)),
        ],
    )
    out = set_guards.apply(rows).cache()
    assert marks(out) == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert {r.item_pos: [a.guard for a in r.audit] for r in out.collect()} == {0: [], 1: ["G1"], 2: ["G3"], 3: ["G5"], 4: ["G9"]}
    assert marks(set_guards.contradiction(out)) == marks(set_guards.sign(out)) == marks(out)


@pytest.mark.parametrize("text,want", [("'40% × £9.6m × 5/12 = 1,600'.", "1600"), ("'30% × (£46.25m − £6.25m) = 12,000'", "12000"), ("'Less liabilities … = (27,300)'", "27300"), ("'… = 1,600.'", None)])
def test_parent_result(spark, text, want):
    assert spark.range(1).select(set_guards.parent_result(F.lit(text)).alias("x")).head().x == want


def test_locality(spark):
    rows = spark.createDataFrame([("s", i, "g", sec, 1.0, "", []) for i, sec in enumerate((1, 1, 2, None))], "submission_id string, item_pos int, group string, section int, marks_awarded double, reason string, audit array<struct<guard:string,delta:double,reason:string>>")
    assert marks(set_guards.locality(rows)) == [1.0, 1.0, 0.0, 1.0]
    assert marks(set_guards.locality(rows.filter("item_pos <> 1"))) == [1.0, 1.0, 1.0]


def test_recovery_and_merge(spark):
    rows = spark.createDataFrame([("s", 0, "a", 0.0, 1.0, "OF1", 3125, False), ("s", 1, "b", 0.0, 1.0, "OF1", 2500, False), ("s", 2, "c", 0.0, 1.0, "OF1", 1350, False), ("s", 3, "d", 0.5, 1.0, None, None, False)], "submission_id string, item_pos int, criterion string, marks_awarded double, max_possible double, of_component_of string, of_produces long, blocked boolean")
    out = recovery.recover(rows, scripts(spark).select("submission_id", "text")).cache()
    assert marks(out) == [0.0, 0.25, 0.25, 0.5]
    assert {r.item_pos: r.subset for r in out.collect()}[1] == [1350, 2500]
    merged = recovery.merge_components(out).orderBy("item_pos").collect()
    assert [(r.item_pos, r.marks_awarded, len(r.components or ())) for r in merged] == [(0, 0.0, 0), (1, 0.5, 2), (3, 0.5, 0)]


def test_recovery_goes_to_singles_beyond_twelve(spark):
    n = spark.range(1).select(F.size(recovery.subset_sums(F.sequence(F.lit(1), F.lit(13)).cast("array<long>"))).alias("n"), F.size(recovery.subset_sums(F.sequence(F.lit(1), F.lit(5)).cast("array<long>"))).alias("m")).head()
    assert (n.n, n.m) == (13, 31)


DOC = {"answers": [{"question_number": "1", "marking_criteria": [{"description": "Goodwill at acquisition", "marks": "2 1/4", "sub_criteria": [{"description": "Cost of shares issued", "marks": 0.5, "criterion_id": "G1"}, {"description": "hr", "marks": 1}]}, {"description": "Whole question total given", "marks": 6}],
                    "sub_answers": [{"question_number": "1.1", "subsection_max": 4, "sub_answers": [{"question_number": "1.1a", "marks": 3, "marking_criteria": [{"description": "Tutorial note on the adjustment", "marks": 1}, {"description": "Reserves at year end", "marks": 1}]}]}]}]}


def test_rubric(spark):
    docs = spark.createDataFrame([("m", json.dumps(DOC)), ("n", None), ("o", "not json")], "model_answer_id string, doc string")
    found = rubric.criteria(docs).orderBy("pos").collect()
    assert [(r.pos, r.description, r.marks, r.criterion_id) for r in found] == [(1, "Goodwill at acquisition - Cost of shares issued", 0.5, "G1"), (2, "Tutorial note on the adjustment", 1.0, None), (3, "Reserves at year end", 1.0, None)]
    kept = rubric.drop_headings(rubric.deduplicate(rubric.drop_commentary(rubric.criteria(docs))))
    assert [r.pos for r in kept.orderBy("pos").collect()] == [1, 3]
    leaf = rubric.leaves(docs).collect()
    assert [(r.sub_question, r.max_marks, r.section_cap) for r in leaf] == [("1.1a", 3.0, 4.0)]


def test_resolve(spark):
    criteria = spark.createDataFrame([("m", 1, "MM01", "Goodwill is measured at the acquisition date", 1.0, ""), ("m", 2, "MM02", "Goodwill is measured at the acquisition date and tested", 1.0, ""), ("m", 3, "MM03", "Reserves", 1.0, "")], "model_answer_id string, pos int, criterion_id string, description string, marks double, category string")
    items = spark.createDataFrame([("s", 0, "m", "mm03", "anything"), ("s", 1, "m", None, "goodwill  IS measured at the acquisition date"), ("s", 2, "m", None, "Goodwill is measured at"), ("s", 3, "m", None, "unknown")], "submission_id string, item_pos int, model_answer_id string, criterion_id string, criterion string")
    found = {r.item_pos: (r.position, r.tier) for r in resolve.resolve(items, criteria).collect()}
    assert found == {0: (3, 0), 1: (1, 1), 2: (2, 2)}


def test_finalize(spark):
    rows = judged(spark, ("a", "", False, 7.25, 8.0, "", ["x"])).withColumn("position", F.lit(1))
    caps = spark.createDataFrame([("s", 7.0)], "submission_id string, max_marks double")
    assert finalize.totals(rows, caps).head().total_marks_awarded == 7.0
    criteria = spark.createDataFrame([("m", 1, "A", "a", 1.0, ""), ("m", 2, "B", "b", 1.0, ""), ("m", 3, "C", "c", 1.0, "section_header")], "model_answer_id string, pos int, criterion_id string, description string, marks double, category string")
    full = finalize.complete(rows, spark.createDataFrame([("s", "m")], "submission_id string, model_answer_id string"), criteria)
    assert [(r.position, r.marks_awarded, r.reason[:12]) for r in full.orderBy("item_pos").collect()] == [(1, 7.25, ""), (2, 0.0, "NOT ASSESSED")]
    grades = spark.createDataFrame([("s", "Ann", "1", 7.0, 9.0)], "submission_id string, student string, question string, total_marks_awarded double, total_max_possible double")
    report = finalize.report(full, grades).orderBy("_order").collect()
    assert [r.criterion for r in report] == ["TOTAL", "a", "b"] and report[0].marks_awarded == "7" and set(finalize.REPORT) <= set(report[0].asDict())
    assert finalize.summary(full).head().not_assessed == 1


def test_holistic(spark):
    leaves = spark.createDataFrame([("s", 0, "1a", "1", 4.0, 3.0, 3.0, ["x"], "r", "a)"), ("s", 1, "1b", "1", 4.0, 2.0, 2.0, ["x", "y"], "", "b)")], "submission_id string, item_pos int, sub_question string, parent_section string, section_cap double, max_marks double, marks_awarded double, evidence array<string>, reason string, student_label string")
    s = holistic.sections(leaves).head()
    assert (s.marks_awarded, s.max_possible, s.evidence, s.reason, s.student_label) == (4.0, 4.0, ["x", "y"], "r", "a)")
    points = spark.createDataFrame([("s", 0, 0, 1.5, "the control of assets passes to the parent", 1.0), ("s", 0, 1, 1.5, "short one", 0.5), ("s", 0, 2, 1.5, "risk moves with every single new contract", 1.0)], "submission_id string, item_pos int, point_pos int, leaf_max double, text string, marks double")
    t = holistic.ticks(points).orderBy("tick").collect()
    assert [(r.tick, r.key_phrase) for r in t] == [(1, "control of assets passes to the"), (2, None), (3, "risk moves with every single new")]


def test_layout(spark):
    from gradeloom.operators import layout

    words = [("s", 1, 0, 0, i, 10.0 + 40 * i, 10.0, 40.0 + 40 * i, 20.0, w) for i, w in enumerate("Item 20X4 20X5 Note".split())]
    words += [("s", 1, 0, 1, i, 10.0 + 40 * i, 30.0, 40.0 + 40 * i, 40.0, w) for i, w in enumerate("Revenue 1,250 1,300 9".split())]
    words = spark.createDataFrame(words, "submission_id string, page int, block int, line int, word int, x0 double, y0 double, x1 double, y1 double, text string")
    lines = layout.lines(words)
    assert sorted(r.text for r in lines.collect()) == ["Item 20X4 20X5 Note", "Revenue 1,250 1,300 9"]
    ev = spark.createDataFrame([("s", 1, "Revenue 1,250"), ("s", 2, "Revenues 1250 1,300 9"), ("s", 3, "nothing like it")], "submission_id string, evidence_id int, evidence string")
    found = {r.evidence_id: (r.tier, r.y0) for r in layout.find_evidence(lines, ev).collect()}
    assert found == {1: (1, 30.0), 2: (4, 30.0)}
    labels = spark.createDataFrame([("s", 1, 1, 10.0, 30.0, 40.0, 40.0)], "submission_id string, label_id int, page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.value for r in layout.value_rows(labels, words).collect()) == ["1,250", "1,300", "9"]
    targets = spark.createDataFrame([("s", 1, 1, 30.0, 40.0, "20X5")], "submission_id string, target_id int, page int, y0 double, y1 double, column string")
    headers = spark.createDataFrame([("s", 1, "20X5", 90.0, 10.0, 120.0, 20.0)], "submission_id string, page int, column string, x0 double, y0 double, x1 double, y1 double")
    assert layout.column_values(targets, words, headers).head().value == "1,300"


def test_sources_and_stream(spark, tmp_path):
    from gradeloom.sources import tables
    from gradeloom.streaming.uploads import mark_uploads

    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text(json.dumps({"question": "4", "sub_parts": [{"question_number": "4", "answer": "x"}], "odd": 1}) + "\nnot json\n")
    good, bad = tables.submissions(spark, str(inbox))
    assert good.count() == 1 and bad.count() == 1
    q = mark_uploads(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp"), lambda df: df.select("question"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1 and spark.read.parquet(str(tmp_path / "bad")).count() == 1
    parts = spark.createDataFrame([("s", i, x, "t") for i, x in enumerate(("a)", "b)", "4.2", "A)"))], "submission_id string, pos int, label string, answer string")
    assert [r.full_label for r in tables.letter_labels(parts, "4").orderBy("pos").collect()] == ["4.1(a)", "4.1(b)", "4.2", "4.2(A)"]
    assert tables.flat_text(parts).head().text.startswith("--- a) ---\nt\n--- b) ---")
    raw = spark.createDataFrame([("s", 'Here: ```json {"grades":[{"question_number":"1","breakdown":[{"criterion":"c","marks_awarded":0.5,"evidence":"a;b"}]}]} ```'), ("t", "sorry")], "submission_id string, response string")
    assert [(r.criterion, r.evidence) for r in tables.judged(raw).collect()] == [("c", ["a", "b"])]


def test_ticks_work_a_phrase_out_once(spark):
    points = spark.createDataFrame([(1, 0, 5.0, 0, "of the control of assets passes to the parent", 1.0)], "submission_id long, item_pos int, leaf_max double, point_pos int, text string, marks double")
    df = holistic.ticks(points)
    assert [r.key_phrase for r in df.orderBy("tick").collect()] == ["control of assets passes to the", None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("trim(text") == 1


def test_headings_meet_by_their_words_not_row_by_row(spark):
    rows = [("m", i, "" if i % 9 else "x", 2.5 if i % 4 == 0 else 0.5, ("Prepare the " if i % 4 == 0 else "") + f"goodwill{i % 5} reserve{i % 3} movement{i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "model_answer_id string, pos long, category string, marks double, description string")
    out = rubric.drop_headings(df, near=0)
    words = [{w for w in r[4].lower().split() if w not in ("the",)} for r in rows]
    kept = set()
    for i, r in enumerate(rows):
        others = [j for j in range(60) if j != i and len(words[i] & words[j]) >= 2]
        if not (r[3] == 2.5 and len(others) >= 1 and sum(rows[j][3] for j in others) >= 1.25):
            kept.add(i)
    assert {r.pos for r in out.collect()} == kept
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_other" not in plan and "_theirs" in plan


def test_summary_has_the_share_of_rows_with_marks(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0, "a"), (1, 0.0, 1.0, "NOT ASSESSED: x"), (1, 0.0, 2.0, "b"), (1, 0.5, 2.0, "c")], "submission_id long, marks_awarded double, max_possible double, reason string")
    assert finalize.summary(rows).head().placed_rate == 0.5


def test_recovery_sums_any_number_of_figures(spark):
    """of thirteen or more figures a shown sum of several confirms its members too, by the largest subset of each."""
    figures = [101 + 37 * i for i in range(14)]
    one, two = sum(figures[3:9]), sum(figures[10:12])
    text = f"Working\nAssets in total {one:,}\nPart of it {two}000\nMore 7,777"
    schema = "submission_id string, item_pos int, criterion string, marks_awarded double, max_possible double, of_component_of string, of_produces long, blocked boolean"
    rows = spark.createDataFrame([("s", i, "x", 0.0, 1.0, "OF1", v, False) for i, v in enumerate(figures)], schema)
    got = {r.item_pos: (r.subset, r.recovered) for r in recovery.recover(rows, spark.createDataFrame([("s", text)], "submission_id string, text string")).collect()}
    want = {}
    for n in range(2, 15):
        for c in itertools.combinations(figures, n):
            if sum(c) in (one, two):
                for v in c:
                    want[figures.index(v)] = max(want.get(figures.index(v), (0, 0, [])), (n, sum(c), list(c)))
    assert len(want) == 14 and sum(bool(r) for _, r in got.values()) == 6
    assert all(subset == want[i][2] for i, (subset, recovered) in got.items() if recovered)


def test_largest_subset_of_a_sum():
    """against all subsets, negative figures among them."""
    deal = random.Random(7)
    for _ in range(150):
        values = sorted(deal.sample(range(-9, 30), 8))
        total = deal.randint(-5, 60)
        every = [list(c) for n in range(1, 9) for c in itertools.combinations(values, n) if sum(c) == total]
        assert recovery.largest_of_sum(values, total, set()) == max(every, key=lambda c: (len(c), c), default=None)
