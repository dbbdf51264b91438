"""Steps that grow with the input: what they read, derive and shuffle once."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import criteria as C
from gradeloom.functions import text as X
from gradeloom.operators import geometry, holistic, judge, layout

DATA = os.environ.get("QUERY_TEST_DIR", "/root/testdata/sf0.001")


def test_evidence_meets_lines_once(spark):
    """lines come from their words twice (met, and the pages' tokens), not once for each tier, and what comes spread by scripts stays."""
    page = ["NOTE 77:", "Profit for the year 1250", "Profits for the year 1250 x", "Total assets of group 4400"]
    words = [("s", 1, 0, n, i, 40.0 * i, 12.0 * n, 40.0 * i + 30, 12.0 * n + 10, w) for n, text in enumerate(page) for i, w in enumerate(text.split())]
    words = spark.createDataFrame(words, "submission_id string, page int, block int, line int, word int, x0 double, y0 double, x1 double, y1 double, text string").repartition(3, "submission_id")
    said = [("s", 1, "profit for the year 1250"), ("s", 2, "Total assets of groups 4400"), ("s", 3, "NOTE 77 : again"), ("s", 4, "Profit for year 4400; total assets of group"), ("s", 5, None), ("s", 6, "Profit for the year 1251")]
    evidence = spark.createDataFrame(said, "submission_id string, evidence_id int, evidence string").repartition(3, "submission_id")
    old = {k: spark.conf.get(k) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = layout.find_evidence(layout.lines(words), evidence)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {r.evidence_id: (r.tier, r.y0, r.fragment) for r in found.collect()} == {1: (1, 12.0, "profit for the year 1250"), 2: (4, 36.0, None), 4: (1, 36.0, "total assets of group")}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert plan.count("partial_collect_list(struct(word") == 2
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "page" in x]


def test_tokens_are_one_pattern(spark):
    """the words of a text without stop words, whatever stands between them."""
    deal = random.Random(3)
    parts = [*X.STOP_WORDS[::4], "therefore", "there", "thereby", "Withstand", "net1", "1250", "ab", "abc", "abcd", "É", "_", "-", " ", "\n", ",", "İ"]
    texts = ["".join(deal.choice(parts) for _ in range(12)) for _ in range(300)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for least in (1, 3, 4, 10):
        got = [(r.low, r.w) for r in df.select("t", X.tokens(df.t, least).alias("w")).selectExpr("lower(t) low", "w").collect()]
        assert got == [(low, None if low is None else [w for w in re.findall("[a-z0-9]+", low) if len(w) >= least and w not in X.STOP_WORDS]) for low, _ in got]
    assert "lambdafunction" not in df.select(X.tokens(df.t))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_judge_shuffles_the_table_only(spark, monkeypatch):
    """what is derived by script stays where the view has spread its scripts."""
    from gradeloom.plans import catalog, marking_view

    monkeypatch.setattr(marking_view, "TASK_ROWS", 500)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = catalog.queries()["d01_offline_judge"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert moved and all("REPARTITION_BY_NUM" in x for x in moved)


def test_judge_counts_a_part_once(spark):
    """a word that a line repeats, and a figure that it states in two spellings, are one part each."""
    rows = [("s", "Goodwill goodwill goodwill\nnet assets 12,000 or 12000 there", 1, "A", "Goodwill of net assets 12,000", 1.0, "", True)]
    pairs = spark.createDataFrame(rows, "submission_id string, text string, pos int, criterion_id string, description string, marks double, category string, exact_match boolean")
    one = judge.offline(pairs).head()
    assert (one.marks_awarded, one.evidence) == (1.0, ["net assets 12,000 or 12000 there"])
    assert {(r.key, r.line_no) for r in judge.script_index(pairs).collect()} >= {("wgood", 0), ("wgoodw", 0), ("wasse", 1), ("wasset", 1), ("n12000", 1), ("n12,000", 1)}


def test_lines_worth_so_much_each_are_parted_once(spark):
    """the parts of a line are made in one place, before the only shuffle by document."""
    from gradeloom.operators import rubric

    lines = [{"description": "Goodwill 12; hr; Cash 13", "marks": "1/2 mk each max 1"}, {"description": "in all 7 units", "marks": "1/4 mk each max 2"}, {"description": "Cost of sales 12", "marks": 1}, {"description": "hr", "marks": 1}, {"description": "Share capital", "marks": 6}]
    doc = json.dumps({"answers": [{"question_number": "1", "marking_criteria": lines}]})
    found = rubric.criteria(spark.createDataFrame([("m", doc)], "model_answer_id string, doc string"))
    assert [(r.pos, r.description, r.marks) for r in found.orderBy("pos").collect()] == [(1, "Goodwill 12", 0.5), (2, "Cash 13", 0.5), (3, "in all 7 units", 2.0), (4, "Cost of sales 12", 1.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning(model_answer_id" in x]) == 1
    assert max(x.count("(?i)\\\\bmk") for x in plan.splitlines()) <= 2


def test_sentences_meet_keywords_by_keys(spark):
    """words are looked up by keys made once for a sentence and once for a keyword; the score stays that of A15."""
    deal = random.Random(5)
    words = ["net", "nets", "asset", "assets", "assetship", "valuer", "valuation", "val", "valu", "tax", "ta", "fair", "f", "20x4", "internet", "of", "Goodwill", "goodw", "good", ""]
    some = lambda n, by=" ": by.join(deal.choice(words) for _ in range(n))
    scripts = [(k, ". ".join(some(deal.randint(1, 5), deal.choice(" -/")) for _ in range(4)) + ".") for k in range(20)]
    criteria = [(k, c, [some(deal.randint(1, 3), deal.choice(" -/")) for _ in range(deal.randint(1, 4))], "") for k in range(20) for c in range(8)] + [(0, 8, [None, "tax"], None)]
    scripts = spark.createDataFrame(scripts, "submission_id int, text string")
    criteria = spark.createDataFrame(criteria, "submission_id int, criterion_pos int, keywords array<string>, description string")
    out = holistic.best_sentences(scripts, criteria, 0.2)
    pairs = criteria.join(scripts, "submission_id").selectExpr("*").select("submission_id", "criterion_pos", "keywords", F.posexplode(X.sentences(F.col("text"))).alias("p", "sentence"))
    best = {}
    for r in pairs.select("*", C.keyword_score(F.col("keywords"), F.col("sentence")).alias("score")).collect():
        if r.score >= 0.2:
            best[r.submission_id, r.criterion_pos] = max(best.get((r.submission_id, r.criterion_pos), (0, 0)), (r.score, -r.p))
    assert len(best) > 40 and {(r.submission_id, r.criterion_pos): (r.score, -r.sentence_pos) for r in out.collect()} == best
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "regexp_extract_all" in x]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_scores_are_placed_once(spark):
    """Python goes over a page once, and no word is shuffled by its page."""
    from gradeloom.plans import catalog

    plan = catalog.queries()["l07_place_scores"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?:MapInArrow|MapInPandas) ", plan.split("+- == Initial Plan ==")[0])) == 1
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "page" in x]


def test_headings_are_left_in_one_pass(spark):
    """a page's rectangles pass by its lines and values; no pair of them is joined back or ranked."""
    words = spark.createDataFrame([("s", 1, 0, 0, 0, 20.0, 20.0, 70.0, 30.0, "Workings:"), ("s", 1, 0, 1, 0, 20.0, 34.0, 70.0, 44.0, "Cost"), ("s", 1, 0, 1, 1, 80.0, 34.0, 130.0, 44.0, "125")], "submission_id string, page int, block int, line int, word int, x0 double, y0 double, x1 double, y1 double, text string")
    rects = words.filter("word = 0").selectExpr("submission_id", "line rect_id", "page", "x0", "y0", "x1", "y1")
    out = geometry.off_headings(rects, layout.lines(words), words)
    assert {r.rect_id: (r.y0, r.moved) for r in out.collect()} == {0: (34.0, True), 1: (34.0, False)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and plan.count("Join") == 2
