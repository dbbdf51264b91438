"""Hand-made cases of rules that one row, or all rows of a script, decide; random cases against plain Python."""

import ast
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import criteria as C
from gradeloom.operators import holistic, resolve, row_guards, set_guards

JUDGED = "submission_id string, item_pos int, criterion string, category string, exact_match boolean, marks_awarded double, max_possible double, reason string, evidence array<string>"


def guarded(spark, guard, rows, text, more=""):
    judged = spark.createDataFrame(rows, JUDGED + more)
    scripts = spark.createDataFrame([("s", text, "")], "submission_id string, text string, reference string")
    return {r.item_pos: r for r in guard(row_guards.prepare(judged, scripts)).collect()}


def row(pos, criterion, marks, most=1.0, evidence=(), *more):
    return ("s", pos, criterion, "", False, marks, most, "", list(evidence), *more)


def test_calculations(spark):
    """A script's calculations are all looked at, evidence's first twelve; a bracket needs a stated amount; evidence must be there."""
    others = [f"{k} x 7" for k in range(30, 48)]
    text = "\n".join([*others, "so 416,000 x 25 in all", "3 x 40 here"])
    worth = "Goodwill GBP10.4m (416,000 x GBP25)"
    out = guarded(spark, row_guards.calculated, [
        row(0, worth, 0.0), row(1, "Goodwill (416,000 x GBP25)", 0.0), row(2, worth, 0.25), row(3, "Goodwill GBP120", 0.25, 1.0, ["3 x 40 here"]),
        row(4, "Goodwill GBP120", 0.25, 1.0, ["made up 3 x 40 of mine"]), row(5, "Goodwill GBP120", 0.5, 1.0, ["; ".join([*others[:12], "3 x 40 here"])]), row(6, "Profit GBP120", 0.5, 1.0, ["3 x 40 here"]),
        row(7, "Profit GBP120", 0.5, 1.0, ["3 x 40 here", "profit"]), row(8, "Goodwill GBP11m (416,000 x GBP25)", 0.0),
    ], text)
    assert {k: r.marks_awarded for k, r in out.items()} == {0: 1.0, 1: 0.0, 2: 0.25, 3: 1.0, 4: 0.25, 5: 0.5, 6: 0.5, 7: 1.0, 8: 0.0}
    assert out[0].evidence[0].startswith("416,000 x 25") and out[3].evidence == ["3 x 40 here"]


def test_columns_by_their_canonical_names(spark):
    text = "Movements\nItem | Non-controlling interest | Retained earnings | Total\nProfit | 400 | 600 | 1000"
    more = ", expected_amount double, column string"
    right, wrong = ["Profit | 400 | 600 | 1000"], ["Profit | 600 | 400 | 1000"]
    out = guarded(spark, set_guards.column, [
        row(0, "a", 1.0, 1.0, right, 400.0, "nci"), row(1, "a", 1.0, 1.0, wrong, 400.0, "NCI"), row(2, "a", 1.0, 1.0, ["x | 400 | 400 | 1"], 400.0, "nci"), row(3, "a", 1.0, 1.0, [*wrong, *right], 400.0, "nci"),
        row(4, "a", 1.0, 1.0, wrong, 400.0, "share premium"), row(5, "a", 1.0, 1.0, wrong, 777.0, "nci"), row(6, "a", 1.0, 1.0, ["only 400"], 400.0, "retained"), row(7, "a", 1.0, 1.0, wrong, None, "nci"), row(8, "a", 1.0, 1.0, wrong, 400.0, None),
    ], text, more)
    assert {k for k, r in out.items() if r.marks_awarded == 0} == {1}


def test_broad_criteria_look_at_other_positions(spark):
    more = ", position int"
    small = [row(k, "small", 0.0, 0.5, [], p) for k, p in ((10, 4), (11, 5), (12, 6), (13, 7))]
    out = guarded(spark, set_guards.broad_gating, [row(0, "broad", 2.0, 2.0, [], 5), *small], "t", more)
    assert out[0].marks_awarded == (0.0 if 0.5 * 3 >= 0.75 * 2 else 2.0)  # the row at its own position does not count
    out = guarded(spark, set_guards.broad_gating, [row(0, "broad", 2.0, 2.0, [], None), *(row(k, "small", 0.0, 0.5, [], None) for k in range(1, 6))], "t", more)
    assert out[0].marks_awarded == 2.0
    out = guarded(spark, set_guards.broad_gating, [row(0, "broad", 2.0, 2.0, [], 5), *(row(k, "small", 0.0, 0.5, [], 5) for k in range(1, 6))], "t", more)
    assert out[0].marks_awarded == 2.0


def test_snippets_earn_once(spark):
    a, b, c = "the first long snippet here", "the second long snippet here", "the third long snippet here"
    rows = [row(0, "x", 1.0, 2.0, [a, b]), row(1, "y", 2.0, 2.0, [b]), row(2, "z", 0.5, 1.0, [a]), row(3, "w", 0.25, 1.0, [c, a]), row(4, "v", 0.2, 1.0, [c]), row(5, "u", 0.0, 1.0, [a]), row(6, "short", 0.1, 1.0, ["abc"])]
    out = guarded(spark, set_guards.reuse, rows, "t")
    # 1 claims b; 0 claims a and then meets b; 2 meets a; 3 claims c and then meets a; 4 meets c.
    assert {k for k, r in out.items() if r.marks_awarded == 0} == {0, 2, 3, 4, 5}


def greedy(items, criteria):
    claimed, out = set(), {}
    for pos, sure, options in sorted(items):
        free = [o for o in options if o not in claimed]
        out[pos] = options[0] if sure or not free else free[0]
        claimed.add(out[pos])
    return out


def test_claims_are_the_sequential_ones(spark):
    start = "The lease liability is measured at "
    texts = ["present value", "present value of payments", "present value of payments due", "cost", "cost less payments"]
    rubric = [("m", k, f"C{k}", start + t, 1.0, "") for k, t in enumerate(texts)]
    rng = random.Random(2)
    rows, want = [], {}
    for s in range(25):
        items = []
        for pos in range(rng.randint(1, 7)):
            kind = rng.choice(["prefix", "id", "exact", "long"])
            k = rng.randrange(5)
            said = {"prefix": start + "present value"[: rng.choice([0, 7])], "id": "no such text", "exact": start + texts[k], "long": start + texts[k] + " as I said"}[kind]
            rows.append((f"s{s}", pos, "m", f"c{k}" if kind == "id" else None, said))
            norm = lambda t: " ".join(t.split())
            item = norm(said).lower()
            every = [norm(start + t).lower() for t in texts]
            if kind == "id":
                items.append((pos, True, [k]))
            elif item in every:
                items.append((pos, True, [every.index(item)]))
            else:
                options = sorted((abs(len(c) - len(item)), i) for i, c in enumerate(every) if c.startswith(item) or item.startswith(c))
                if options:
                    items.append((pos, False, [i for _, i in options]))
        want |= {(f"s{s}", pos): c for pos, c in greedy(items, rubric).items()}
    judged = spark.createDataFrame(rows, "submission_id string, item_pos int, model_answer_id string, criterion_id string, criterion string")
    criteria = spark.createDataFrame(rubric, "model_answer_id string, pos int, criterion_id string, description string, marks double, category string")
    got = {(r.submission_id, r.item_pos): r.position for r in resolve.resolve(judged, criteria).collect()}
    assert got == want
    two = spark.createDataFrame([("s", 0, "m", None, start), ("s", 1, "m", None, start)], judged.schema)
    assert sorted(r.position for r in resolve.resolve(two, criteria).collect()) == [0, 3]


def test_best_sentences_take_phrases_and_need_support(spark):
    scripts = spark.createDataFrame([("s", "Goodwill rose. The net assets were valued at fair value. Nothing else."), ("t", None)], "submission_id string, text string")
    criteria = [("s", 0, ["net assets", "fair value"], ""), ("s", 1, ["impairment", "cash", "tax"], ""), ("s", 2, [], "valued assets of goodwill"), ("s", 3, [], "a b c"), ("t", 0, ["net assets"], "")]
    out = holistic.best_sentences(scripts, spark.createDataFrame(criteria, "submission_id string, criterion_pos int, keywords array<string>, description string")).collect()
    assert {(r.submission_id, r.criterion_pos): (r.sentence_pos, round(r.score, 2)) for r in out} == {("s", 0): (1, 1.0), ("s", 2): (1, 0.67)}


def plain_audit(rows):
    """One pass in rubric order with all uses in one state."""
    out, sentence, leaf, section, words = {}, {}, {}, {}, {}
    for r in sorted(rows, key=lambda r: r["criterion_pos"]):
        n = 0
        if r["score"] >= (0.34 if r["existing"] else 0.55) and (r["section_cap"] is None or r["section_marks"] < 0.75 * r["section_cap"]):
            lacks = max(round(r["marks"] * 2) - r["existing"], 0)
            for a in r["anchors"]:
                used = words.setdefault(r["sentence_pos"], set())
                full = sentence.get(r["sentence_pos"], 0) >= 4 or leaf.get(r["leaf"], 0) >= math.floor(r["leaf_max"] * 2) - r["leaf_ticks"]
                if r["section_cap"] is not None:
                    full = full or section.get(r["section"], 0) >= math.ceil((r["section_cap"] - r["section_marks"]) * 2)
                if n >= lacks or full:
                    break
                if used & set(a):
                    continue
                n += 1
                used |= set(a)
                for d, k in ((sentence, "sentence_pos"), (leaf, "leaf"), (section, "section")):
                    d[r[k]] = d.get(r[k], 0) + 1
        out[r["criterion_pos"]] = n
    return out


def test_audit_is_one_pass(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for s in range(40):
        own = []
        for pos in range(rng.randint(1, 9)):
            k = rng.randrange(2)
            own.append({
                "section": f"S{k}", "section_cap": (None, 2.0)[k], "section_marks": 0.5, "leaf": f"L{rng.randrange(3)}", "leaf_max": 1.5, "leaf_ticks": 1, "criterion_pos": pos, "marks": rng.choice([0.5, 1.0, 2.0]),
                "existing": rng.randrange(2), "score": rng.choice([0.3, 0.4, 0.6, 1.0]), "sentence_pos": rng.randrange(2), "anchors": [[rng.choice("abcdefghij") for _ in range(2)] for _ in range(rng.randint(0, 5))],
            })
        want |= {(f"s{s}", p): n for p, n in plain_audit(own).items()}
        rows += [(f"s{s}", *r.values()) for r in own]
    kind = "submission_id string, section string, section_cap double, section_marks double, leaf string, leaf_max double, leaf_ticks int, criterion_pos int, marks double, existing int, score double, sentence_pos int, anchors array<array<string>>"
    got = {(r.submission_id, r.criterion_pos): r.added for r in holistic.coverage_audit(spark.createDataFrame(rows, kind)).collect()}
    assert got == want and sum(got.values()) > 20


@pytest.mark.parametrize("sentence,words,first", [("one two three", ["three"], None), ("The group has control over the entity today", ["control"], ["the", "group", "has", "control", "over"])])
def test_anchors(spark, sentence, words, first):
    out = spark.createDataFrame([(sentence, words)], "s string, k array<string>").select(holistic.anchors(F.col("s"), F.col("k"))).head()[0]
    assert (out[0] if out else None) == first


def test_the_view_is_spread_by_its_rows(spark, monkeypatch, tmp_path):
    from gradeloom.plans import marking_view

    spark.range(100).selectExpr("id l_orderkey", "id l_partkey", "id l_suppkey", "1 l_linenumber", "1.0D l_quantity", "1.0D l_extendedprice", "0.0D l_discount", "0.0D l_tax", "'R' l_returnflag", "'O' l_linestatus", "date'2020-01-01' l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(marking_view, "TASK_ROWS", 10)
    assert marking_view.judged(spark, str(tmp_path)).rdd.getNumPartitions() == 11


def test_resolving_reads_each_table_once(spark):
    """j01_resolve read judged rows and criteria some forty times, as each tier was worked out for itself and joined back."""
    judged = spark.createDataFrame([("s", i, "m", None, "Profit of the year is shown in full") for i in range(3)], "submission_id string, item_pos int, model_answer_id string, criterion_id string, criterion string")
    criteria = spark.createDataFrame([("m", i, f"A{i}", "Profit of the year is shown in " + "full and " * i, 1.0, "") for i in range(3)], "model_answer_id string, pos int, criterion_id string, description string, marks double, category string")
    out = resolve.resolve(judged, criteria)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2
    assert {(r.item_pos, r.position) for r in out.collect()} == {(0, 1), (1, 0), (2, 2)}


def test_sections_look_at_evidence_once(spark):
    """keys of the evidence were made again for every line of the script."""
    from gradeloom.operators import set_guards

    rows = spark.createDataFrame([("--- A ---\nNet assets 5000\n--- B ---\nprofit for the year", ["Net assets, 5000"]), ("--- A ---\nx", [])], "text string, evidence array<string>")
    out = set_guards.locate(rows)
    assert "exists(filter(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.section for r in out.collect()] == [1, None]


def test_words_are_scored_once(spark):
    """a word was scored in each run of five that it is in."""
    from gradeloom.functions import anchors

    df = spark.createDataFrame([("the total of Sales was 1,250 in March and April it fell",)], "t string").select(anchors.telling_chunk(F.col("t")).alias("c"))
    assert "regexp_replace(array_join(" not in df._jdf.queryExecution().analyzed().toString()
    assert df.first().c == "of Sales was 1,250 in March"


def test_focus_score_counts_words_by_their_start(spark):
    """words of the head that share their first five letters with one of the tokens."""
    df = spark.createDataFrame([(["goodwill", "impaired", "loan"], "Goodwill impairment charge"), ([], "Goodwill")], "tokens array<string>, head string")
    assert [r.s for r in df.select(C.focus_score(F.col("tokens"), F.col("head")).alias("s")).collect()] == [pytest.approx(2 / 3), 0.0]


def test_focus_names_the_rival(spark):
    """a row whose judge speaks of a sibling is told which one."""
    rows = [("s", "A", 0, "Goodwill on acquisition", "goodwill acquisition"), ("s", "A", 1, "Depreciation of the building", "goodwill acquired"), ("s", "A", 2, "Cash", "cash")]
    df = spark.createDataFrame(rows, "submission_id string, group string, item_pos int, criterion string, criterion_focus string")
    assert {r.item_pos: r.focus_rival for r in set_guards.focus(df).collect()} == {0: None, 1: 0, 2: None}


def test_no_name_is_defined_twice():
    """a function that a later one of its module replaces."""
    for path in (Path(__file__).parent.parent / "gradeloom").rglob("*.py"):
        names = [x.name for x in ast.parse(path.read_text()).body if isinstance(x, (ast.FunctionDef, ast.ClassDef))]
        assert sorted(names) == sorted(set(names)), path
