from pyspark.sql import functions as F

from gradeloom.functions import arithmetic
from gradeloom.functions import numbers as N
from gradeloom.functions import text as X

L = F.lit


def values(spark, *columns):
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).head()
    return [row[i] for i in range(len(columns))]


def test_pages_and_titles(spark):
    assert values(spark, X.page_list(L("1-3, 5,x"))) == [[1, 2, 3, 5]]
    assert values(spark, *(X.title_number(L(t)) for t in ("3. Bridge repairs", "Question 8: x", "Q.8 Pensions", "Pensions"))) == ["3", "8", "8", ""]


def test_marks(spark):
    assert values(spark, *(X.marks_value(L(t)) for t in ("1/4", "5 1/4", "1/4 mk each max 2", "17", "see over"))) == [0.25, 5.25, 0.25, 17.0, None]
    assert values(spark, *(X.marks_text(L(v)) for v in (2.0, 0.25, 1.5))) == ["2", "0.25", "1.5"]
    assert values(spark, X.quarter(L(0.625)), X.quarter(L(0.375)), X.half_up(L(7.25)), X.half_up(L(7.24))) == [0.5, 0.5, 7.5, 7.0]


def test_values(spark):
    found = values(spark, X.value_variants(L(46250)))[0]
    assert {"46250", "46,250", "46,250,000", "46,250,000.00", "46.25", "46.25m"} <= set(found)
    cases = [(4700, "in 814700", False), (4700, "4,700.00", True), (8000, "£8.375m", False), (8000, "£8m", True)]
    assert values(spark, *(N.value_in_text(L(v), L(t)) for v, t, _ in cases)) == [w for *_, w in cases]
    assert values(spark, *(X.number_token(L(t)) for t in ("416,000", "5.4m", "920k", "75p", "40%", "3/12", "word"))) == [416000, 5.4e6, 920000, 0.75, 0.4, 0.25, None]
    assert values(spark, *(X.is_deduction(L(v), L(t)) for v, t in ((6480, "(6,480)"), (6480, "Less 6,480"), (700000, "-700,000")))) == [True, True, False]


def test_symbols(spark):
    a, b, c, d, e = values(spark, *(X.symbol_norm(L(t)) for t in ("(5,678)", "-5,678", "23 million", "23m", "7 350 000")))
    assert a == b and c == d and e == "7350000"


def test_pieces(spark):
    found = values(spark, X.header_candidates(L("Due 9 May Y2")))[0]
    assert found[0] == "Due 9 May Y2" and "9 May Y2" in found and not {"9", "Y2"} & set(found)
    assert values(spark, X.sentences(L("A b. C d!\nE"))) == [["A b.", "C d!", "E"]]
    assert values(spark, X.row_variants(L("Cash | 1 | 20"))) == [["Cash 20", "Cash 1 20", "Cash | 1 | 20"]]
    assert tuple(values(spark, X.comment_parts(L("[4.1] foo → bar. baz.")))[0]) == ("foo", "bar. baz.")
    assert values(spark, X.isolate_json(L('x ```json {"a":[1]} ``` y'))) == ['{"a":[1]}']
    assert values(spark, *(X.error_class(L(t)) for t in ("429 quota", "rate limit", "SSL fault", "mongo down", "odd"))) == ["quota", "rate", "network", "database", "unexpected"]


def test_criteria(spark):
    good = ["Dr NCI", "Goodwill at acquisition calculated", "Share price 12", "goodwill"]
    bad = ["1/4 mk each max 2", "5 1/4", "tutorial note", "(7) Harbour crane lease", "Prepare statement", "", None]
    assert values(spark, *(X.is_valid_criterion(L(t)) for t in good)) == [True] * 4
    assert values(spark, *(X.is_valid_criterion(L(t).cast("string")) for t in bad)) == [False] * 7


def test_nulls_and_empty_texts(spark):
    functions = (X.evidence_norm, X.clean_text, X.symbol_norm, X.line_norm, X.tokens, X.sentences, X.numbers, X.salient_numbers, X.digit_share, X.candidate_fragments, X.evidence_list, X.row_variants, X.html_text, X.isolate_json, X.number_token, X.marks_value, X.page_list, X.title_number)
    for value in (None, "", " \n "):
        values(spark, *(f(L(value).cast("string")) for f in functions))


def test_arithmetic(spark):
    made = arithmetic.evaluate("=46000000+(8400000*5/12)")
    assert {49500000, 3500000, 42000000} <= set(made) and made[-1] == 49500000
    assert arithmetic.evaluate("2 +") == [] and arithmetic.evaluate("1/0") == [] and arithmetic.evaluate("abc") == [] and arithmetic.evaluate(None) == []
    assert arithmetic.evaluate("40% x 5.5m")[-1] == 2.2e6
    assert arithmetic.evaluate("-2+5")[-1] == 3 and arithmetic.evaluate(")(") == []
    assert values(spark, arithmetic.bracket_value(L("Price of the stake (416,000 x GBP25)")), arithmetic.bracket_value(L("Nominal value (600,000 x 75p)")), arithmetic.bracket_value(L("none"))) == [10.4e6, 450e3, None]
