"""The number index against the pattern of each spelling, and lines looked up by it."""

import random

from pyspark.sql import functions as F

from gradeloom.functions import criteria as C
from gradeloom.functions import numbers as N
from gradeloom.functions import text as X

VALUES = [0, 1, 5, 7, 12, 25, 99, 125, 250, 1000, 2500, 12_000, 250_000, 1_234_567, 9_999_999, 10_000_000, 25_000_000]
FORMS = ["{v}", "{v:,}", "{v:,}.00", "{v}.00", "{k:g}", "{k:g}m", "{v}m", "{v} million", "{v}mn", "{v}M", "{v}metres", "{v}mn5", "{v}.", "{v},", "{v},{v}", ".{v}", "{v}m5", "{v}_", "{v} m", "{v}mé", "1{v}", "{v}1", "{v} Mn."]


def test_same_as_patterns(spark):
    rng = random.Random(3)

    def number():
        v = rng.choice(VALUES)
        return rng.choice(FORMS).format(v=v, k=v / 1000)

    rows = [(float(rng.choice([*VALUES, 0.5, 1.25, 3000])) if rng.random() > 0.02 else None, rng.choice(["", " ", " x ", "£", "(", "-", ","]).join(number() for _ in range(rng.randint(0, 4))) if rng.random() > 0.02 else None) for _ in range(8000)]
    df = spark.createDataFrame(rows, "v double, t string")
    by_pattern = F.exists(X.value_variants(F.col("v")), lambda v: X.variant_in_text(v, F.col("t")))
    both = df.select(by_pattern.alias("a"), N.value_in_text(F.col("v"), F.col("t")).alias("b"))
    assert both.filter("not (a <=> b)").count() == 0 and both.filter("a").count() > 400


def test_points_are_points(spark):
    df = spark.createDataFrame([(2500.0, "it is 2.5 here"), (2500.0, "it is 2x5 here"), (2500.0, "2.5m"), (2500.0, "12.5")], "v double, t string")
    assert [r[0] for r in df.select(N.value_in_text(F.col("v"), F.col("t"))).collect()] == [True, False, True, False]
    assert [r[0] for r in df.select(X.is_deduction(F.col("v"), F.concat(F.lit("("), "t", F.lit(")")))).collect()] == [False, False, True, False]
    assert spark.createDataFrame([(2500.0, "(2.5m)")], "v double, t string").select(X.is_deduction(F.col("v"), F.col("t"))).head()[0]


def test_lines_by_the_index(spark):
    text = "Dr Cash 500\nworking 1,500 less 20\n\ntotal of 0.5\nthen 500 again"
    df = spark.createDataFrame([(500.0, text), (20_000.0, text), (20.0, text), (None, text), (500.0, None)], "v double, t string")
    assert [r[0] for r in df.select(C.working_line(F.col("v"), F.col("t"))).collect()] == ["total of 0.5", None, None, None, None]
    index = {(r.key, r.line_no) for r in N.number_index(spark.createDataFrame([("s", text), ("t", None)], "submission_id string, text string")).collect()}
    assert {("500", 0), ("1", 1), ("1,500", 1), ("0.5", 3), ("500", 4)} - index == {("1", 1)} and ("20", 1) not in index


def test_long_runs_stay_small(spark):
    run = "1," * 20_000 + "234"
    keys = spark.createDataFrame([(run,)], "t string").select(N.number_keys(F.col("t"))).head()[0]
    assert len(keys) < 12 and max(map(len, keys)) < 32
