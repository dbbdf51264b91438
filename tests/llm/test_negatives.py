"""Hard negatives against plain Python over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor long, place int, codes binary, rank int"


def plain(rows, every=100):
    """The rows' windows by comparing all pairs."""
    kept = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731  shorter vectors count as filled up
    out = []
    for i, label, v in kept:
        if i is None or i % every:
            continue
        others = sorted(((-dot(v, w), j is None, j or 0, other) for j, other, w in kept if j != i), key=lambda x: x[:3])
        for p, none, j, other in [x for x in others if x[3] == label][:5]:
            found = [x for x in others if x[3] != label and 80 * p >= 100 * x[0] >= 100 * p]
            out += [(i, None if none else j, k + 1, None if x[1] else x[2], -p, -x[0]) for k, x in enumerate(found[:5])]
    return sorted(out, key=repr)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, 0, 0, b"", 1) for i, v, label in rows], SCHEMA)
    out = negatives.mine(df.repartition(3), **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and dict(out.dtypes)["rank"] == "int"
    return sorted(map(tuple, out.collect()), key=repr)


def f32(x):
    import numpy as np

    return float(np.float32(x))


def test_against_all_pairs(spark):
    rng = random.Random(5)
    vector = lambda n: [f32(rng.gauss(0, 0.2)) for _ in range(n)]
    rows = [(k, vector(16), rng.randrange(3)) for k in range(600)]
    rows += [(1000 + k, rows[300][1], k % 2) for k in range(150)]  # one common vector, under both labels
    rows += [(2000 + k, rows[k * 7][1], rows[k * 7][2]) for k in range(10)]  # ties
    rows += [rows[100], rows[100], rows[5], (700, vector(9), 1), (800, [], 2), (None, vector(16), 1), (None, rows[300][1], 0), (-100, vector(21), 1)]
    rows += [(900, None, 1), (901, [None] * 16, 1), (1100, [float("nan")] * 16, 0), (1101, [float("inf")] * 16, 0), (1200, vector(16), None)]
    want = plain(rows)
    assert mined(spark, rows) == want and len(want) > 100


def test_blocks_and_small_tables(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, [f32(rng.gauss(0, 1)) for _ in range(5)], k % 2) for k in range(200)]
    want = plain(rows, 10)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    assert mined(spark, rows, every=10) == want and want
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(0, [1.0], 1), (100, [1.0], 1)]) == []


def test_large_components_do_not_overflow(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [3e38, 1.0], 1), (2, [2e38, -1.0], 2), (3, [1e-3, 1.0], 2)]
    out = mined(spark, rows)
    assert [r[:4] for r in out] == [(0, 1, 1, 2)] and out[0][4] <= 2**62


@pytest.mark.parametrize("spread", [0.0, 0.05, 1.0])
def test_bounds_hold(spread):
    """Whatever the centres are, a true score lies between a row's bounds."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(0, 30, (8, negatives.CODES, negatives.SUB)) * spread
    x = rng.integers(-200, 200, (300, 17))
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(300)), pa.array(["a"] * 300), pa.array(x.tolist(), pa.list_(pa.int64()))], names=["vec_id", "label", "ints"])
    coded = next(negatives._encode(centres)([batch]))
    Row = type("Row", (), {})
    rows = []
    for i in range(40):
        r = Row()
        r.label, r.vec_id, r.anchor, r.ints = "a", i, i, x[i].astype(np.int32).tobytes()
        rows.append(r)
    block = negatives.Block(rows, centres).ready()
    (_, _, _, vectors, codes, left), = negatives._batches([coded], 8)
    low, high = block.bounds(codes, left, 0, 40)
    true = vectors @ x[:40].T
    assert (low <= true).all() and (true <= high).all()


def test_label_column(spark):
    rows = spark.createDataFrame([(0, [1.0], 9), (1, [1.0], 9), (7, [1.0], 8)], "vec_id long, embedding array<double>, label int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert negatives.mine(rows, label).count() == 0  # 0 has label 0, 7 has label 9: no row of the anchor's label
