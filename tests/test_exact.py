"""Sums in any order against exact fractions."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from hearthpanel.operators import exact


def test_sums_are_exact(spark):
    rng = random.Random(1)
    values = [rng.uniform(-1, 1) * 10 ** rng.randrange(0, 12) for _ in range(3000)] + [0.1] * 10 + [1e16, -1e16, 0.0, None]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "k int, v double").repartition(7)
    n, box = exact.extremes(df, ["v"])
    top = exact.tops(box)["v"]
    assert n == len(values) and box["v"] == (-1e16, 1e16)
    row = df.agg(*exact.sum_columns("s", F.col("v"), top)).first().asDict()
    want = sum(Fraction(v) for v in values if v is not None)
    assert abs(exact.total(row, "s", top) - want) <= len(values) * Fraction(2) ** (top - 96)
    assert float(exact.total(row, "s", top)) == float(want)
    groups = {r.k: r for r in exact.group_sums(df, ["k"], {"s": (F.col("v"), top)}).collect()}
    for k in range(3):
        own = [Fraction(v) for v in values[k::3] if v is not None]
        assert groups[k].s == pytest.approx(float(sum(own)), rel=1e-15) and groups[k].n == len(values[k::3])


@pytest.mark.parametrize("scale", [1e-300, 1e-12, 1e290])
def test_any_magnitude(spark, scale):
    values = [scale * v for v in (1.0, 0.1, -0.7, 3.3e-5)] * 50
    df = spark.createDataFrame([(v,) for v in values], "v double")
    top = exact.tops(exact.extremes(df, ["v"])[1])["v"]
    row = df.agg(*exact.sum_columns("s", F.col("v"), top)).first().asDict()
    assert float(exact.total(row, "s", top)) == pytest.approx(float(sum(map(Fraction, values))), rel=1e-12)


def test_no_rows_and_infinite_values(spark):
    df = spark.createDataFrame([], "v double")
    assert exact.extremes(df, ["v"]) == (0, {"v": (0.0, 0.0)})
    row = df.agg(*exact.sum_columns("s", F.col("v"), 0)).first().asDict()
    assert exact.total(row, "s", 0) == 0
    with pytest.raises(ValueError):
        exact.exponent(float("inf"))
