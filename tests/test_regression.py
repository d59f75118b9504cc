"""Fits against least squares with explicit indicator columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthpanel.operators import regression
from hearthpanel.plans.jobs import wealth_fits


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(3)
    out = []
    for hid in range(60):
        effect, education = rng.normal(0, 40), float(rng.integers(8, 18))
        for year in (2002, 2007, 2012, 2017)[: int(rng.integers(1, 5))]:
            income, age = float(rng.uniform(10, 90)), float(rng.integers(20, 80))
            wealth = 5 + 3 * income + 2 * age + 0.05 * income**2 + effect + 7 * (year - 2002) + education + rng.normal(0, 5)
            out.append((hid, year, income, age, education, float(wealth)))
    return out


@pytest.fixture(scope="module")
def df(spark, panel):
    extra = [(999, 2007, None, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(panel + extra, "hid long, year int, income double, age double, education double, GrossWealth double")


def lstsq(panel, columns):
    a = np.array(panel, dtype=float)
    hid, year, income, age, education, y = a.T
    parts = {"income": income, "age": age, "income^2": income**2, "age^2": age**2, "education": education}
    x = [parts[c] for c in columns["x"]]
    for name, values in (("year", year), ("hid", hid)):
        if name in columns.get("fe", []):
            x += [(values == v).astype(float) for v in np.unique(values)]
    if not columns.get("fe"):
        x.append(np.ones(len(y)))
    design = np.column_stack(x)
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    return dict(zip(columns["x"], beta)), design @ beta, design, y


SPECS = [
    {"x": ["income", "age"]},
    {"x": ["income", "age", "income^2", "age^2"]},
    {"x": ["income", "age", "education", "income^2", "age^2"]},
    {"x": ["income", "age", "education", "income^2", "age^2"], "fe": ["year"]},
    {"x": ["income", "age", "income^2", "age^2"], "fe": ["year", "hid"]},
]


def test_five_specifications(df, panel):
    fits = wealth_fits(df)
    fitted = regression.ols_fitted(df, fits).orderBy("hid", "year").filter("hid < 999").collect()
    for number, (fit, spec) in enumerate(zip(fits, SPECS), 1):
        beta, values, *_ = lstsq(panel, spec)
        for name, b in beta.items():
            assert fit.coef[name] == pytest.approx(b, rel=1e-6, abs=1e-8), (number, name)
        assert np.allclose([r[f"Model{number}"] for r in fitted], values, rtol=1e-7), number
    assert fits[4].dropped == ("education",)


def test_standard_errors(df, panel):
    fit = regression.ols_linear(df, "GrossWealth", ["income", "age"])
    _, values, design, y = lstsq(panel, SPECS[0])
    variance = ((y - values) ** 2).sum() / (len(y) - 3)
    se = np.sqrt(np.diag(variance * np.linalg.inv(design.T @ design)))
    assert [fit.se["income"], fit.se["age"], fit.se["(Intercept)"]] == pytest.approx(list(se), rel=1e-8)
    assert fit.n == len(panel)


def test_collinear_regressor_is_dropped(df):
    fit = regression.ols_linear(df.withColumn("twice", df.income * 2), "GrossWealth", ["income", "twice", "age"])
    assert fit.dropped == ("twice",) and set(fit.coef) == {"(Intercept)", "income", "age"}


def test_no_rows(df):
    with pytest.raises(ValueError):
        regression.ols_linear(df.limit(0), "GrossWealth", ["income"])


def test_any_number_of_levels(df):
    """The effects may be given either way round, however many levels the first has."""
    few, many = (regression.ols_two_way_fe(df, "GrossWealth", ["income"], *fe) for fe in (("year", "hid"), ("hid", "year")))
    assert many.coef["income"] == pytest.approx(few.coef["income"], rel=1e-6)
    assert many.effects.count() == 60


@pytest.mark.parametrize("fe", [("year", "hid"), ("hid", "year")])
def test_iterated_effects(df, panel, monkeypatch, fe):
    """Conjugate gradients give what the dense system gives, and the same number of effects."""
    df, panel = df.filter("hid < 12 or hid = 999"), [r for r in panel if r[0] < 12]
    direct = regression.ols_two_way_fe(df, "GrossWealth", ["income", "age"], *fe, ["income"])
    monkeypatch.setattr(regression, "DENSE_LEVELS", 0)
    steps = regression.ols_two_way_fe(df, "GrossWealth", ["income", "age"], *fe, ["income"])
    assert steps.coef == pytest.approx(direct.coef, rel=1e-9) and steps.se == pytest.approx(direct.se, rel=1e-9)
    beta, values, *_ = lstsq(panel, {"x": ["income", "age", "income^2"], "fe": ["year", "hid"]})
    assert steps.coef == pytest.approx(beta, rel=1e-6)
    fitted = regression.ols_fitted(df, [steps]).filter("hid < 999").orderBy("hid", "year").collect()
    assert np.allclose([r.Model1 for r in fitted], values, rtol=1e-7)


def test_effects_in_several_connected_sets(spark, monkeypatch):
    """Levels and homes in three sets that share nothing: three effects less can be told apart."""
    rng = np.random.default_rng(7)
    rows = [
        (300 * part + int(rng.integers(0, 4)), 300 * part + int(rng.integers(0, 5)), float(rng.normal()), float(rng.normal()))
        for part in range(3) for _ in range(15)
    ]
    rows = [(a, b, x, 2 * x + a % 7 + b % 5 + e) for a, b, x, e in rows]
    df = spark.createDataFrame(rows, "a long, b long, x double, y double")
    direct = regression.ols_two_way_fe(df, "y", ["x"], "a", "b")
    monkeypatch.setattr(regression, "DENSE_LEVELS", 0)
    steps = regression.ols_two_way_fe(df, "y", ["x"], "a", "b")
    assert steps.coef == pytest.approx(direct.coef, rel=1e-9) and steps.se == pytest.approx(direct.se, rel=1e-9)
    data = np.array(rows)
    marks = [(data[:, i] == v).astype(float) for i in (0, 1) for v in np.unique(data[:, i])]
    design = np.column_stack([data[:, 2], *marks])
    rest = data[:, 3] - design @ np.linalg.lstsq(design, data[:, 3], rcond=None)[0]
    bread = np.linalg.pinv(design.T @ design)[0, 0]
    variance = rest @ rest / (len(rows) - np.linalg.matrix_rank(design))
    assert direct.se["x"] == pytest.approx(np.sqrt(variance * bread), rel=1e-6)


def sandwich(panel, spec, group):
    """Clustered errors with explicit indicator columns."""
    _, values, design, y = lstsq(panel, spec)
    k, n = len(spec["x"]), len(y)
    ids = np.array(panel)[:, ["hid", "year"].index(group)]
    bread = np.linalg.pinv(design.T @ design)
    rest = (y - values)[:, None] * design
    scores = np.array([rest[ids == g].sum(axis=0) for g in np.unique(ids)])
    levels = {"year": 4, "hid": len(np.unique(np.array(panel)[:, 0]))}
    effects = spec.get("fe", [])
    counted = k + (np.linalg.matrix_rank(design) - k if effects else 1)
    if group in effects:
        counted -= levels[group] - 1
    g = len(scores)
    covariance = bread @ scores.T @ scores @ bread * g / (g - 1) * (n - 1) / (n - counted)
    return np.sqrt(np.diag(covariance))


@pytest.mark.parametrize("number,group", [(0, "hid"), (2, "year"), (3, "year"), (3, "hid"), (4, "year"), (4, "hid")])
def test_clustered_errors(df, panel, number, group):
    spec = SPECS[number]
    plain = [c for c in spec["x"] if "^" not in c]
    squares = [c[:-2] for c in spec["x"] if "^" in c]
    fit = regression.ols(df, "GrossWealth", plain, squares, spec.get("fe"), cluster=group)
    want = sandwich(panel, spec, group)
    assert [fit.se[c] for c in spec["x"]] == pytest.approx(list(want[: len(spec["x"])]), rel=1e-5)
    if not spec.get("fe"):
        assert fit.se["(Intercept)"] == pytest.approx(want[-1], rel=1e-5)


def test_same_bits_however_partitioned(spark, df):
    """Coefficients, errors and fitted values of all specifications, over random partitionings."""
    wide = df.withColumn("income", F.col("income") * 1e7).withColumn("age", F.col("age") * 1e-9)
    results = set()
    for seed in range(3):
        shuffled = wide.orderBy(F.rand(seed)).repartition(1 + 5 * seed)
        fits = [
            regression.ols_linear(shuffled, "GrossWealth", ["income", "age"]),
            regression.ols_fixed_effect(shuffled, "GrossWealth", ["income", "age"], "hid", ["age"], "year"),
            regression.ols_two_way_fe(shuffled, "GrossWealth", ["income", "age"], "year", "hid"),
        ]
        fitted = regression.ols_fitted(shuffled, fits[:2]).collect()
        told = sorted((r.hid, r.year, str(r.Model1), str(r.Model2)) for r in fitted)
        results.add(str(([(sorted(f.coef.items()), sorted(f.se.items())) for f in fits], told)))
    assert len(results) == 1
