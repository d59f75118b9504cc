"""Rows that used to stop or falsify whole queries."""

import numpy as np
import pytest

from hearthpanel.operators import households as h
from hearthpanel.operators import joins, panel, reshape, series
from hearthpanel.plans.jobs import job_consumption
from hearthpanel.plans.scoring import under_scenarios


def test_every_scenario_counts(spark):
    df = spark.createDataFrame([(1,), (2,)], "hid int")
    scenarios = spark.createDataFrame([(f"s{i:04d}", i / 7) for i in range(1001)], "scenario string, s1 double")
    out = under_scenarios(df, scenarios)
    assert out.count() == 2002 and out.select("scenario").distinct().count() == 1001
    assert under_scenarios(df, scenarios.limit(0)).count() == 0


def test_repeated_periods_stop(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 9.0), ("a", 1, 5.0, 2.0)], "k string, t int, v double, w double")
    with pytest.raises(Exception, match="more than one row in period 1"):
        panel.period_change(df, ["k"], "t", ["v"]).collect()


def test_repeated_cells_stop(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "x", 2.0)], "id int, var string, value double")
    with pytest.raises(Exception, match="more than one value for x"):
        reshape.long_to_wide(df, ["id"], "var", "value", ["x", "y"]).collect()


def test_repeated_lookups_stop(spark):
    df = spark.createDataFrame([(3,)], "percentile int")
    twice = spark.createDataFrame([(3, 1.0), (3, 2.0)], "percentile int, value double")
    with pytest.raises(ValueError):
        joins.percentile_lookup_join(df, twice)
    with pytest.raises(ValueError):
        joins.year_lookup_earliest_fallback(df, twice.withColumnRenamed("percentile", "year"), "percentile", "v")


def test_text_is_melted(spark, rows):
    df = spark.createDataFrame([(1, "a", 2)], "id int, x string, y int")
    assert rows(reshape.wide_to_long(df, ["id"])) == [(1, "x", "a"), (1, "y", "2")]


def test_constant_series(spark):
    data = [("flat", t, 5.0) for t in range(6)] + [("line", t, 2.0 * t) for t in range(6)] + [("any", t, float(t * t % 7)) for t in range(9)]
    df = spark.createDataFrame(data, "s string, t int, v double")
    got = {r.s: r for r in series.ar1_fit(df, ["s"], "t", "v").collect()}
    assert (got["flat"].intercept, got["flat"].slope, got["flat"].sd) == (0, 0, 0)
    assert (got["line"].intercept, got["line"].slope, got["line"].sd) == (2, 0, 0)
    assert got["any"].slope != 0


def test_full_subsidy_and_no_income(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.0, 0.0, 1, 0), (100.0, 1.0, 0.0, 0.0, 1, 0)], "loan double, house double, debt double, income double, feasible int, pv int")
    offered = h.loan_offer(df, 1000.0, 0.02, 0.01, 1.0, 20, 1.0)
    assert all(r.offerrate is not None for r in offered.collect())
    got = h.credit_rationing(h.loan_offer(df, 1000.0, 0.02, 0.01, 1.0, 20), 1000.0, 1.0, 0.5)
    assert [r.rationed for r in got.orderBy("loan").collect()] == [0, 1]


def brute_rls(values, gains, start, matrix):
    """Matrix and coefficients after every step, period by period; None is a missing period."""
    r, coef = np.array(matrix, float).reshape(2, 2), np.array(start, float)
    out = {}
    for t in range(2, len(values)):
        if None in values[t - 2 : t + 1]:
            continue
        z = np.array([1.0, values[t - 1] - values[t - 2]])
        y = values[t] - values[t - 1]
        new = r + gains[t] * (np.outer(z, z) - r)
        if gains[t] != 1:
            r = new
        coef = coef + gains[t] * np.linalg.solve(r, z * (y - z @ coef))
        out[t] = (*r.ravel(), *coef)
    return out


STATE = ("r11", "r12", "r21", "r22", "n1", "n2")
RLS = ((0.1, 0.2), (2.0, 0.5, 0.5, 1.0))


def many_series():
    rng = np.random.default_rng(3)
    values = {k: list(map(float, np.cumsum(rng.normal(0.1, 1, n)) + 9)) for k, n in (("a", 700), ("b", 7), ("c", 66), ("d", 150), (None, 9))}
    for t in (3, 80, 81, 149):
        values["d"][t] = None
    values["e"], values["f"] = values["c"][:40], [1.0, 2.0]
    gains = {k: [0.05] * 700 for k in values}
    gains["c"] = [1.0] * 700
    gains["e"] = [0.1 + 0.9 * (t % 7 == 0) for t in range(700)]
    return values, gains


def learning_rows(spark):
    values, gains = many_series()
    rows = [(k, t - 5, v, gains[k][t], 1) for k, vs in values.items() for t, v in enumerate(vs) if v is not None]
    return spark.createDataFrame(rows, "s string, t int, v double, g double, n1 int").repartition(6)


def test_states_after_every_period(spark):
    """Long, short and gappy series; gains that are 1, vary or stay; a block is 64 periods."""
    values, gains = many_series()
    got = series.rls_states(learning_rows(spark), ["s"], "t", "v", "g", *RLS).collect()
    by = {(r.s, r.t + 5): tuple(r[c] for c in STATE) for r in got}
    want = {(k, t): state for k, vs in values.items() for t, state in brute_rls(vs, gains[k], *RLS).items()}
    assert by.keys() == want.keys() and len(got) == len(want)
    assert all(by[k] == pytest.approx(want[k], rel=1e-7, abs=1e-9) for k in want)


def test_last_state_of_all_kinds_of_series(spark):
    values, gains = many_series()
    got = {r.s: r for r in series.rls_fold(learning_rows(spark), ["s"], "t", "v", "g", *RLS).collect()}
    assert got.keys() == {k for k in values if k != "f"}
    for k, r in got.items():
        steps = brute_rls(values[k], gains[k], *RLS)
        assert tuple(r[c] for c in STATE) == pytest.approx(steps[max(steps)], rel=1e-7, abs=1e-9), k
        known = [t for t, v in enumerate(values[k]) if v is not None]
        assert (r.n, r.last, r.last_period) == (len(steps), values[k][known[-1]], known[-1] - 5)
    empty = learning_rows(spark).limit(0)
    assert series.rls_states(empty, ["s"], "t", "v", "g", *RLS).count() == 0 == series.rls_fold(empty, ["s"], "t", "v", "g", *RLS).count()


def test_concepts_not_asked_or_without_columns(spark):
    wide = spark.createDataFrame([(1, 12.0, 6.0), (2, 24.0, 8.0)], "hid int, consum1b double, rheat_b double")
    book = spark.createDataFrame([("1", "Food"), ("rheat", "Heating")], "code string, concept string")
    status = spark.createDataFrame([(1, 2010, 10.0, 1), (2, 2010, 20.0, 0)], "hid int, year int, income double, owner int")
    got = {r.hid: r for r in job_consumption(wide, book, status, ["Food", "Heating", "Other"]).collect()}
    assert got[1].Heating is None and got[2].Heating is not None and got[1].Other is None
    with pytest.raises(ValueError):
        job_consumption(wide, book, status, ["Food"])
    with pytest.raises(ValueError):
        job_consumption(wide, book.union(spark.createDataFrame([("1", "Clothes")])), status, ["Food", "Heating", "Clothes"])
