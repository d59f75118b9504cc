"""Series, finance formulas and adoption on hand-made households."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthpanel.functions.finance import geometric_sum
from hearthpanel.operators import households as h
from hearthpanel.operators import series


def frame(spark, rows, **defaults):
    """Households from dicts over common defaults."""
    full = [{"hid": i, **defaults, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame(full)


def by_hid(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("hid").collect()]


def test_recursive_least_squares(spark):
    rng = np.random.default_rng(1)
    data, expected = [], {}
    for key in ("a", "b"):
        gain, p = 0.05 if key == "a" else 0.2, np.cumsum(rng.normal(0.1, 1, 40)) + 20
        data += [(key, t, float(v), gain) for t, v in enumerate(p)]
        matrix, pars = np.array([[1.0, 0.1], [0.1, 0.5]]), np.array([0.2, 0.3])
        for t in range(2, len(p)):
            z = np.array([1.0, p[t - 1] - p[t - 2]])
            matrix = matrix + gain * (np.outer(z, z) - matrix)
            pars = pars + gain * np.linalg.solve(matrix, z * (p[t] - p[t - 1] - pars @ z))
        expected[key] = (*matrix.ravel(), *pars)
    df = spark.createDataFrame(data, "k string, t int, v double, gain double").repartition(5)
    for r in series.rls_fold(df, ["k"], "t", "v", "gain", (0.2, 0.3), (1.0, 0.1, 0.1, 0.5)).collect():
        assert (r.r11, r.r12, r.r21, r.r22, r.n1, r.n2) == pytest.approx(expected[r.k], rel=1e-9)


def test_learning_needs_a_positive_definite_start(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 0.1)], "k string, t int, v double, gain double")
    with pytest.raises(ValueError):
        series.rls_fold(df, ["k"], "t", "v", "gain", (0.0, 0.0), (0.0, 0.0, 0.0, 0.0))


def test_ar1_recovers_and_projects(spark):
    p = [10.0, 11.0]
    for _ in range(10):
        p.append(p[-1] + 0.5 + 0.4 * (p[-1] - p[-2]))
    df = spark.createDataFrame([("s", t, v) for t, v in enumerate(p[:9])], "k string, t int, v double")
    fit = series.ar1_fit(df, ["k"], "t", "v")
    r = series.ar1_project(fit, 3).first()
    assert (r.intercept, r.slope, r.sd) == pytest.approx((0.5, 0.4, 0.0), abs=1e-6)
    assert r.path == pytest.approx(p[9:12])
    calm = series.ar1_simulate(fit, ["k"], 3, seed=1, sd=F.lit(0.0)).first()
    assert calm.path == pytest.approx(r.path)


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "hid")
    one = by_hid(h.normal_draw(h.hash_uniform(df.coalesce(1), "hid", 3), "hid", 3), "u", "z")
    many = by_hid(h.normal_draw(h.hash_uniform(df.repartition(17), "hid", 3), "hid", 3), "u", "z")
    assert one == many
    u, z = np.array(one).T
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.05 and abs(z.std() - 1) < 0.1


def test_four_revenue_cases(spark):
    df = frame(spark, [
        {"powercons": 5000.0, "tariff": 0.1}, {"powercons": 5000.0, "tariff": 0.4},
        {"powercons": 1000.0, "tariff": 0.1}, {"powercons": 1000.0, "tariff": 0.4},
        {"powercons": 1000.0, "tariff": 0.4, "pv": 0},
    ], pv=1)
    got = [v for (v,) in by_hid(h.panel_revenue(df, 0.3, 4500.0, 0.3), "panelrevenue")]
    assert got == pytest.approx([1350 * 0.3 + 3150 * 0.1, 1800, 1000 * 0.3 + 3500 * 0.1, 1800, 0])


DEBTOR = dict(debt=1000.0, loanrate=0.1, debtservice=300.0, panelage=15, profit=0.0, liquidity=0.0)


def test_debt_payment_cases(spark):
    df = frame(spark, [
        {"liquidity": 500.0}, {"liquidity": 200.0}, {"liquidity": 40.0},
        {"liquidity": 5000.0, "debt": 200.0, "loanrate": 0.0}, {"debt": 0.0, "loanrate": 0.0, "debtservice": 0.0, "liquidity": 7.0},
    ], **DEBTOR)
    out = h.debt_service(df, 20)
    got = by_hid(out, "debt", "liquidity", "profit", "interest_paid")
    # In full; interest and part of the principal; part of the interest; last payment; no loan.
    assert got == [(800.0, 200.0, -100.0, 100.0), (900.0, 0.0, -100.0, 100.0), (1060.0, 0.0, -40.0, 40.0),
                   (0.0, 4800.0, 0.0, 0.0), (0.0, 7.0, 0.0, 0.0)]
    service = [s for (s,) in by_hid(out, "debtservice")]
    factor = 0.1 * 1.1**5 / (1.1**5 - 1)
    assert service == pytest.approx([300.0, 900 * factor, 1060 * factor, 0.0, 0.0])
    for before, after in zip(by_hid(df, "debt", "liquidity"), by_hid(out, "debt", "liquidity", "interest_paid", "payment")):
        principal = after[3] - after[2]
        assert before[1] - after[1] == pytest.approx(after[3])
        assert after[1] >= 0 and principal >= 0


def test_liquidity_never_negative(spark):
    df = frame(spark, [{"consumption": 50.0}, {"consumption": 500.0}], liquidity=10.0, income=100.0, powercost=20.0)
    out = h.liquidity_update(df)
    assert by_hid(out, "liquidity", "liquidity_before") == [(40.0, 10.0), (0.0, 10.0)]


def test_ageing(spark):
    df = frame(spark, [{"panelage": 20}, {"panelage": 19}, {"panelage": 5, "pv": 0}], pv=1, tariff=0.2)
    assert by_hid(h.panel_ageing(df, 20), "pv", "tariff", "panelage") == [(0, 0.0, 0), (1, 0.2, 20), (0, 0.2, 5)]


def test_schedule_repays_the_loan(spark):
    df = frame(spark, [{"loan": 9000.0}, {"loan": 100.0}, {"loan": 0.0}], discount=0.03)
    offers = h.loan_offer(df, 10000.0, 0.02, 0.02, 1.0, 20)
    rows = h.amortisation_schedule(offers, 20)
    totals = rows.groupBy("hid").agg(F.sum("principal").alias("paid"), F.min_by("balance", -F.col("t")).alias("rest"))
    for (paid, rest), loan in zip(by_hid(totals, "paid", "rest"), (9000.0, 100.0, 0.0)):
        assert paid == pytest.approx(loan, abs=1e-6) and rest == pytest.approx(0, abs=1e-6)
    summed = rows.join(df.select("hid", "discount"), "hid").groupBy("hid").agg(
        F.sum(F.col("interest") / F.pow(1 + F.col("discount"), F.col("t"))).alias("c"))
    assert [c for (c,) in by_hid(h.discounted_loan_cost(offers, 20), "loancost")] == pytest.approx([c for (c,) in by_hid(summed, "c")])


def test_geometric_sum_near_one(spark):
    ratios = [1.0, 1 + 1e-9, 1 - 1e-6, 1.05, 0.9]
    df = spark.createDataFrame([(q,) for q in ratios], "q double").select("q", geometric_sum(F.col("q"), 20).alias("s"))
    for q, s in df.collect():
        assert s == pytest.approx(sum(q**i for i in range(20)), rel=1e-7)


def test_rationing_exemptions(spark):
    df = frame(spark, [{}, {"loan": 0.0}, {"feasible": 0}, {"pv": 1}, {"income": 1e6}, {"income": 1e6, "debt": 5000.0}],
               loan=8000.0, debt=0.0, instalment=700.0, income=20000.0, feasible=1, pv=0)
    assert [r for (r,) in by_hid(h.credit_rationing(df, 9000.0, 1.0, 0.02), "rationed")] == [1, 0, 0, 0, 0, 1]


def test_utility_rules(spark):
    df = frame(spark, [{}, {"adopted": 1, "profit": 5.0}, {"adopted": 1, "profit": -5.0}, {"rationed": 1}, {"feasible": 0}, {"pv": 1}],
               revenue=12000.0, loancost=500.0, influence=100.0, peer_share=0.25, attitude=2, adopted=0, profit=0.0, pv=0,
               rationed=0, feasible=1)
    got = [u for (u,) in by_hid(h.adoption_utility(df, 10000.0, 10.0), "utility")]
    assert got == [1500 - 50 + 20, 1500, 1470, 0, 0, 0]


def test_adoption_blends_loans(spark):
    df = frame(spark, [{}, {"loan": 0.0}, {"utility": -1.0, "adopted": 1, "profit": -3.0}],
               utility=10.0, loan=3000.0, offerrate=0.06, debt=1000.0, loanrate=0.02, debtservice=80.0, liquidity=6000.0,
               tariff=0.0, pv=0, adopted=0, profit=1.0)
    got = by_hid(h.adoption_update(df, 10000.0, 0.12, 20, 0.1), "pv", "liquidity", "debt", "loanrate", "profit", "tariff")
    assert got == [(1, 0.0, 4000.0, pytest.approx(0.05), -9000.0, 0.12), (1, -3000.0, 1000.0, 0.02, -9000.0, 0.12),
                   (0, 6000.0, 1000.0, 0.02, 0.0, 0.0)]


def test_policy_starts_in_its_year(spark):
    df = spark.createDataFrame(
        [("s", 1, 0, 0, 1, 0.2, 0.5, 0.1, 0.02, 2020, 2021)],
        "scenario string, subsidy1 int, subsidy2 int, credit1 int, credit2 int, s1 double, s2 double, cp1 double, cp2 double, "
        "subsidy_start int, credit_start int",
    )
    got = [tuple(r) for r in h.policy_schedule(df, 2019, 2021).orderBy("year").collect()]
    assert got == [("s", 2019, 0, 0, 0, 0), ("s", 2020, 0.2, 0, 0, 0), ("s", 2021, 0.2, 0, 0, 0.02)]
