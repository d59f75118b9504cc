"""Household finance, price series and adoption."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.framework import Check
from checks.reshaping import POSITION
from checks.views import (
    BASE_RATE, BETA, CAPACITY, FEASIBLE_PROB, GAIN, INFLUENCE, MARKUP, MAX_AGE, MAX_DTI, MAX_LTV, OBSERVED, OWN_USE,
    PERSISTENCE, PRICE, PRICE_SCALE, SEED, START, cost, households, snapshot, tariff, view,
)
from hearthpanel.operators import households as h
from hearthpanel.operators import series
from hearthpanel.operators.joins import peer_rate_join
from hearthpanel.operators.ranking import position_groups
from hearthpanel.plans.scoring import Market, job_adoption_scoring

COST, TARIFF = cost(START), tariff(START)
HORIZON = 13
RLS_START, RLS_MATRIX = (0.0, 0.1), (1.0, 0.0, 0.0, 0.05)
MARKET = Market(
    START, PRICE, CAPACITY, OWN_USE, MAX_AGE, MAX_LTV, MAX_DTI, MARKUP, FEASIBLE_PROB, BETA, INFLUENCE, SEED
)


def u_sql(key: str, seed: str, lo: float = 0.0, hi: float = 1.0) -> str:
    hexed = f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 8) AS BIGINT)"
    return f"((CAST({hexed} AS DOUBLE) + 0.5::DOUBLE) / 4294967296.0::DOUBLE * {hi - lo}::DOUBLE + {lo}::DOUBLE)"


def z_sql(key: str, seed: str) -> str:
    return f"(sqrt(-2 * ln({u_sql(key, seed + 'a')})) * cos(2 * pi() * {u_sql(key, seed + 'b')}))"


# --- price series -----------------------------------------------------------------------------


def prices(s, d):
    return view(s, d, "ps").withColumn("price", F.col("price") / PRICE_SCALE)


def observed(s, d):
    return prices(s, d).filter(F.col("t") <= OBSERVED)


def fitted(s, d):
    return series.ar1_fit(prices(s, d), ["series"], "t", "price")


def fitted_before(s, d):
    """The fit of what was observed up to the cut."""
    return series.ar1_fit(observed(s, d), ["series"], "t", "price")


def with_gain(s, d):
    return h.hash_uniform(prices(s, d), "series", f"gain{SEED}", *GAIN, name="gain")


def learned(s, d):
    return series.rls_fold(with_gain(s, d), ["series"], "t", "price", "gain", RLS_START, RLS_MATRIX)


def coefficients(s, d):
    """What was learned, as the snapshot the household steps read."""
    return snapshot(s, d, "coefficients", lambda: learned(s, d).select("series", "last", "change", "n1", "n2"))


def with_series(df):
    """Households looking at one of the 25 series each."""
    return df.withColumn("series", F.concat(F.lit("Brand#"), (F.col("hid") % 25 + 1).cast("string")))


def with_path(s, d, states=None):
    joined = with_series(view(s, d, "hs") if states is None else states).join(coefficients(s, d), "series")
    return series.expected_price_path(joined, MAX_AGE)


DIFFS = f"""SELECT p.series, p.t, p.price / {PRICE_SCALE} AS v, (p.price - q.price) / {PRICE_SCALE} AS y,
    (q.price - r.price) / {PRICE_SCALE} AS x FROM ps AS p LEFT JOIN ps AS q ON q.series = p.series AND q.t = p.t - 1
    LEFT JOIN ps AS r ON r.series = p.series AND r.t = p.t - 2 AND q.t IS NOT NULL"""


def fit_sql(rows: str) -> str:
    fit = f"""SELECT series, count(x) AS n, regr_intercept(y, x) AS intercept, regr_slope(y, x) AS slope,
        arg_max(v, t) AS last, arg_max(y, t) AS change FROM ({DIFFS}) WHERE {rows} GROUP BY 1"""
    return f"""SELECT f.*, (SELECT stddev_samp(y - f.intercept - f.slope * x) FROM ({DIFFS}) AS e
        WHERE e.series = f.series AND {rows} AND x IS NOT NULL) AS sd FROM ({fit}) AS f"""


FIT_SD, FIT_BEFORE = fit_sql("true"), fit_sql(f"t <= {OBSERVED}")


def project_sql(fits: str, horizon: int, shock: str = "0") -> str:
    """Price path by stepping from period to period."""
    return f"""WITH RECURSIVE fit AS MATERIALIZED ({fits}), path AS (SELECT series, 0 AS step, last AS value, change AS d, intercept, slope, sd FROM fit
        UNION ALL SELECT series, step + 1, value + intercept + slope * d + {shock}, intercept + slope * d + {shock}, intercept, slope, sd
        FROM path WHERE step < {horizon}) SELECT series, step, value FROM path WHERE step > 0"""


# The learning recursion period by period, as the reference states it.
VIEW_RLS = f"""SELECT series, (SELECT min(t) + 1 FROM ps AS m WHERE m.series = g.series) AS t, gain,
    {RLS_MATRIX[0]}::DOUBLE AS r11, {RLS_MATRIX[1]}::DOUBLE AS r12, {RLS_MATRIX[2]}::DOUBLE AS r21, {RLS_MATRIX[3]}::DOUBLE AS r22,
    {RLS_START[0]}::DOUBLE AS n1, {RLS_START[1]}::DOUBLE AS n2
    FROM (SELECT DISTINCT series, {u_sql('series', f'gain{SEED}', *GAIN)} AS gain FROM {{ps}}) AS g
    UNION ALL SELECT series, t, gain, r11, r12, r21, r22,
    n1 + gain * (r22 * e - r12 * x * e) / (r11 * r22 - r12 * r21), n2 + gain * (r11 * x * e - r21 * e) / (r11 * r22 - r12 * r21)
    FROM (SELECT rls.series, psd.t, gain, r11 + gain * (1 - r11) AS r11, r12 + gain * (x - r12) AS r12,
        r21 + gain * (x - r21) AS r21, r22 + gain * (x * x - r22) AS r22, n1, n2, x, y - n1 - n2 * x AS e
        FROM rls JOIN {{psd}} AS psd ON psd.series = rls.series AND psd.t = rls.t + 1) AS step"""
views.VIEWS["psd"] = DIFFS.replace("FROM ps", "FROM {ps}").replace("JOIN ps", "JOIN {ps}")
views.VIEWS["rls"] = VIEW_RLS
views.VIEWS["learned"] = """SELECT series, r.* EXCLUDE (series, t), arg_max_v AS last, arg_max_y AS change FROM
    (SELECT * FROM {rls} QUALIFY row_number() OVER (PARTITION BY series ORDER BY t DESC) = 1) AS r JOIN
    (SELECT series, arg_max(v, t) AS arg_max_v, arg_max(y, t) AS arg_max_y FROM {psd} GROUP BY 1) AS l USING (series)"""
views.VIEWS["expectation"] = f"""SELECT series, 0 AS step, last AS p, change AS dp, n1, n2 FROM {{learned}}
    UNION ALL SELECT series, step + 1, p + n1 + n2 * dp, n1 + n2 * dp, n1, n2 FROM expectation WHERE step < {MAX_AGE}"""

SERIES_CHECKS = [
    Check(
        "ar1_fit",
        "series:s n:i intercept:r6 slope:r6 sd:r6 last:r6 change:r6",
        fitted,
        FIT_SD,
    ),
    Check(
        "ar1_project",
        "series:s step:i value:r6",
        lambda s, d: series.path_rows(series.ar1_project(fitted(s, d), HORIZON), ["series"]),
        project_sql(FIT_SD, HORIZON),
    ),
    Check(
        "ar1_simulate",
        "series:s step:i value:r6",
        lambda s, d: series.path_rows(series.ar1_simulate(fitted(s, d), ["series"], HORIZON, SEED), ["series"]),
        project_sql(FIT_SD, HORIZON, "sd * " + z_sql("(series || '|' || CAST(step + 1 AS VARCHAR))", str(SEED))),
    ),
    Check(
        "observed_else_projected",
        "series:s t:i price:r6",
        lambda s, d: series.observed_else_projected(
            observed(s, d),
            series.path_rows(series.ar1_project(fitted_before(s, d), HORIZON), ["series", "last_period"], step="step", value="price")
            .withColumn("t", F.col("last_period") + F.col("step")),
            ["series"], "t", "price",
        ),
        f"""SELECT series, t, price / {PRICE_SCALE} AS price FROM ps WHERE t <= {OBSERVED} UNION ALL
            SELECT p.series, l.t + step, value FROM ({project_sql(FIT_BEFORE, HORIZON)}) AS p
            JOIN (SELECT series, max(t) AS t FROM ps WHERE t <= {OBSERVED} GROUP BY 1) AS l ON l.series = p.series""",
    ),
    Check(
        "rls_fold",
        "series:s gain:r6 r11:r6 r12:r6 r21:r6 r22:r6 n1:r6 n2:r6 last:r6",
        learned,
        "SELECT * FROM learned",
    ),
    Check(
        "rls_states",
        "series:s t:i gain:r6 r11:r6 r12:r6 r21:r6 r22:r6 n1:r6 n2:r6",
        lambda s, d: series.rls_states(with_gain(s, d), ["series"], "t", "price", "gain", RLS_START, RLS_MATRIX),
        "SELECT * FROM rls WHERE t > (SELECT min(t) + 1 FROM ps WHERE ps.series = rls.series)",
    ),
    Check(
        "expected_price_path",
        "hid:i step:i value:r6",
        lambda s, d: series.path_rows(with_path(s, d), ["hid"], "expected"),
        "SELECT hid, step, p AS value FROM hs JOIN expectation ON series = 'Brand#' || CAST(hid % 25 + 1 AS VARCHAR) WHERE step > 0",
    ),
]


# --- households -------------------------------------------------------------------------------


def scenarios(s, d):
    """The four policy scenarios with their start years."""
    return view(s, d, "lk_scenario").withColumns({"subsidy_start": F.lit(START), "credit_start": F.lit(START)})


def tariffs(s, d, value):
    return view(s, d, "lk_year").select("year", F.col(value).alias("value"))


def owners(s, d):
    return h.owner_tariff(households(s, d), tariffs(s, d, "tariff"), START)


def revenue(s, d):
    return h.panel_revenue(owners(s, d), PRICE, CAPACITY, OWN_USE)


def percentiles(s, d):
    df = households(s, d).withColumns(
        {
            "income_net": F.col("income"),
            "consumption": F.col("income") * 0.8,
            "liquidity_before": F.col("liquidity") - 50 * (F.col("hid") % 5 - 1),
        }
    )
    return position_groups(df, "income", 100, name="percentile")


def borrowers(s, d):
    """Owners with debt and a liquidity from nothing to more than is due."""
    return households(s, d).withColumn("liquidity", ((F.col("hid") / 20).cast("bigint") % 40 * 10).cast("double"))


def candidates(s, d):
    return h.loan_needed(h.feasibility_flag(households(s, d), FEASIBLE_PROB, f"feasible{SEED}"), COST)


def offers(s, d):
    return h.loan_offer(candidates(s, d), COST, BASE_RATE, MARKUP, MAX_LTV, MAX_AGE)


def rationed(s, d):
    return h.credit_rationing(offers(s, d), COST, MAX_LTV, MAX_DTI)


def utilities(s, d):
    df = rationed(s, d)
    df = h.hash_uniform(df, "hid", f"influence{SEED}", *INFLUENCE, name="influence")
    df = h.expected_revenue(with_path(s, d, df), TARIFF, CAPACITY, OWN_USE)
    df = h.discounted_loan_cost(df, MAX_AGE)
    df = position_groups(df, "income", 10, name="decile")
    df = peer_rate_join(df, h.ownership_shares(df))
    former = (F.col("hid") % 7 == 3).cast("int")
    df = df.withColumns(
        {
            "adopted": F.greatest(F.col("pv"), former),
            "profit": F.when(former == 1, F.col("hid") % 11 - 5).otherwise(0).cast("double"),
            "tariff": F.lit(0.0),
        }
    )
    return h.adoption_utility(df, COST, BETA)


def updated(s, d):
    return h.adoption_update(utilities(s, d), COST, TARIFF, MAX_AGE)


def run_states(s, d):
    df = rationed(s, d)
    return df.withColumn("expected_price", PRICE + 0.001 * (F.col("hid") % 10))


OWNERS = f"""SELECT *, CASE WHEN pv = 1 THEN 0.5 - 0.02 * greatest(0, {START} - panelage - 1 - 2000) ELSE 0 END AS tariff FROM hs"""
# The four cases: consumption against capacity, tariff against price.
REVENUE = f"""SELECT *, CASE WHEN pv = 0 THEN 0 WHEN powercons >= 4500 AND tariff < 0.3 THEN 0.3 * 4500 * 0.3 + 0.7 * 4500 * tariff
    WHEN powercons < 4500 AND tariff < 0.3 THEN least(1350, powercons) * 0.3 + tariff * (4500 - least(1350, powercons))
    ELSE 4500 * tariff END AS panelrevenue FROM ({OWNERS})"""
PERCENTILES = POSITION.replace("range(1, 10)", "range(1, 100)").replace("/ 10.0", "/ 100.0").replace("AS decile", "AS percentile")
FEASIBLE = f"SELECT *, CASE WHEN pv = 1 OR house = 1 OR {u_sql('hid', f'feasible{SEED}')} >= 1 - 0.3 THEN 1 ELSE 0 END AS feasible FROM hs"
CANDIDATES = f"SELECT *, CASE WHEN pv = 1 OR feasible = 0 OR liquidity >= {COST} THEN 0 ELSE {COST} - liquidity END AS loan FROM ({FEASIBLE})"
OFFERS = f"""SELECT *, loan * offerrate * pow(1 + offerrate, 20) / (pow(1 + offerrate, 20) - 1) AS instalment FROM (
    SELECT *, 0.02 + 0.02 * (1 + loan / {COST}) AS offerrate FROM ({CANDIDATES}))"""
RATIONED = f"""SELECT *, CASE WHEN loan > 0 AND feasible = 1 AND pv = 0 AND (loan + debt > {COST} OR instalment / income > 0.02)
    THEN 1 ELSE 0 END AS rationed FROM ({OFFERS})"""
# Schedule by stepping the balance.
SCHEDULE = f"""WITH RECURSIVE o AS MATERIALIZED ({OFFERS}), sched AS (SELECT hid, 0 AS t, offerrate * loan AS interest, instalment - offerrate * loan AS principal,
    loan - (instalment - offerrate * loan) AS balance, offerrate, instalment, discount FROM o
    UNION ALL SELECT hid, t + 1, offerrate * balance, instalment - offerrate * balance, balance - (instalment - offerrate * balance),
    offerrate, instalment, discount FROM sched WHERE t < 19) SELECT * FROM sched"""


def expected_sql(rows: str, tariff_sql: str, key: str = "hid") -> str:
    """Discounted revenue per household from the expected price of each step."""
    use = "powercons * pow(1 + trend, step - 1)"
    return f"""SELECT {key}, sum(CASE WHEN p >= {tariff_sql} AND {use} >= 4500 THEN p * 4500 * 0.3 + 0.7 * {tariff_sql} * 4500
        WHEN p >= {tariff_sql} THEN p * least(1350, {use}) + {tariff_sql} * (4500 - least(1350, {use}))
        ELSE {tariff_sql} * 4500 END / pow(1 + discount, step - 1)) AS revenue
        FROM ({rows}) AS e JOIN expectation ON series = 'Brand#' || CAST(hid % 25 + 1 AS VARCHAR) WHERE step > 0 GROUP BY {key}"""


UTILITIES = f"""SELECT a.*, v.revenue, l.loancost, x.share AS peer_share, g.decile,
    CASE WHEN hid % 7 = 3 THEN 1 ELSE pv END AS adopted, CASE WHEN hid % 7 = 3 THEN hid % 11 - 5 ELSE 0 END AS profit,
    v.revenue - {COST} - l.loancost AS expected_profit,
    CASE WHEN rationed = 1 OR feasible = 0 OR pv = 1 THEN 0
        WHEN hid % 7 = 3 AND hid % 11 > 5 THEN v.revenue - {COST} - l.loancost
        ELSE v.revenue - {COST} - l.loancost + {u_sql('hid', f'influence{SEED}', *INFLUENCE)} * (2 * x.share - 1) + 100 * attitude END AS utility
    FROM ({RATIONED}) AS a JOIN ({expected_sql('SELECT * FROM hs', f'{TARIFF}')}) AS v USING (hid)
    JOIN (SELECT hid, sum(interest / pow(1 + discount, t)) AS loancost FROM ({SCHEDULE}) GROUP BY hid) AS l USING (hid)
    JOIN (SELECT hid, decile FROM ({POSITION})) AS g USING (hid)
    JOIN (SELECT decile, avg(pv) AS share FROM ({POSITION}) GROUP BY decile) AS x ON x.decile = g.decile"""
UPDATED = f"""SELECT *, CASE WHEN borrows THEN newdebt * newrate * pow(1 + newrate, 20) / (pow(1 + newrate, 20) - 1) ELSE debtservice END AS newservice FROM (
    SELECT *, utility > 0 AND loan > 0 AS borrows, CASE WHEN utility > 0 AND loan > 0 THEN (offerrate * loan + loanrate * debt) / (loan + debt) ELSE loanrate END AS newrate,
    CASE WHEN utility > 0 AND loan > 0 THEN debt + loan ELSE debt END AS newdebt FROM ({UTILITIES}))"""
STATISTICS = f"""avg(income) AS AverageIncome, avg(liquidity) AS AverageLiquidity, avg(expected_price) AS AverageExpectedPrice,
    coalesce(avg(debt) FILTER (debt > 0), 0) AS AverageDebt, avg(pv) AS AdoptionRate1,
    CASE WHEN sum(feasible) > 0 THEN sum(pv) / sum(feasible) ELSE 0 END AS AdoptionRate2,
    CASE WHEN count(*) FILTER (pv = 0 AND feasible = 1) > 0 THEN sum(rationed) / count(*) FILTER (pv = 0 AND feasible = 1) ELSE 0 END AS RationedShare"""
RUN_STATES = f"SELECT *, 0.3 + 0.001 * (hid % 10) AS expected_price FROM ({RATIONED})"
STAT_COLS = "AverageIncome:r4 AverageLiquidity:r4 AverageExpectedPrice:r6 AverageDebt:r4 AdoptionRate1:r6 AdoptionRate2:r6 RationedShare:r6"

HOUSEHOLD_CHECKS = [
    Check(
        "hash_uniform", "hid:i u:r9", lambda s, d: h.hash_uniform(view(s, d, "hs"), "hid", SEED, 0.25, 0.75),
        f"SELECT hid, {u_sql('hid', str(SEED), 0.25, 0.75)} AS u FROM hs",
    ),
    Check(
        "normal_draw", "hid:i z:r8", lambda s, d: h.normal_draw(view(s, d, "hs"), "hid", SEED),
        f"SELECT hid, {z_sql('hid', str(SEED))} AS z FROM hs",
    ),
    Check(
        "income_draw", "hid:i income_drawn:r4", lambda s, d: h.income_draw(view(s, d, "hs"), SEED),
        f"SELECT hid, greatest(1e-10, incomesd * {z_sql('hid', str(SEED))} * income + income) AS income_drawn FROM hs",
    ),
    Check(
        "trend_growth", "hid:i t:i income:r4 powercons:r4", lambda s, d: h.trend_growth(view(s, d, "hs"), 5),
        "SELECT hid, t, income * pow(1 + trend, t) AS income, powercons * pow(1 + trend, t) AS powercons FROM hs, (SELECT unnest(range(0, 6)) AS t)",
    ),
]
HOUSEHOLD_CHECKS += [
    Check(
        "policy_schedule",
        "scenario:s year:i s1:r4 s2:r4 cp1:r4 cp2:r4 households:i cost:r4",
        lambda s, d: h.policy_schedule(scenarios(s, d), 2018, 2022)
        .join(view(s, d, "hs").groupBy("year").agg(F.count("hid").alias("households"), F.avg("liquidity").alias("liquid")), "year")
        .withColumn("cost", (1 - F.col("s1")) * COST - F.col("liquid")),
        f"""SELECT scenario, year, if(year >= {START}, s1, 0) AS s1, if(year >= {START}, s2, 0) AS s2, if(year >= {START}, cp1, 0) AS cp1,
            if(year >= {START}, cp2, 0) AS cp2, households, (1 - if(year >= {START}, s1, 0)) * {COST} - liquid AS cost FROM lk_scenario,
            (SELECT year, count(*) AS households, avg(liquidity) AS liquid FROM hs GROUP BY 1)""",
    ),
    Check("panel_revenue", "hid:i panelrevenue:r4", revenue, REVENUE),
    Check(
        "net_power_cost", "hid:i powercost:r4 income_net:r4 profit:r4",
        lambda s, d: h.net_power_cost(revenue(s, d).withColumn("income", F.col("income") - 21000), PRICE),
        f"""SELECT hid, powercons * 0.3 - panelrevenue AS powercost, greatest(0, income - 21000 - (powercons * 0.3 - panelrevenue)) AS income_net,
            panelrevenue AS profit FROM ({REVENUE})""",
    ),
    Check(
        "desired_consumption", "hid:i first:r4 consumption:r4",
        lambda s, d: h.desired_consumption(
            h.desired_consumption(percentiles(s, d).withColumn("before", F.col("consumption")), propensity(s, d), PERSISTENCE, True)
            .withColumns({"first": F.col("consumption"), "consumption": F.col("before")}),
            propensity(s, d), PERSISTENCE, False,
        ),
        f"""SELECT hid, (0.95 - 0.004 * percentile) * income AS first,
            0.6 * 0.8 * income + 0.4 * (0.95 - 0.004 * percentile) * income AS consumption FROM ({PERCENTILES})""",
    ),
    Check(
        "liquidity_update", "hid:i liquidity:r4",
        lambda s, d: h.liquidity_update(
            households(s, d).withColumns({"consumption": (0.7 + 0.1 * (F.col("hid") % 7)) * F.col("income"), "powercost": F.col("powercons") * PRICE})
        ),
        """SELECT hid, greatest(0, liquidity + income - (0.7 + 0.1 * (hid % 7)) * income - powercons * 0.3) AS liquidity FROM hs""",
    ),
    Check(
        "debt_service", "hid:i liquidity:r4 debt:r4 loanrate:r4 debtservice:r4 profit:r4",
        lambda s, d: h.debt_service(borrowers(s, d), MAX_AGE),
        """SELECT hid, greatest(0, liq - debtservice) AS liquidity, rest AS debt, loanrate, -CASE WHEN liq >= debtservice THEN i ELSE least(i, liq) END AS profit,
            CASE WHEN debt = 0 THEN 0 WHEN liq >= debtservice THEN debtservice ELSE rest * 0.03 * pow(1.03, term) / (pow(1.03, term) - 1) END AS debtservice FROM (
            SELECT *, 0.03 * debt AS i, greatest(1, 20 - panelage) AS term, CASE WHEN debt = 0 THEN 0 WHEN liq >= 150 THEN debt - (150 - 0.03 * debt)
            WHEN liq >= 0.03 * debt THEN debt - (liq - 0.03 * debt) ELSE debt + 0.03 * debt - liq END AS rest
            FROM (SELECT *, (hid // 20) % 40 * 10 AS liq FROM hs))""",
    ),
    Check(
        "liquid_saving_share", "hid:i liquidity:r4",
        lambda s, d: h.liquid_saving_share(
            percentiles(s, d), view(s, d, "lk_percentile").select("percentile", F.col("liquidshare").alias("value"))
        ),
        f"""SELECT hid, CASE WHEN gain > 0 THEN liquidity - gain + (0.10 + 0.002 * percentile) * gain ELSE liquidity END AS liquidity FROM (
            SELECT *, 50 * (hid % 5 - 1) AS gain FROM ({PERCENTILES}))""",
    ),
    Check(
        "panel_ageing", "hid:i pv:i tariff:r4 panelage:i", lambda s, d: h.panel_ageing(owners(s, d), MAX_AGE),
        f"""SELECT hid, if(panelage + pv > 20, 0, pv) AS pv, if(panelage + pv > 20, 0, tariff) AS tariff,
            if(panelage + pv > 20, 0, panelage + pv) AS panelage FROM ({OWNERS})""",
    ),
    Check(
        "feasibility_flag", "hid:i feasible:i",
        lambda s, d: h.feasibility_flag(households(s, d), FEASIBLE_PROB, f"feasible{SEED}"), FEASIBLE,
    ),
    Check("owner_tariff", "hid:i panelage:i tariff:r4", owners, OWNERS),
    Check(
        "initial_cumulative_profit", "hid:i profit:r4",
        lambda s, d: h.initial_cumulative_profit(owners(s, d), tariffs(s, d, "cost"), START, PRICE, CAPACITY, OWN_USE),
        f"""SELECT hid, CASE WHEN pv = 1 THEN panelrevenue * panelage - (30000 - 1100 * greatest(0, {START} - panelage - 1 - 2000)) ELSE 0 END AS profit
            FROM ({REVENUE})""",
    ),
    Check("loan_needed", "hid:i loan:r4", candidates, CANDIDATES),
    Check("loan_offer", "hid:i offerrate:r6 instalment:r4", offers, OFFERS),
    Check("credit_rationing", "hid:i rationed:i", rationed, RATIONED),
    Check(
        "amortisation_schedule", "hid:i t:i interest:r4 principal:r4 balance:r4",
        lambda s, d: h.amortisation_schedule(offers(s, d), MAX_AGE), SCHEDULE,
    ),
    Check(
        "discounted_loan_cost", "hid:i loancost:r4", lambda s, d: h.discounted_loan_cost(offers(s, d), MAX_AGE),
        f"SELECT hid, sum(interest / pow(1 + discount, t)) AS loancost FROM ({SCHEDULE}) GROUP BY hid",
    ),
    Check(
        "expected_revenue", "hid:i revenue:r4",
        lambda s, d: h.expected_revenue(with_path(s, d), TARIFF, CAPACITY, OWN_USE), expected_sql("SELECT * FROM hs", f"{TARIFF}"),
    ),
    Check("adoption_utility", "hid:i expected_profit:r4 utility:r4", utilities, UTILITIES),
    Check(
        "adoption_update",
        "hid:i adopter:i pv:i adopted:i profit:r4 liquidity:r4 tariff:r4 loanrate:r6 debt:r4 debtservice:r4",
        updated,
        f"""SELECT hid, (utility > 0)::INT AS adopter, greatest(pv, (utility > 0)::INT) AS pv, greatest(adopted, (utility > 0)::INT) AS adopted,
            CASE WHEN utility > 0 THEN -{COST} WHEN adopted = 1 AND profit <= 0 AND pv = 0 THEN 0 ELSE profit END AS profit,
            CASE WHEN utility > 0 THEN liquidity - {COST} + loan ELSE liquidity END AS liquidity,
            CASE WHEN utility > 0 THEN {TARIFF} ELSE 0 END AS tariff, newrate AS loanrate, newdebt AS debt, newservice AS debtservice FROM ({UPDATED})""",
    ),
    Check(
        "ownership_by_decile", "decile:i members:i owners:i share:r6",
        lambda s, d: h.ownership_by_decile(view(s, d, "hs")),
        f"SELECT decile, count(*) AS members, sum(pv) AS owners, avg(pv) AS share FROM ({POSITION}) GROUP BY 1",
    ),
    Check(
        "period_statistics", f"run:s year:i {STAT_COLS}", lambda s, d: h.period_statistics(run_states(s, d), ["run", "year"]),
        f"SELECT run, year, {STATISTICS} FROM ({RUN_STATES}) GROUP BY 1, 2",
    ),
    Check(
        "run_series_long", "run:s year:i variable:s value:r6",
        lambda s, d: h.run_series_long(
            h.period_statistics(run_states(s, d), ["run", "year"]), ["run", "year"], {"AdoptionRate1": "All", "AdoptionRate2": "Only feasible"}
        ),
        f"""WITH st AS (SELECT run, year, {STATISTICS} FROM ({RUN_STATES}) GROUP BY 1, 2) SELECT run, year, 'All' AS variable, AdoptionRate1 AS value FROM st
            UNION ALL SELECT run, year, 'Only feasible', AdoptionRate2 FROM st""",
    ),
]


def propensity(s, d):
    return view(s, d, "lk_percentile").select("percentile", F.col("propensity").alias("value"))


def scoring(s, d):
    schedule = h.policy_schedule(scenarios(s, d), START, START)
    return job_adoption_scoring(with_series(households(s, d)), coefficients(s, d), view(s, d, "lk_year"), schedule, MARKET)


_RULE = "list_transform(range(1, 10), lambda i: sorted[CAST(round_even(i * (n + 1) / 10.0 - 1, 0) AS BIGINT) + 1])"
SCORING = f"""WITH RECURSIVE
    base AS MATERIALIZED (SELECT o.*, feasible, {u_sql('hid', f'influence{SEED}', *INFLUENCE)} AS influence,
        scenario, s1, s2, cp1, cp2, (1 - s1) * {COST} AS price FROM ({OWNERS}) AS o JOIN (SELECT hid, feasible FROM ({FEASIBLE})) USING (hid), lk_scenario),
    net AS MATERIALIZED (SELECT *, greatest(0, income - powercons * 0.3 + CASE WHEN pv = 0 THEN 0
        WHEN tariff + s2 < 0.3 THEN least(1350, powercons) * 0.3 + (tariff + s2) * (4500 - least(1350, powercons))
        ELSE 4500 * (tariff + s2) END) AS income_net FROM base),
    cuts AS (SELECT scenario, {_RULE} AS cut FROM (SELECT scenario, list(income_net ORDER BY income_net) AS sorted, count(*) AS n FROM net GROUP BY 1)),
    ranked AS MATERIALIZED (SELECT net.*, len(list_filter(cut, lambda x: x < income_net)) AS decile FROM net JOIN cuts USING (scenario)),
    peers AS (SELECT scenario, decile, avg(pv) AS share FROM ranked GROUP BY 1, 2),
    loans AS MATERIALIZED (SELECT *, loan * rate * pow(1 + rate, 20) / (pow(1 + rate, 20) - 1) AS instalment FROM (
        SELECT *, 0.04 + 0.02 * loan / price AS rate FROM (SELECT *, CASE WHEN pv = 1 OR feasible = 0 OR liquidity >= price THEN 0
        ELSE price - liquidity END AS loan FROM ranked))),
    steps AS (SELECT hid, scenario, 0 AS t, rate * loan AS interest, loan - (instalment - rate * loan) AS balance, rate, instalment, discount FROM loans
        UNION ALL SELECT hid, scenario, t + 1, rate * balance, balance - (instalment - rate * balance), rate, instalment, discount FROM steps WHERE t < 19),
    cost AS (SELECT hid, scenario, sum(interest / pow(1 + discount, t)) AS loancost FROM steps GROUP BY 1, 2),
    rev AS ({expected_sql('SELECT * FROM loans', f'({TARIFF} + s2)', 'hid, scenario')}),
    judged AS (SELECT *, CASE WHEN feasible = 0 OR pv = 1 OR rationed = 1 THEN 0 ELSE revenue - price - loancost
        + influence * (2 * share - 1) + 100 * attitude END AS utility FROM (
        SELECT loans.*, revenue, loancost, share, p, CASE WHEN loan > 0 AND (loan + debt > price * (1 + cp1) OR instalment / income > 0.02 + cp2)
        THEN 1 ELSE 0 END AS rationed FROM loans JOIN rev USING (hid, scenario) JOIN cost USING (hid, scenario) JOIN peers USING (scenario, decile)
        JOIN (SELECT series, p FROM expectation WHERE step = 1) AS e ON e.series = 'Brand#' || CAST(hid % 25 + 1 AS VARCHAR))),
    after AS (SELECT scenario, income, feasible, rationed, p AS expected_price, (utility > 0)::INT AS adopter, greatest(pv, (utility > 0)::INT) AS pv,
        CASE WHEN utility > 0 THEN debt + loan ELSE debt END AS debt, CASE WHEN utility > 0 THEN liquidity - price + loan ELSE liquidity END AS liquidity FROM judged)
    SELECT scenario, count(*) AS households, sum(adopter) AS adopters, {STATISTICS} FROM after GROUP BY 1"""

JOB_CHECKS = [
    Check("job_adoption_scoring", f"scenario:s households:i adopters:i {STAT_COLS}", scoring, SCORING),
]

CHECKS = [*HOUSEHOLD_CHECKS, *SERIES_CHECKS]
