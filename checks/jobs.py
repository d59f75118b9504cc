"""End-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.cleaning import BANDS
from checks.framework import Check
from checks.least_squares import job_sql
from checks.reshaping import person_tables
from checks.statistics import OLS, OLS_SUMS
from checks.views import CONCEPTS, FAMILIES, codebook, snapshot, view, wealth_codebook
from hearthpanel.operators import clean, regression
from hearthpanel.plans import jobs
from hearthpanel.workspace import new_path

REF_YEAR, SCORE_YEAR = 2011, 2010
PERSON_BOOK = {"v_pid": "pid", "v_hid": "hid", "syear": "year", "v_inc": "income", "v_age": "age", "v_absent": "absent"}
HOUSEHOLD_BOOK = {"v_hid": "hid", "syear": "year", "v_own": "owner", "v_moved": "YearMoved"}
COMPONENTS = [text for _, text in views.WEALTH_CODEBOOK]
PARTS = {"tangible": "Tangible", "business": "Business", "financial": "Financial", "HouseNet": "Main Property"}


def waves(df, spark, name):
    """A table as one file per half of the years."""
    folder = new_path(spark, name)
    for part, rest in (("a", 0), ("b", 1)):
        df.filter(F.col("syear") % 2 == rest).write.parquet(f"{folder}/{name}_{part}.parquet")
    return f"{folder}/{name}_*.parquet"


def person_file(s, d):
    raw = view(s, d, "py").select(
        F.col("pid").alias("v_pid"), F.col("hid").alias("v_hid"), F.col("year").alias("syear"), F.col("income").alias("v_inc"),
        F.col("age").alias("v_age"), F.col("sex").alias("v_other"),
    )
    return jobs.job_person_file(s, waves(raw, s, "person"), PERSON_BOOK, 2007)


def household_file(s, d):
    raw = view(s, d, "py").select(
        F.col("hid").alias("v_hid"), F.col("year").alias("syear"), F.col("owner").alias("v_own"), F.col("YearMoved").alias("v_moved"),
    ).distinct()
    return jobs.job_household_file(s, waves(raw, s, "household"), HOUSEHOLD_BOOK, 2007)


def consumption(s, d):
    return jobs.job_consumption(view(s, d, "cw"), codebook(s), view(s, d, "py"), CONCEPTS)


def consumption_rows(s, d):
    """All households, written as the snapshot later jobs read."""
    return snapshot(s, d, "consumption", lambda: consumption(s, d))


def person_panel(s, d):
    return jobs.job_person_panel(*person_tables(s, d))


def panel_snapshot(s, d):
    return snapshot(s, d, "panel", lambda: person_panel(s, d))


def wealth(s, d):
    return jobs.job_wealth(view(s, d, "ww"), wealth_codebook(s), view(s, d, "py"), COMPONENTS, [v[:4] for v in FAMILIES])


def regression_rows(s, d):
    return snapshot(s, d, "rows", lambda: jobs.regression_rows(view(s, d, "hw"), panel_snapshot(s, d)))


def linear_estimates(s, d):
    rows = regression_rows(s, d)
    return jobs.wealth_estimates(regression.ols_coef_table(rows, [regression.ols_linear(rows, "GrossWealth", ["income", "age"])]))


def spells(s, d):
    return snapshot(s, d, "spells", lambda: jobs.household_spells(panel_snapshot(s, d), REF_YEAR))


def household_panel(s, d):
    return jobs.job_household_panel(panel_snapshot(s, d), view(s, d, "hw"), linear_estimates(s, d), REF_YEAR)


def fitted(s, d):
    rows = regression_rows(s, d)
    fits = [
        regression.ols_linear(rows, "GrossWealth", ["income", "age"]),
        regression.ols_fixed_effect(rows, "GrossWealth", ["income", "age"], "year"),
    ]
    return regression.ols_fitted(rows, fits)


def regression_job(s, d):
    coefs, out = jobs.job_wealth_regression(view(s, d, "hw"), panel_snapshot(s, d))
    long = out.unpivot(["hid", "year"], [f"Model{i}" for i in range(1, 6)], "term", "fitted")
    return coefs.select(F.lit("estimate").alias("kind"), "spec", "term", "estimate").unionByName(
        long.select(F.lit("fitted").alias("kind"), "term", "hid", "year", "fitted"), allowMissingColumns=True
    )


# Statements shared by the jobs; only DuckDB reads these.
views.VIEWS["cons"] = """SELECT *, Food + Clothes + Transport + Health + Insurance + Heating AS total FROM (
    SELECT hid, income, owner, max(v) FILTER (concept = 'Food') AS Food, max(v) FILTER (concept = 'Clothes') AS Clothes,
    max(v) FILTER (concept = 'Transport') AS Transport, max(v) FILTER (concept = 'Health') AS Health,
    max(v) FILTER (concept = 'Insurance') AS Insurance, max(v) FILTER (concept = 'Heating') AS Heating FROM (
    SELECT hid, income, owner, concept, CASE WHEN count(v) = count(*) THEN avg(v) END * 12 / 1000 AS v FROM (
    SELECT l.hid, income, owner, CASE WHEN var LIKE 'consum%' THEN substr(var, 7, 1) ELSE left(var, 5) END AS code,
    CASE WHEN var LIKE 'oheat%' THEN value / 12 ELSE value END AS v FROM {cwl} AS l LEFT JOIN
    (SELECT hid, max(income) AS income, max(owner) AS owner FROM {py} WHERE year = 2010 GROUP BY 1) AS p ON p.hid = l.hid
    WHERE (owner = 1 AND var NOT LIKE 'rheat%') OR (owner IS DISTINCT FROM 1 AND var NOT LIKE 'oheat%')) JOIN {lk_codebook} USING (code)
    GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""
views.VIEWS["consg"] = """SELECT hid, income, CASE WHEN income IS NOT NULL THEN
    ntile(10) OVER (PARTITION BY income IS NULL ORDER BY income, hid) END AS decile, * EXCLUDE (hid, income) FROM {cons}"""
views.VIEWS["consl"] = """SELECT hid, income, decile, concept, CASE concept WHEN 'Food' THEN 'Daily' WHEN 'Clothes' THEN 'Daily' WHEN 'Insurance' THEN 'Financial'
    ELSE concept END AS grp, CASE concept WHEN 'Food' THEN Food WHEN 'Clothes' THEN Clothes WHEN 'Transport' THEN Transport
    WHEN 'Health' THEN Health WHEN 'Insurance' THEN Insurance ELSE Heating END AS value
    FROM {consg}, (SELECT unnest(['Food', 'Clothes', 'Transport', 'Health', 'Insurance', 'Heating']) AS concept)"""
views.VIEWS["hp"] = """SELECT pid, hid, year, YearMoved, income, GrossIncome, age, education, Npersons, sex, head, PowerCosts, garden, elevator,
    CASE WHEN o BETWEEN 2 AND 5 THEN 0 ELSE o END AS owner, lodge, PanelYear, pv FROM (SELECT * EXCLUDE (owner, lodge, pv),
    first_value(owner IGNORE NULLS) OVER s AS o, first_value(lodge IGNORE NULLS) OVER s AS lodge,
    min(CASE WHEN state = 1 THEN year END) OVER s AS PanelYear, max(state) OVER s AS pv FROM (
    SELECT * REPLACE (income / 1000 AS income, GrossIncome / 1000 AS GrossIncome), CASE WHEN kind IS NULL THEN NULL WHEN kind LIKE '%Flat%' THEN 'Flats' ELSE 'House' END AS lodge,
    CASE WHEN events > 0 THEN 1 WHEN events = 0 THEN 0 END AS state FROM (SELECT *, sum(pv) OVER (PARTITION BY pid, YearMoved ORDER BY year) AS events,
    CASE WHEN LodgeEnglish != 'NA' THEN LodgeEnglish WHEN garden = 1 THEN 'House' WHEN elevator = 1 THEN 'Flat' END AS kind FROM {pyc}))
    WINDOW s AS (PARTITION BY pid, hid, YearMoved ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE pv IS NOT NULL"""
views.VIEWS["sp"] = f"""SELECT hid, year, YearMoved, GrossIncome, income, age, HouseType, coalesce(PowerCosts, round_even(power, 0)) * 12 AS PowerCosts,
    CASE WHEN PanelYear > {REF_YEAR} THEN 0 ELSE pv END AS pv, CASE WHEN year = {REF_YEAR} AND PanelYear <= {REF_YEAR} THEN {REF_YEAR} - PanelYear END AS PanelAge FROM (
    SELECT * EXCLUDE (HouseType), avg(PowerCosts) OVER s AS power, first_value(HouseType IGNORE NULLS) OVER s AS HouseType FROM (
    SELECT hid, year, YearMoved, avg(GrossIncome) AS GrossIncome, avg(income) AS income, max(age) AS age, arg_min(lodge, pid) FILTER (lodge IS NOT NULL) AS HouseType,
    avg(PowerCosts) AS PowerCosts, max(pv) AS pv, min(PanelYear) AS PanelYear FROM {{hp}} GROUP BY 1, 2, 3)
    WINDOW s AS (PARTITION BY hid, YearMoved ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    WHERE HouseType IS NOT NULL AND power IS NOT NULL"""
views.VIEWS["rr"] = """SELECT hid, year, income, age, GrossWealth, education FROM (SELECT h.hid, h.year, income, age, GrossWealth, p.education, Npersons
    FROM {hw} AS h LEFT JOIN (SELECT hid, year, max(education) AS education, avg(Npersons) AS Npersons FROM {hp} GROUP BY 1, 2
    HAVING max(education) IS NOT NULL) AS p ON p.hid = h.hid AND p.year = h.year)
    WHERE GrossWealth < (SELECT quantile_cont(GrossWealth, 0.99) FROM {hw}) AND education IS NOT NULL"""
views.VIEWS["est"] = f"""SELECT t AS term, CASE t WHEN 'income' THEN ba WHEN 'age' THEN bb ELSE my - ba * ma - bb * mb END AS est,
    sqrt((syy - ba * say - bb * sby) / (n - 3) * CASE t WHEN 'income' THEN sbb / (saa * sbb - sab * sab) WHEN 'age' THEN saa / (saa * sbb - sab * sab)
    ELSE 1.0 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / (saa * sbb - sab * sab) END) AS se FROM
    ({OLS.format(sums=f"{OLS_SUMS} FROM (SELECT GrossWealth AS y, income AS a, age AS b FROM {{rr}})")}), (SELECT unnest(['Intercept', 'income', 'age']) AS t)"""
RATES = """SELECT year, IncomeGroup, count(*) AS obs, sum(pv) AS pv, 100.0 * sum(pv) / count(*) AS prob FROM (
    SELECT *, ntile(10) OVER (PARTITION BY year ORDER BY income, hid, YearMoved) AS IncomeGroup FROM ({rows})) GROUP BY 1, 2"""
ADOPTION = """SELECT year, IncomeGroup, obs, pv, prob, sum(obs) OVER (PARTITION BY year) AS year_obs,
    avg(prob) OVER (PARTITION BY year) AS year_prob FROM ({rates})"""
SPELL_ROWS = "SELECT * FROM sp WHERE income IS NOT NULL"
BALANCED = "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY hid) AS n FROM sp WHERE year BETWEEN 2005 AND 2011) WHERE n = 7 AND income IS NOT NULL"
ADOPTION_COLS = "year:i IncomeGroup:i obs:i pv:i prob:r4 year_obs:i year_prob:r4"
MEASURES = " UNION ALL ".join(
    f"SELECT decile, '{label}' AS var, avg({col}) AS value FROM ({{rows}}) WHERE year = {SCORE_YEAR} GROUP BY 1"
    for label, col in [("A) Gross Wealth", "GrossWealth"), ("B) Gross Debt", "GrossDebts"), ("C) Net Wealth", "NetWealth")]
)
YEAR_MEAN = """(SELECT y, a, b FROM (SELECT GrossWealth - avg(GrossWealth) OVER (PARTITION BY year) AS y,
    income - avg(income) OVER (PARTITION BY year) AS a, age - avg(age) OVER (PARTITION BY year) AS b FROM rr))"""
MODELS = f"""SELECT hid, year, GrossWealth, (SELECT est FROM est WHERE term = 'Intercept') + (SELECT est FROM est WHERE term = 'income') * income
    + (SELECT est FROM est WHERE term = 'age') * age AS Model1, avg(GrossWealth) OVER (PARTITION BY year) + w.ba * (income - avg(income) OVER (PARTITION BY year))
    + w.bb * (age - avg(age) OVER (PARTITION BY year)) AS Model2 FROM rr, ({OLS.format(sums=f"{OLS_SUMS} FROM {YEAR_MEAN}")}) AS w"""
HISTOGRAM = " UNION ALL ".join(
    f"SELECT '{m}' AS var, floor({m} / 1000 / 100 + 0.5) AS bin, count(*) AS count FROM m WHERE {m} < (SELECT quantile_cont({m}, 0.99) FROM m) GROUP BY 2"
    for m in ("GrossWealth", "Model1", "Model2")
)
COMPOSITION = " UNION ALL ".join(
    f"SELECT decile, '{v}' AS var, '{g}' AS grp, avg({v}) / 1000 AS value FROM dec WHERE year = {SCORE_YEAR} GROUP BY 1" for v, g in PARTS.items()
)
PANEL_COLS = (
    "pid:i hid:i year:i YearMoved:i income:r4 GrossIncome:r4 age:i education:i Npersons:i sex:i head:i owner:i lodge:s "
    "PanelYear:i pv:i PowerCosts:i garden:i elevator:i"
)

CHECKS = [
    Check(
        "job_person_file", "pid:i hid:i year:i income:r2 age:i", person_file,
        "SELECT * FROM py WHERE year >= 2007",
    ),
    Check(
        "job_household_file", "hid:i year:i owner:i YearMoved:i", household_file,
        "SELECT DISTINCT hid, year, owner, YearMoved FROM py WHERE year >= 2007",
    ),
    Check(
        "job_consumption", "hid:i income:r2 owner:i Food:r6 Clothes:r6 Transport:r6 Health:r6 Insurance:r6 Heating:r6 total:r6",
        consumption, "SELECT * FROM cons",
    ),
    Check(
        "job_wealth", "hid:i year:i income:r2 age:i " + " ".join(f"{c}:r2" for c in COMPONENTS), wealth,
        "SELECT w.hid, w.year, income, age, "
        + ", ".join(f"sum(value) FILTER (var = '{v}') AS {t}" for v, t in views.WEALTH_CODEBOOK)
        + """ FROM (SELECT hid, year, left(var, 5) AS var, coalesce(avg(nullif(value, -8)), 0) AS value FROM wwl GROUP BY 1, 2, 3) AS w
            LEFT JOIN (SELECT hid, max(income) AS income, max(age) AS age FROM py WHERE year IN (2002, 2007, 2012, 2017) GROUP BY 1) AS p
            ON p.hid = w.hid GROUP BY 1, 2, 3, 4""",
    ),
    Check("job_person_panel", PANEL_COLS, person_panel, "SELECT * FROM hp"),
    Check(
        "job_income_brackets", "band:i LowAmt:r2 HighAmt:r2 LowPer:i HighPer:i",
        lambda s, d: jobs.job_income_brackets(clean.negatives_to_null(view(s, d, "py"), ["income"]), SCORE_YEAR, BANDS),
        f"""WITH i AS (SELECT hid, avg(income) AS income FROM pyc WHERE year = {SCORE_YEAR} GROUP BY 1 HAVING avg(income) IS NOT NULL),
            e AS (SELECT list_concat([0, 50000, 100000, 150000, 200000, 300000, 400000], CASE WHEN max(income) > 400000 THEN [max(income)] ELSE [] END) AS cuts FROM i),
            b AS (SELECT DISTINCT least(len(list_filter(cuts, lambda c: c <= income)), len(cuts) - 1) AS band, cuts FROM i, e)
            SELECT band, cuts[band] AS LowAmt, cuts[band + 1] AS HighAmt,
            (SELECT round_even(100.0 * count(*) FILTER (income <= b.cuts[b.band]) / count(*), 0) FROM i) AS LowPer,
            (SELECT round_even(100.0 * count(*) FILTER (income <= b.cuts[b.band + 1]) / count(*), 0) FROM i) AS HighPer FROM b""",
    ),
    Check("job_wealth_regression", "kind:s spec:i term:s hid:i year:i estimate:r4 fitted:r0", regression_job, job_sql("SELECT * FROM rr", "GrossWealth")),
    Check(
        "job_household_panel",
        "hid:i year:i YearMoved:i GrossIncome:r4 income:r4 age:i HouseType:s PowerCosts:r2 pv:i PanelAge:i GrossWealth:r2 NetWealth:r2 "
        "GrossDebts:r2 age_wealth_est:r4 income_wealth_est:r4 intercept_wealth_est:r2 age_wealth_se:r4 income_wealth_se:r4 intercept_wealth_se:r2",
        household_panel,
        "SELECT s.*, GrossWealth, NetWealth, GrossDebts, "
        + ", ".join(
            f"(SELECT {stat} FROM est WHERE term = '{t}') AS {t.lower()}_wealth_{stat}" for t in ("age", "income", "Intercept") for stat in ("est", "se")
        )
        + " FROM sp AS s LEFT JOIN hw AS h ON h.hid = s.hid AND h.year = s.year",
    ),
    Check(
        "job_consumption_deciles", "IncomeGroup:i IncAvg:r4 ConAvg:r4 ConSd:r4 ConShareAvg:r4 ConShareSd:r4",
        lambda s, d: jobs.job_consumption_deciles(consumption(s, d)),
        """SELECT g AS IncomeGroup, avg(income) AS IncAvg, avg(total) AS ConAvg, stddev_samp(total) AS ConSd, avg(total / income * 100) AS ConShareAvg,
            stddev_samp(total / income * 100) AS ConShareSd FROM (SELECT income / 1000 AS income, total, ntile(10) OVER (ORDER BY income, hid) AS g
            FROM cons WHERE income IS NOT NULL) WHERE income > 0 GROUP BY 1""",
    ),
    Check(
        "job_power_deciles", "IncomeGroup:i year:i IncAvg:r2 IncSd:r2 PowerCostAvg:r4 PowerCostSd:r4",
        lambda s, d: jobs.job_power_deciles(clean.negatives_to_null(view(s, d, "py"), ["income", "PowerCosts"]), [2007, 2010]),
        """WITH b AS (SELECT year, hid, max(income) AS income, max(PowerCosts) AS power FROM pyc WHERE year IN (2007, 2010) GROUP BY 1, 2 HAVING max(income) IS NOT NULL),
            q AS (SELECT quantile_cont(income, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c, quantile_cont(income, 0.025) AS lo, quantile_cont(income, 0.975) AS hi FROM b)
            SELECT 1 + len(list_filter(c, lambda x: x <= income)) AS IncomeGroup, year, avg(income) AS IncAvg, stddev_samp(income) AS IncSd,
            avg(power) * 12 AS PowerCostAvg, stddev_samp(power) * 12 AS PowerCostSd FROM b, q WHERE income > lo AND income < hi GROUP BY 1, 2""",
    ),
    Check("job_adoption_rate", ADOPTION_COLS, lambda s, d: jobs.job_adoption_rate(spells(s, d)), ADOPTION.format(rates=RATES.format(rows=SPELL_ROWS))),
    Check(
        "job_adoption_rate_balanced", ADOPTION_COLS, lambda s, d: jobs.job_adoption_rate_balanced(spells(s, d), 2005, 2011),
        ADOPTION.format(rates=RATES.format(rows=BALANCED)),
    ),
    Check(
        "job_consumption_by_group", "decile:i group:s value:r4 total:r4 share:r4 position:i",
        lambda s, d: jobs.job_consumption_by_group(consumption_rows(s, d), codebook(s)),
        """WITH m AS (SELECT decile, grp, CASE WHEN count(value) = count(*) THEN avg(value) END AS value FROM consl GROUP BY 1, 2),
            s AS (SELECT *, sum(value) OVER (PARTITION BY decile) AS total, value / sum(value) OVER (PARTITION BY decile) * 100 AS share FROM m)
            SELECT decile, grp AS "group", value, total, share, position FROM s
            LEFT JOIN (SELECT grp, dense_rank() OVER (ORDER BY median(share)) AS position FROM s WHERE share IS NOT NULL GROUP BY 1) USING (grp)""",
    ),
    Check(
        "job_consumption_income_matrix", "decile:i group:s income:r2 total:r4 share:r6 position:i",
        lambda s, d: jobs.job_consumption_income_matrix(consumption_rows(s, d), codebook(s)),
        """WITH s AS (SELECT decile, grp, min(income) AS income, sum(value) AS total, sum(value) / min(income) * 100 AS share FROM (
            SELECT decile, grp, concept, avg(value) AS value, avg(income) AS income FROM consl GROUP BY 1, 2, 3) GROUP BY 1, 2)
            SELECT decile, grp AS "group", income, total, share, position FROM s JOIN (SELECT grp, dense_rank() OVER (ORDER BY median(total) DESC) AS position FROM s GROUP BY 1) USING (grp)""",
    ),
    Check(
        "job_wealth_by_income", "decile:i var:s value:r2", lambda s, d: jobs.job_wealth_by_income(view(s, d, "hw"), SCORE_YEAR),
        MEASURES.format(rows="SELECT * FROM dec"),
    ),
    Check(
        "job_wealth_by_age", "decile:i var:s value:r2", lambda s, d: jobs.job_wealth_by_age(view(s, d, "hw"), SCORE_YEAR),
        MEASURES.format(rows="SELECT *, least(age // 10, CASE WHEN (SELECT max(age) FROM hw) > 80 THEN 8 ELSE 7 END) AS decile FROM hw"),
    ),
    Check(
        "job_wealth_composition", "decile:i var:s group:s type:s value:r4 position:i",
        lambda s, d: jobs.job_wealth_composition(view(s, d, "hw"), SCORE_YEAR, PARTS),
        f"""WITH c AS ({COMPOSITION}), f AS (SELECT decile, var, grp, 'a) Value in Ths. Euros' AS type, value FROM c UNION ALL
            SELECT decile, var, grp, 'b) Percentage of Net Wealth', value / sum(value) OVER (PARTITION BY decile) * 100 FROM c)
            SELECT decile, var, grp AS "group", type, value, position FROM f JOIN (SELECT grp, dense_rank() OVER (ORDER BY median(value)) AS position FROM f GROUP BY 1) USING (grp)""",
    ),
    Check(
        "job_estimate_table", "term:s est:r4 se:r4",
        lambda s, d: jobs.job_estimate_table(linear_estimates(s, d)), "SELECT * FROM est",
    ),
    Check(
        "job_fitted_histogram", "var:s bin:i count:i",
        lambda s, d: jobs.job_fitted_histogram(fitted(s, d), ["GrossWealth", "Model1", "Model2"]), f"WITH m AS ({MODELS}) {HISTOGRAM}",
    ),
]
