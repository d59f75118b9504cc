"""Aggregations, windows, ranking, banding."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.cleaning import BANDS, consumption_long
from checks.framework import Check
from checks.least_squares import EDUCATION, LINEAR, SQUARED, coef_sql
from checks.views import FAMILIES, PRICE_SCALE, codebook, view
from hearthpanel.operators import aggregates, clean, density, joins, panel, regression
from hearthpanel.operators.keyed import group_stats
from hearthpanel.operators.reshape import stack_with_id, wide_to_long
from hearthpanel.plans.jobs import harmonise

SPELL = ["pid", "hid", "YearMoved"]
HOME = ["hid", "YearMoved"]
KEY = ["hid", "year"]


def py(s, d):
    return view(s, d, "py")


def clean_py(s, d):
    return clean.negatives_to_null(py(s, d), ["income", "education", "owner", "PowerCosts"])


def wealth_long(s, d):
    long = wide_to_long(view(s, d, "ww").withColumnRenamed("syear", "year"), ["hid", "year"])
    return clean.split_imputation(clean.code_to_null(long, "value", -8.0))


def deciles(s, d):
    return panel.ntile_global(view(s, d, "hw"), "income", 10, ["hid", "year"])


def concepts(s, d):
    return joins.codebook_join(clean.concept_code(consumption_long(s, d)), codebook(s), "code")


def consumers(s, d):
    """Long consumption with concept, income and income decile of the household."""
    income = view(s, d, "hw").filter("year = 2010").select("hid", "income")
    groups = panel.ntile_global(income, "income", 10, ["hid"])
    return concepts(s, d).join(groups, "hid")


CONSUMERS = """SELECT c.hid, concept, grp, value, income, decile FROM (SELECT hid, value, CASE WHEN var LIKE 'consum%'
    THEN substr(var, 7, 1) ELSE left(var, 5) END AS code FROM cwl) AS c JOIN lk_codebook USING (code)
    JOIN (SELECT hid, income, ntile(10) OVER (ORDER BY income, hid) AS decile FROM hw WHERE year = 2010) AS i ON i.hid = c.hid"""

MEANS_SQL = "SELECT hid, year, left(var, 5) AS var, avg(nullif(value, -8)) AS value FROM wwl GROUP BY 1, 2, 3"


def adoption(s, d):
    flagged = clean.yes_no_to_binary(clean.negatives_to_null(py(s, d), ["pv"]), ["pv"])
    return panel.ntile_by_year(flagged, "GrossIncome", 10, ["pid"])


ADOPTION = """SELECT *, ntile(10) OVER (PARTITION BY year ORDER BY GrossIncome, pid) AS decile FROM pyc"""


def rates(s, d):
    return aggregates.rate_by_group(adoption(s, d), ["year", "decile"], "pv")


RATES = f"""SELECT year, decile, count(*) AS obs, coalesce(sum(pv), 0) AS pv, 100.0 * coalesce(sum(pv), 0) / count(*) AS prob
    FROM ({ADOPTION}) GROUP BY 1, 2"""


def spells(s, d):
    """One row per household, year and spell with the year its panel started."""
    rolled = aggregates.household_rollup(
        harmonise(py(s, d)), ["year", *HOME], means=["income"], maxima=["pv"], minima={"PanelYear": "PanelYear"}
    )
    return rolled


HARMONISED = """SELECT pid, hid, year, YearMoved, income, LodgeEnglish, PowerCosts, age, GrossIncome,
    min(CASE WHEN state = 1 THEN year END) OVER spell AS PanelYear, max(state) OVER spell AS pv,
    garden, elevator FROM (SELECT *,
    CASE WHEN sum(pv) OVER (PARTITION BY pid, YearMoved ORDER BY year ROWS UNBOUNDED PRECEDING) > 0 THEN 1
        WHEN sum(pv) OVER (PARTITION BY pid, YearMoved ORDER BY year ROWS UNBOUNDED PRECEDING) = 0 THEN 0 END AS state
    FROM pyc) WINDOW spell AS (PARTITION BY pid, hid, YearMoved)"""
SPELLS = f"""SELECT year, hid, YearMoved, avg(income) AS income, max(pv) AS pv, min(PanelYear) AS PanelYear
    FROM ({HARMONISED}) WHERE pv IS NOT NULL GROUP BY 1, 2, 3"""

# Two-regressor least squares in closed form over columns y, a, b.
OLS_SUMS = """SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, regr_sxx(y, a) AS saa, regr_sxx(y, b) AS sbb,
    covar_pop(a, b) * count(*) AS sab, covar_pop(a, y) * count(*) AS say, covar_pop(b, y) * count(*) AS sby, regr_syy(y, a) AS syy"""
OLS = """SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ba,
    (sby * saa - say * sab) / (saa * sbb - sab * sab) AS bb FROM ({sums})"""
WEALTH_OLS = OLS.format(sums=f"{OLS_SUMS} FROM (SELECT GrossWealth AS y, income AS a, age AS b FROM hw)")


def wealth_fit(s, d):
    return regression.ols_linear(view(s, d, "hw"), "GrossWealth", ["income", "age"])


def coefs(s, d, fit):
    return regression.ols_coef_table(view(s, d, "hw"), [fit])


SPECS = dict(y="GrossWealth", xs=["income", "age"])
SQUARES = ["income", "age"]


def five_fits(df):
    """The specifications of the wealth model, from plain to two absorbed effects."""
    return [
        regression.ols_linear(df, **SPECS),
        regression.ols_quadratic(df, **SPECS, squares=SQUARES),
        regression.ols_controls(df, **SPECS, controls=["education"], squares=SQUARES),
        regression.ols_fixed_effect(df, SPECS["y"], [*SPECS["xs"], "education"], "year", SQUARES),
        regression.ols_two_way_fe(df, SPECS["y"], [*SPECS["xs"], "education"], "year", "hid", SQUARES),
    ]


COEFS = "spec:i term:s estimate:r4 std_error:r4"

AGGREGATE_CHECKS = [
    Check(
        "mean_over_imputations",
        "kind:s hid:i year:i name:s value:r4",
        lambda s, d: aggregates.mean_over_imputations(wealth_long(s, d), ["hid", "year", "var"])
        .select(F.lit("wealth").alias("kind"), "hid", "year", F.col("var").alias("name"), "value")
        .unionByName(
            aggregates.mean_over_imputations(concepts(s, d), ["hid", "concept"], skip_null=False).select(
                F.lit("consumption").alias("kind"), "hid", F.lit(2010).alias("year"), F.col("concept").alias("name"), "value"
            )
        ),
        f"""SELECT 'wealth' AS kind, hid, year, var AS name, value FROM ({MEANS_SQL}) UNION ALL
            SELECT 'consumption', hid, 2010, concept, CASE WHEN count(value) = count(*) THEN avg(value) END FROM (
            SELECT hid, value, CASE WHEN var LIKE 'consum%' THEN substr(var, 7, 1) ELSE left(var, 5) END AS code FROM cwl)
            JOIN lk_codebook USING (code) GROUP BY hid, concept""",
    ),
    Check(
        "household_rollup",
        "year:i YearMoved:i hid:i LodgeEnglish:s income:r4 PowerCosts:r4 age:i first:i",
        lambda s, d: aggregates.household_rollup(
            clean_py(s, d), ["year", *HOME], ["income", "PowerCosts"], ["age"], {"first": "education"}, "LodgeEnglish"
        ),
        """SELECT year, YearMoved, hid, LodgeEnglish, avg(income) AS income, avg(PowerCosts) AS PowerCosts, max(age) AS age,
            min(education) AS first FROM pyc GROUP BY 1, 2, 3, 4""",
    ),
    Check(
        "max_all_columns",
        "hid:i income:r2 owner:i age:i",
        lambda s, d: aggregates.max_all_columns(py(s, d).select("hid", "income", "owner", "age"), ["hid"]),
        "SELECT hid, max(income) AS income, max(owner) AS owner, max(age) AS age FROM py GROUP BY 1",
    ),
    Check(
        "sum_null_as_zero",
        "hid:i year:i value:r4",
        lambda s, d: aggregates.sum_null_as_zero(
            aggregates.mean_over_imputations(wealth_long(s, d), ["hid", "year", "var"]), ["hid", "year"]
        ),
        f"SELECT hid, year, coalesce(sum(value), 0) AS value FROM ({MEANS_SQL}) GROUP BY 1, 2",
    ),
    Check("rate_by_group", "year:i decile:i obs:i pv:i prob:r4", rates, RATES),
    Check(
        "mean_sd_by_group",
        "year:i IncAvg:r2 IncSd:r2 PowerAvg:r4 PowerSd:r4",
        lambda s, d: aggregates.mean_sd_by_group(clean_py(s, d), ["year"], {"income": "Inc", "PowerCosts": "Power"}),
        """SELECT year, avg(income) AS IncAvg, stddev_samp(income) AS IncSd, avg(PowerCosts) AS PowerAvg,
            stddev_samp(PowerCosts) AS PowerSd FROM pyc GROUP BY 1""",
    ),
    Check(
        "mean_of_rates",
        "year:i obs:i prob:r4",
        lambda s, d: aggregates.mean_of_rates(rates(s, d), ["year"]),
        f"SELECT year, sum(obs) AS obs, avg(prob) AS prob FROM ({RATES}) GROUP BY 1",
    ),
    Check(
        "ratio_of_means",
        "decile:i GrossDebts:r2 income:r2 share:r4",
        lambda s, d: aggregates.ratio_of_means(deciles(s, d), ["decile"], "GrossDebts", "income"),
        """SELECT decile, avg(GrossDebts) AS GrossDebts, avg(income) AS income, avg(GrossDebts) / avg(income) * 100 AS share
            FROM dec GROUP BY 1""",
    ),
    Check(
        "two_level_mean_share",
        "decile:i group:s income:r2 total:r4 share:r4",
        lambda s, d: aggregates.two_level_mean_share(
            consumers(s, d).select("decile", "group", F.col("concept").alias("var"), "value", "income"),
            ["decile", "group"],
        ),
        f"""SELECT decile, grp AS "group", min(income) AS income, sum(v) AS total, sum(v) / min(income) * 100 AS share FROM (
            SELECT decile, grp, concept, avg(value) AS v, avg(income) AS income FROM ({CONSUMERS}) GROUP BY 1, 2, 3)
            GROUP BY decile, grp, round(income, 6)""",
    ),
    Check(
        "duplicate_keys",
        "hid:i year:i count:i",
        lambda s, d: aggregates.duplicate_keys(py(s, d), KEY),
        "SELECT hid, year, count(*) AS count FROM py GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    Check(
        "panel_coverage",
        "observations:i persons:i households:i mean_observations:r4",
        lambda s, d: aggregates.panel_coverage(py(s, d)),
        """SELECT count(*) AS observations, count(DISTINCT pid) AS persons, count(DISTINCT hid) AS households,
            (SELECT avg(n) FROM (SELECT count(*) AS n FROM py GROUP BY pid)) AS mean_observations FROM py""",
    ),
    Check(
        "quantile_trim",
        "pid:i year:i income:r2",
        lambda s, d: aggregates.quantile_trim(clean_py(s, d), "income", 0.025, 0.975),
        """SELECT * FROM pyc WHERE income > (SELECT quantile_cont(income, 0.025) FROM pyc)
            AND income < (SELECT quantile_cont(income, 0.975) FROM pyc)""",
    ),
    Check(
        "quantile_trim_by_group",
        "hid:i year:i var:s value:r2",
        lambda s, d: aggregates.quantile_trim_by_group(
            wide_to_long(view(s, d, "hw"), KEY, ["GrossWealth", "GrossDebts", "NetWealth"]), ["var"], "value", 0.99
        ),
        """SELECT hid, year, 'GrossWealth' AS var, GrossWealth AS value FROM hw WHERE GrossWealth < (SELECT quantile_cont(GrossWealth, 0.99) FROM hw)
            UNION ALL SELECT hid, year, 'GrossDebts', GrossDebts FROM hw WHERE GrossDebts < (SELECT quantile_cont(GrossDebts, 0.99) FROM hw)
            UNION ALL SELECT hid, year, 'NetWealth', NetWealth FROM hw WHERE NetWealth < (SELECT quantile_cont(NetWealth, 0.99) FROM hw)""",
    ),
    Check(
        "histogram_fixed_width",
        "var:s bin:i count:i",
        lambda s, d: aggregates.histogram_fixed_width(
            wide_to_long(view(s, d, "hw"), KEY, ["GrossWealth", "NetWealth"]).withColumn("value", F.col("value") / 1000), ["var"], "value", 100
        ),
        """SELECT 'GrossWealth' AS var, floor(GrossWealth / 1000 / 100 + 0.5) AS bin, count(*) AS count FROM hw GROUP BY 2
            UNION ALL SELECT 'NetWealth', floor(NetWealth / 1000 / 100 + 0.5), count(*) FROM hw GROUP BY 2""",
    ),
    Check(
        "ecdf_at_points",
        "point:r2 share:r6",
        lambda s, d: aggregates.ecdf_at_points(clean_py(s, d), "income", BANDS),
        """SELECT p AS point, (SELECT count(*) FILTER (income <= p) / count(income) FROM pyc) AS share
            FROM (SELECT unnest([0, 50000, 100000, 150000, 200000, 300000, 400000]) AS p)""",
    ),
    Check(
        "first_non_null",
        "pid:i year:i first_income:r2",
        lambda s, d: aggregates.first_non_null(clean_py(s, d), HOME, "PowerCosts", ["year", "pid"], "first_income"),
        """SELECT pid, year, first_value(PowerCosts IGNORE NULLS) OVER (PARTITION BY hid, YearMoved ORDER BY year, pid
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_income FROM pyc""",
    ),
    Check(
        "distinct_values_rows",
        "hid:i YearMoved:i LodgeEnglish:s",
        lambda s, d: aggregates.distinct_values_rows(py(s, d), HOME, "LodgeEnglish"),
        "SELECT DISTINCT hid, YearMoved, LodgeEnglish FROM py",
    ),
    Check(
        "distinct_rows",
        "hid:i owner:i Npersons:i",
        lambda s, d: aggregates.distinct_rows(py(s, d), ["hid", "owner", "Npersons"]),
        "SELECT DISTINCT hid, owner, Npersons FROM py",
    ),
    Check(
        "log_density_by_group",
        "decile:i bin:i count:i density:r6",
        lambda s, d: aggregates.log_density_by_group(deciles(s, d), "NetWealth", ["decile"], 0.25),
        """SELECT decile, bin, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY decile) / 0.25::DOUBLE AS density FROM (
            SELECT decile, floor(ln(NetWealth) / 0.25::DOUBLE + 0.5) AS bin FROM dec WHERE NetWealth > 0) GROUP BY 1, 2""",
    ),
    Check(
        "log_kernel_density",
        "decile:i point:i x:r6 rows:i bandwidth:r6 density:r6",
        lambda s, d: density.log_kernel_density(deciles(s, d), ["decile"], "NetWealth", 64),
        # Every row at every place.
        """WITH l AS (SELECT decile, ln(NetWealth) AS v FROM dec WHERE NetWealth > 0),
        b AS (SELECT decile, count(*) AS rows, 0.9::DOUBLE * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34::DOUBLE)
            * count(*) ** -0.2::DOUBLE AS bandwidth FROM l GROUP BY 1),
        g AS (SELECT i AS point, lo + (hi - lo) * i / 63 AS x FROM (SELECT min(v) AS lo, max(v) AS hi FROM l), range(64) AS r(i))
        SELECT decile, point, x, rows, bandwidth, sum(exp(-0.5::DOUBLE * ((x - v) / bandwidth) ** 2)) / (sqrt(2 * pi()) * bandwidth * rows) AS density
        FROM b JOIN l USING (decile), g GROUP BY decile, point, x, rows, bandwidth""",
    ),
    Check(
        "ols_linear",
        COEFS,
        lambda s, d: coefs(s, d, wealth_fit(s, d)),
        f"""SELECT 1 AS spec, t AS term, CASE t WHEN 'income' THEN ba WHEN 'age' THEN bb ELSE my - ba * ma - bb * mb END AS estimate,
            sqrt((syy - ba * say - bb * sby) / (n - 3) * CASE t WHEN 'income' THEN sbb / (saa * sbb - sab * sab)
            WHEN 'age' THEN saa / (saa * sbb - sab * sab)
            ELSE 1.0 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / (saa * sbb - sab * sab) END) AS std_error
            FROM ({WEALTH_OLS}), (SELECT unnest(['(Intercept)', 'income', 'age']) AS t)""",
    ),
    Check(
        "ols_quadratic", COEFS,
        lambda s, d: coefs(s, d, regression.ols_quadratic(view(s, d, "hw"), **SPECS, squares=SQUARES)),
        coef_sql("SELECT * FROM hw", "GrossWealth", [*LINEAR, *SQUARED]),
    ),
    Check(
        "ols_controls", COEFS,
        lambda s, d: coefs(s, d, regression.ols_controls(view(s, d, "hw"), **SPECS, controls=["education"], squares=SQUARES)),
        coef_sql("SELECT * FROM hw", "GrossWealth", [*LINEAR, *EDUCATION, *SQUARED]),
    ),
    Check(
        "ols_fixed_effect",
        "spec:i term:s estimate:r4",
        lambda s, d: coefs(s, d, regression.ols_fixed_effect(view(s, d, "hw"), "GrossWealth", ["income", "age"], "year")),
        "SELECT 1 AS spec, t AS term, CASE t WHEN 'income' THEN ba ELSE bb END AS estimate FROM ("
        + OLS.format(
            sums=OLS_SUMS + """ FROM (SELECT GrossWealth - avg(GrossWealth) OVER (PARTITION BY year) AS y,
            income - avg(income) OVER (PARTITION BY year) AS a, age - avg(age) OVER (PARTITION BY year) AS b FROM hw)"""
        )
        + "), (SELECT unnest(['income', 'age']) AS t)",
    ),
    Check(
        "ols_two_way_fe", COEFS,
        lambda s, d: coefs(
            s, d, regression.ols_two_way_fe(view(s, d, "hw"), "GrossWealth", ["income", "age", "education"], "year", "hid", SQUARES)
        ),
        coef_sql("SELECT * FROM hw", "GrossWealth", [*LINEAR, *EDUCATION, *SQUARED], "hid", "year"),
    ),
    Check(
        "ols_coef_table",
        "spec:i term:s estimate:r4",
        lambda s, d: regression.ols_coef_table(
            view(s, d, "hw"), [wealth_fit(s, d), regression.ols_linear(view(s, d, "hw"), "NetWealth", ["income", "age"])]
        ),
        " UNION ALL ".join(
            f"""SELECT {i} AS spec, t AS term, CASE t WHEN 'income' THEN ba WHEN 'age' THEN bb ELSE my - ba * ma - bb * mb END AS estimate
            FROM ({OLS.format(sums=f"{OLS_SUMS} FROM (SELECT {y} AS y, income AS a, age AS b FROM hw)")}),
            (SELECT unnest(['(Intercept)', 'income', 'age']) AS t)"""
            for i, y in [(1, "GrossWealth"), (2, "NetWealth")]
        ),
    ),
    Check(
        "ols_clustered_errors",
        "spec:i term:s estimate:r4 std_error:r4",
        lambda s, d: regression.ols_coef_table(
            view(s, d, "hw"),
            [
                regression.ols_fixed_effect(view(s, d, "hw"), "GrossWealth", ["income", "age"], "year", cluster="year"),
                regression.ols_fixed_effect(view(s, d, "hw"), "GrossWealth", ["income", "age"], "year", cluster="hid"),
            ],
        ),
        f"""WITH d AS (SELECT hid, year, GrossWealth - avg(GrossWealth) OVER w AS y, income - avg(income) OVER w AS a, age - avg(age) OVER w AS b
            FROM hw WHERE GrossWealth IS NOT NULL AND income IS NOT NULL AND age IS NOT NULL WINDOW w AS (PARTITION BY year)),
        o AS ({OLS.format(sums=OLS_SUMS + " FROM d")}),
        e AS (SELECT d.*, y - ba * a - bb * b AS e FROM d, o),
        scores AS (
            SELECT 1 AS spec, year AS g, sum(a * e) AS ga, sum(b * e) AS gb FROM e GROUP BY year
            UNION ALL SELECT 2, hid, sum(a * e), sum(b * e) FROM e GROUP BY hid),
        meat AS (SELECT spec, count(*) AS g, sum(ga * ga) AS aa, sum(ga * gb) AS ab, sum(gb * gb) AS bb FROM scores GROUP BY spec),
        v AS (SELECT spec, o.ba, o.bb, saa * sbb - sab * sab AS det,
            g / (g - 1.0) * (n - 1.0) / (n - 2 - CASE spec WHEN 1 THEN 1 ELSE (SELECT count(DISTINCT year) FROM d) END) AS factor,
            sbb * sbb * m.aa - 2 * sbb * sab * m.ab + sab * sab * m.bb AS va, sab * sab * m.aa - 2 * sab * saa * m.ab + saa * saa * m.bb AS vb
            FROM meat AS m, o)
        SELECT spec, t AS term, CASE t WHEN 'income' THEN ba ELSE bb END AS estimate,
            sqrt(CASE t WHEN 'income' THEN va ELSE vb END * factor) / det AS std_error
        FROM v, (SELECT unnest(['income', 'age']) AS t)""",
    ),
    Check(
        "ols_fitted",
        "hid:i year:i Model1:r1 Model2:r1",
        lambda s, d: regression.ols_fitted(
            view(s, d, "hw"),
            [wealth_fit(s, d), regression.ols_fixed_effect(view(s, d, "hw"), "GrossWealth", ["income", "age"], "year")],
        ),
        f"""SELECT hid, year, o.my + o.ba * (income - o.ma) + o.bb * (age - o.mb) AS Model1,
            avg(GrossWealth) OVER (PARTITION BY year) + w.ba * (income - avg(income) OVER (PARTITION BY year))
            + w.bb * (age - avg(age) OVER (PARTITION BY year)) AS Model2 FROM hw, ({WEALTH_OLS}) AS o, ("""
        + OLS.format(
            sums=OLS_SUMS + """ FROM (SELECT GrossWealth - avg(GrossWealth) OVER (PARTITION BY year) AS y,
            income - avg(income) OVER (PARTITION BY year) AS a, age - avg(age) OVER (PARTITION BY year) AS b FROM hw)"""
        )
        + ") AS w",
    ),
    Check(
        "mean_positive_only",
        "year:i debt:r4",
        lambda s, d: aggregates.mean_positive_only(view(s, d, "hs"), ["year"], "debt", "debt"),
        "SELECT year, coalesce(avg(debt) FILTER (debt > 0), 0) AS debt FROM hs GROUP BY 1",
    ),
    Check(
        "guarded_share",
        "attitude:i share:r6",
        lambda s, d: aggregates.guarded_share(view(s, d, "hs"), ["attitude"], "pv", "house", "share"),
        "SELECT attitude, CASE WHEN sum(house) > 0 THEN sum(pv) / sum(house) ELSE 0 END AS share FROM hs GROUP BY 1",
    ),
]

YEARLY = "SELECT run, year, avg(pv) AS rate, avg(house) AS houses FROM hs GROUP BY 1, 2"

WINDOW_CHECKS = [
    Check("ntile_global", "hid:i year:i decile:i", deciles, "SELECT hid, year, decile FROM dec"),
    Check(
        "ntile_by_year",
        "pid:i year:i decile:i",
        lambda s, d: panel.ntile_by_year(clean_py(s, d), "income", 10, ["hid", "pid"]),
        """SELECT pid, year, CASE WHEN income IS NOT NULL THEN ntile(10) OVER (PARTITION BY year, income IS NULL ORDER BY income, hid, pid) END AS decile FROM pyc""",
    ),
    Check(
        "quantile_cut_groups",
        "pid:i year:i group:i",
        lambda s, d: panel.quantile_cut_groups(clean_py(s, d), "income", 10),
        """SELECT pid, year, CASE WHEN income IS NOT NULL THEN 1 + len(list_filter(q, lambda c: c <= income)) END AS "group"
            FROM pyc, (SELECT quantile_cont(income, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM pyc)""",
    ),
    Check(
        "fixed_bands",
        "pid:i year:i band:i",
        lambda s, d: panel.fixed_bands(clean_py(s, d), "income", BANDS),
        """SELECT pid, year, CASE WHEN income IS NOT NULL THEN len(list_filter([0, 50000, 100000, 150000, 200000, 300000, 400000],
            lambda c: c <= income)) END AS band FROM pyc""",
    ),
    Check(
        "rank_position_groups",
        "hid:i decile:i percentile:i",
        lambda s, d: panel.rank_position_groups(
            panel.rank_position_groups(view(s, d, "hs"), "income", 10, name="decile"), "income", 100, name="percentile"
        ),
        """SELECT hid, len(list_filter(list_transform(range(1, 10), lambda i: sorted[CAST(round_even(i * (n + 1) / 10.0 - 1, 0) AS BIGINT) + 1]),
            lambda c: c < income)) AS decile, len(list_filter(list_transform(range(1, 100),
            lambda i: sorted[CAST(round_even(i * (n + 1) / 100.0 - 1, 0) AS BIGINT) + 1]), lambda c: c < income)) AS percentile
            FROM hs, (SELECT list(income ORDER BY income) AS sorted, count(*) AS n FROM hs)""",
    ),
    Check(
        "cumulative_flag",
        "pid:i year:i pv:i",
        lambda s, d: panel.cumulative_flag(
            clean.yes_no_to_binary(clean.negatives_to_null(py(s, d), ["pv"]), ["pv"]), ["pid", "YearMoved"], "year", "pv"
        ),
        """SELECT pid, year, CASE WHEN sum(pv) OVER w > 0 THEN 1 WHEN sum(pv) OVER w = 0 THEN 0 END AS pv FROM pyc
            WINDOW w AS (PARTITION BY pid, YearMoved ORDER BY year ROWS UNBOUNDED PRECEDING)""",
    ),
    Check(
        "spell_max_broadcast",
        "pid:i year:i PowerCosts:i",
        lambda s, d: panel.spell_max_broadcast(clean_py(s, d), SPELL, "PowerCosts"),
        """SELECT * FROM (SELECT pid, year, max(PowerCosts) OVER (PARTITION BY pid, hid, YearMoved) AS PowerCosts FROM pyc)
            WHERE PowerCosts IS NOT NULL""",
    ),
    Check(
        "share_of_group",
        "hid:i var:s total:r2 share:r4",
        lambda s, d: panel.share_of_group(consumption_long(s, d), ["hid"], "value"),
        "SELECT hid, var, sum(value) OVER (PARTITION BY hid) AS total, value / sum(value) OVER (PARTITION BY hid) * 100 AS share FROM cwl",
    ),
    Check(
        "balanced_panel",
        "hid:i year:i income:r2",
        lambda s, d: panel.balanced_panel(view(s, d, "hw"), "hid", 2005, 2011),
        "SELECT * FROM hw WHERE year BETWEEN 2005 AND 2011 QUALIFY count(*) OVER (PARTITION BY hid) = 7",
    ),
    Check(
        "group_mean_impute",
        "pid:i year:i PowerCosts:i",
        lambda s, d: panel.group_mean_impute(clean_py(s, d), HOME, "PowerCosts"),
        """SELECT pid, year, coalesce(PowerCosts, round_even(avg(PowerCosts) OVER g, 0)) AS PowerCosts FROM pyc
            WINDOW g AS (PARTITION BY hid, YearMoved) QUALIFY avg(PowerCosts) OVER g IS NOT NULL""",
    ),
    Check(
        "spell_age",
        "hid:i year:i YearMoved:i PanelAge:i pv:i",
        lambda s, d: panel.spell_age(spells(s, d), 2009),
        f"""SELECT hid, year, YearMoved, CASE WHEN PanelYear > 2009 THEN NULL WHEN year = 2009 THEN 2009 - PanelYear END AS PanelAge,
            CASE WHEN PanelYear > 2009 THEN 0 ELSE pv END AS pv FROM ({SPELLS})""",
    ),
    Check(
        "period_change",
        "run:s year:i rate:r4 Changerate:r4 Changehouses:r4",
        lambda s, d: panel.period_change(
            view(s, d, "hs").groupBy("run", "year").agg(F.avg("pv").alias("rate"), F.avg("house").alias("houses")),
            ["run"], "year", ["rate", "houses"],
        ),
        f"""SELECT run, year, rate, coalesce(rate - lag(rate) OVER w, 0) AS Changerate, coalesce(houses - lag(houses) OVER w, 0) AS Changehouses
            FROM ({YEARLY}) WINDOW w AS (PARTITION BY run ORDER BY year)""",
    ),
    Check(
        "expected_vs_actual",
        "series:s t:i price:r4 expected_before:r4",
        lambda s, d: panel.expected_vs_actual(
            panel.earlier_values(view(s, d, "ps"), ["series"], "t", {"before": ("price", 1)}).withColumn(
                "expected", F.col("price") + (F.col("price") - F.col("before")) / 2
            ),
            ["series"], "t", "price", "expected",
        ),
        """SELECT p.series, p.t, p.price, q.price + (q.price - r.price) / 2 AS expected_before FROM ps AS p
            JOIN ps AS q ON q.series = p.series AND q.t = p.t - 1 LEFT JOIN ps AS r ON r.series = p.series AND r.t = p.t - 2""",
    ),
    Check(
        "order_groups_by_median",
        "concept:s median:r4 position:i",
        lambda s, d: panel.order_groups_by_median(concepts(s, d), "concept", "value", desc=True),
        """SELECT *, dense_rank() OVER (ORDER BY median DESC) AS position FROM (SELECT concept, median(value) AS median FROM (
            SELECT value, CASE WHEN var LIKE 'consum%' THEN substr(var, 7, 1) ELSE left(var, 5) END AS code FROM cwl)
            JOIN lk_codebook USING (code) GROUP BY 1)""",
    ),
    Check(
        "sort_rows",
        "hid:i var:s value:r4",
        lambda s, d: panel.sort_rows(consumption_long(s, d), ["hid", "var"]),
        "SELECT * FROM cwl ORDER BY hid, var",
    ),
    Check(
        "period_slice",
        "run:s year:i rate:r4",
        lambda s, d: panel.period_slice(
            view(s, d, "hs").groupBy("run", "year").agg(F.avg("pv").alias("rate")), 2019, 2022
        ),
        f"SELECT * FROM ({YEARLY}) WHERE year BETWEEN 2019 AND 2022",
    ),
]

CHECKS = [*AGGREGATE_CHECKS, *WINDOW_CHECKS]
