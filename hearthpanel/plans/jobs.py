"""The pipeline from survey waves to the descriptive tables.

Building a job's plan may already run Spark jobs: statistics of groups, rank limits and fits are written
or collected before the rows that need them are read again.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthpanel.operators import aggregates, clean, joins, panel, regression, reshape
from hearthpanel.operators.keyed import attach, first_known, group_stats
from hearthpanel.operators.regression import Fit
from hearthpanel.sources.files import codebook_select_rename, scan_union_waves
from hearthpanel.workspace import materialize

SPELL = ["pid", "hid", "YearMoved"]
HOME = ["hid", "YearMoved"]


# --- files ------------------------------------------------------------------------------------


def survey_file(spark: SparkSession, pattern: str, codebook: Mapping[str, str], from_year: int) -> DataFrame:
    """Waves of a survey file, harmonised by its codebook, from a year on."""
    return clean.filter_year_range(codebook_select_rename(scan_union_waves(spark, pattern), codebook), from_year)


def job_person_file(spark: SparkSession, pattern: str, codebook: Mapping[str, str], from_year: int = 2005) -> DataFrame:
    return survey_file(spark, pattern, codebook, from_year)


def job_household_file(spark: SparkSession, pattern: str, codebook: Mapping[str, str], from_year: int = 2005) -> DataFrame:
    return survey_file(spark, pattern, codebook, from_year)


def _code(column: str, stem: str = "consum") -> str:
    """Questionnaire code of a consumption column, as ``clean.concept_code`` gives it for rows."""
    return re.sub(f"b|{stem}|c|d|e", "", column) if stem in column else re.sub("_.*", "", column)


def _entries(codebook: DataFrame, key: str, value: str, wanted: set[str]) -> dict[str, str]:
    """The entries of a codebook for the columns of a table, of which there are few; unique by key."""
    rows = codebook.filter(F.col(key).isin(sorted(wanted))).groupBy(key)
    found = rows.agg(F.min(value).alias("one"), F.count_distinct(value).alias("n")).collect()
    if twice := sorted(r[key] for r in found if r["n"] > 1):
        raise ValueError(f"codebook entries with several meanings: {twice}")
    return {r[key]: r["one"] for r in found}


def job_consumption(
    wide: DataFrame, codebook: DataFrame, panel_rows: DataFrame, concepts: Sequence[str], year: int = 2010
) -> DataFrame:
    """Household x concept consumption per year in thousands, with its total.

    ``codebook`` has code and concept; ``panel_rows`` has hid, year, income and owner. Both sides
    are brought to one row per household before they meet; the columns of a concept are averaged
    in place instead of being melted, grouped and spread again.
    """
    kept = clean.select_name_contains(wide, ["f", "_a", *[f"{i}a" for i in range(1, 18)]], negate=True)
    book = _entries(codebook, "code", "concept", {_code(c) for c in kept.columns if c != "hid"})
    if missing := set(book.values()) - set(concepts):
        raise ValueError(f"columns of concepts that are not asked for: {sorted(missing)}")
    status = aggregates.max_all_columns(clean.filter_year_range(panel_rows, year, year).select("hid", "income", "owner"), ["hid"])

    columns = [c for c in kept.columns if c != "hid" and _code(c) in book]
    monthly = kept.withColumns({c: F.col(c) / 12 for c in columns if re.search("oheat|oelectr|outil", c)})
    totals = monthly.groupBy("hid").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_sum_{c}") for c in columns],
        *[F.count(c).alias(f"_known_{c}") for c in columns],
    )
    joined = joins.natural_left_join(totals, status, ["hid"])
    owns = F.coalesce(F.col("owner") == 1, F.lit(False))

    def used(column: str, prefix: str) -> Column:
        """0 where the household was not asked for this variable in its role."""
        value = F.coalesce(F.col(f"{prefix}{column}"), F.lit(0))
        if re.search("rheat|reletr", column):
            return F.when(owns, 0).otherwise(value)
        if re.search("oheat|oeletr", column):
            return F.when(owns, value).otherwise(0)
        return value

    def yearly(concept: str) -> Column:
        mine = [c for c in columns if book[_code(c)] == concept]
        if not mine:
            return F.lit(None).cast("double")
        known = reduce(add, [used(c, "_known_") for c in mine])
        asked = reduce(add, [used(c, "_asked_") for c in mine])
        total = reduce(add, [used(c, "_sum_") for c in mine])
        # Nothing known of a concept that was not asked in the household's role.
        return F.when(known == asked, F.try_divide(total, known) * 12 / 1000)

    joined = joined.withColumns({f"_asked_{c}": F.col("_rows") for c in columns})
    out = joined.select("hid", "income", "owner", *[yearly(c).alias(c) for c in concepts])
    return clean.row_total(out, ["hid", "income", "owner"])


def job_wealth(
    wide: DataFrame, codebook: DataFrame, panel_rows: DataFrame, components: Sequence[str],
    families: Sequence[str], years: Sequence[int] = (2002, 2007, 2012, 2017),
) -> DataFrame:
    """Household-year wealth components, averaged over the imputations.

    A column belongs to a family by its first four characters and is used once. ``codebook`` maps
    the five-character variable to its component. One grouping serves all families.
    """
    book = _entries(codebook, "var", "VarText", {c[:5] for c in wide.columns})
    variables: dict[str, list[str]] = {}
    for c in wide.columns:
        if c[:4] in families and c[:5] in book:
            variables.setdefault(c[:5], []).append(c)
    columns = [c for cols in variables.values() for c in cols]
    known = wide.select(
        "hid", F.col("syear").alias("year"), *[F.nullif(F.col(c).cast("double"), F.lit(-8.0)).alias(c) for c in columns]
    )
    means = aggregates.mean_over_imputation_columns(known, ["hid", "year"], variables)

    def component(name: str) -> Column:
        mine = [v for v in variables if book[v] == name]
        return reduce(add, [F.coalesce(F.col(v), F.lit(0.0)) for v in mine]) if mine else F.lit(None).cast("double")

    spread = means.select("hid", "year", *[component(c).alias(c) for c in components])
    status = clean.filter_year_in(panel_rows, years).select("hid", "income", "age")
    joined = joins.natural_left_join(spread, aggregates.max_all_columns(status, ["hid"]), ["hid"])
    return joined.select("hid", "year", "income", "age", *components)


# --- person panel -----------------------------------------------------------------------------


# The survey's columns by how they are cleaned. Columns a table lacks are skipped.
UNUSED = (
    "sample", "MaritalStatus", "region", "AcqMeans", "HouseCondition", "HouseholdType", "subsidies", "year_moved",
)
AMOUNTS = (
    "age", "Npersons", "Nkids", "education", "employment", "income", "GrossIncome", "NewestConstDate", "OldestConstDate",
    "PowerCosts", "OtherUtilityCosts", "WarmWaterCosts", "YearMoved", "FreeRent", "HouseSize", "GasCosts",
)
ANSWERS = (
    "ac", "basement", "FloorHeating", "garden", "CentralFloorHeating", "ThermalInsulation", "elevator", "DoubleGlazing",
    "AlternativeEnergy", "pv", "balcony", "boiler",
)
LABELLED = ("sex", "head", "owner", "occupation")


def harmonise(
    rows: DataFrame,
    unused: Sequence[str] = UNUSED,
    amounts: Sequence[str] = AMOUNTS,
    answers: Sequence[str] = ANSWERS,
    labelled: Sequence[str] = LABELLED,
) -> DataFrame:
    """Clean a joined person-year table and turn purchases into ownership by dwelling spell.

    Negative codes of ``amounts``, ``answers`` and ``labelled`` columns become null, answers 0 or 1.
    Two groupings carry all spell logic: the purchase state per (pid, YearMoved), then owner,
    dwelling type, first year and ownership per (pid, hid, YearMoved). The cleaned rows are written
    once; both groupings and the result read them.
    """
    present = lambda names: [c for c in names if c in rows.columns]
    df = clean.drop_columns(rows, present(unused))
    df = clean.negatives_to_null(df, present([*amounts, *answers, *labelled]))
    df = materialize(clean.yes_no_to_binary(df, present(answers)), "persons")
    for amount in ("income", "GrossIncome"):
        df = clean.scale_units(df, amount, 1 / 1000)
    df = clean.text_null_token(df, "LodgeEnglish")
    df = clean.rule_impute(df, "LodgeEnglish", [(F.col("garden") == 1, "House"), (F.col("elevator") == 1, "Flat")])
    df = clean.classify_by_pattern(df, "LodgeEnglish", {"Flats": "Flats|Flat"}, "House", "lodge")
    df = panel.cumulative_flag(df, ["pid", "YearMoved"], "year", "pv")
    df = group_stats(
        df,
        SPELL,
        owner=first_known("owner", ["year"]),
        lodge=first_known("lodge", ["year"]),
        PanelYear=F.min(F.when(F.col("pv") == 1, F.col("year"))),
        pv=F.max("pv"),
    )
    df = df.filter(F.col("pv").isNotNull())
    return clean.collapse_categories(df, "owner", [2, 3, 4, 5], 0).drop("LodgeEnglish")


def job_person_panel(person: DataFrame, household: DataFrame, lodge: DataFrame) -> DataFrame:
    """The three files joined on what they share, then harmonised."""
    return harmonise(joins.chain_left_join([person, household, lodge]))


def job_income_brackets(panel_rows: DataFrame, year: int, cuts: Sequence[float], factor: float = 1.0) -> DataFrame:
    """Income brackets with the percentiles of their limits, rounded half to even."""
    rows = clean.filter_year_range(panel_rows, year, year)
    incomes = aggregates.mean_over_imputations(rows, ["year", "hid"], "income")
    incomes = materialize(clean.drop_null_rows(clean.scale_units(incomes, "income", factor), ["income"]), "incomes")
    banded = clean.parse_interval_label(panel.fixed_bands(incomes, "income", cuts, label="amt"), "amt")
    brackets = banded.select("band", "amt", "LowAmt", "HighAmt").distinct()
    # Fewer than a handful of brackets, so their limits may come to the driver.
    limits = sorted({v for r in brackets.select("LowAmt", "HighAmt").collect() for v in r})
    shares = aggregates.ecdf_at_points(incomes, "income", limits).withColumn("per", F.bround(F.col("share") * 100, 0))
    low = shares.select(F.col("point").alias("LowAmt"), F.col("per").alias("LowPer"))
    high = shares.select(F.col("point").alias("HighAmt"), F.col("per").alias("HighPer"))
    return brackets.join(low, "LowAmt").join(high, "HighAmt").select("band", "amt", "LowAmt", "HighAmt", "LowPer", "HighPer")


# --- wealth regression ------------------------------------------------------------------------


def wealth_fits(df: DataFrame, y: str = "GrossWealth") -> list[Fit]:
    """Linear, quadratic, with education, with year effects, with year and household effects; the errors of
    the last two are clustered by year, the first absorbed effect."""
    xs, squares = ["income", "age"], ["income", "age"]
    return [
        regression.ols_linear(df, y, xs),
        regression.ols_quadratic(df, y, xs, squares),
        regression.ols_controls(df, y, xs, ["education"], squares),
        regression.ols_fixed_effect(df, y, [*xs, "education"], "year", squares, "year"),
        regression.ols_two_way_fe(df, y, [*xs, "education"], "year", "hid", squares, "year"),
    ]


def regression_rows(wealth: DataFrame, panel_rows: DataFrame, trim: float = 0.99) -> DataFrame:
    """Wealth with the household's education, without the top of the distribution."""
    people = aggregates.household_rollup(panel_rows, ["hid", "year"], means=["Npersons"], maxima=["education"])
    people = clean.drop_null_rows(clean.infinite_to_null(people, ["Npersons"]), ["education", "Npersons"])
    joined = joins.natural_left_join(wealth.drop("education"), people, ["hid", "year"])
    trimmed = aggregates.quantile_trim(joined, "GrossWealth", hi=trim)
    return clean.drop_null_rows(trimmed, ["income", "age", "education"]).select(
        "hid", "year", "income", "age", "GrossWealth", "education"
    )


def job_wealth_regression(wealth: DataFrame, panel_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coefficient table of five specifications, and the rows with their fitted values."""
    rows = materialize(regression_rows(wealth, panel_rows), "rows")
    fits = wealth_fits(rows)
    return regression.ols_coef_table(rows, fits), regression.ols_fitted(rows, fits)


def wealth_estimates(coefs: DataFrame) -> DataFrame:
    """One row with ``<term>_est`` and ``<term>_se`` of the first specification."""
    first = coefs.filter("spec = 1")
    wide = []
    for column, suffix in (("estimate", "est"), ("std_error", "se")):
        named = clean.stat_name(first, "term", suffix, "name")
        names = [f"{t}_{suffix}" for t in ("Intercept", "age", "income")]
        wide.append(reshape.long_to_wide(named, ["spec"], "name", column, names))
    return reshape.bind_columns_by_key(wide[0], wide[1], ["spec"]).drop("spec")


def job_estimate_table(estimates: DataFrame) -> DataFrame:
    """One-row estimates -> one row per term with its estimate and standard error."""
    long = clean.split_stat_name(reshape.wide_to_long(estimates, []), "var", "term", "stat")
    return reshape.long_to_wide(long, ["term"], "stat", "value", ["est", "se"])


def job_fitted_histogram(
    fitted: DataFrame, models: Sequence[str], trim: float = 0.99, unit: float = 1000, width: float = 100
) -> DataFrame:
    """Histogram of the fitted values of each model below a quantile."""
    long = reshape.wide_to_long(fitted, ["hid", "year"], models)
    below = aggregates.quantile_trim_by_group(long, ["var"], "value", trim)
    return aggregates.histogram_fixed_width(clean.scale_units(below, "value", 1 / unit), ["var"], "value", width)


# --- household panel and its tables -----------------------------------------------------------


def household_spells(panel_rows: DataFrame, ref_year: int) -> DataFrame:
    """Harmonised persons -> one row per household, dwelling spell and year."""
    rolled = panel_rows.groupBy("year", *HOME).agg(
        F.avg("income").alias("income"),
        # An unknown age may be the highest.
        F.when(F.count("age") == F.count(F.lit(1)), F.max("age")).alias("age"),
        first_known("lodge", ["pid"]).alias("HouseType"),
        F.avg("PowerCosts").alias("PowerCosts"),
        F.max("pv").alias("pv"),
        F.min("PanelYear").alias("PanelYear"),
        F.avg("GrossIncome").alias("GrossIncome"),
    )
    # Rolled up there is one row per survey year, so a window sees no more rows than years.
    by_year = Window.partitionBy(*HOME).orderBy("year").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spells = rolled.withColumns(
        {"HouseType": F.first("HouseType", ignorenulls=True).over(by_year), "_power": F.avg("PowerCosts").over(by_year)}
    )
    complete = clean.drop_null_rows(spells, ["HouseType", "_power"])
    filled = complete.withColumn("PowerCosts", F.coalesce("PowerCosts", F.bround("_power", 0)) * 12).drop("_power")
    # One row per household, year and spell here, so age and flag need no further grouping.
    late = F.coalesce(F.col("PanelYear") > ref_year, F.lit(False))
    age = F.when((F.col("year") == ref_year) & ~late, ref_year - F.col("PanelYear"))
    return filled.withColumns({"PanelAge": age, "pv": F.when(late, 0).otherwise(F.col("pv"))}).select(
        "hid", "year", "YearMoved", "GrossIncome", "income", "age", "HouseType", "PowerCosts", "pv", "PanelAge"
    )


def job_household_panel(panel_rows: DataFrame, wealth: DataFrame, estimates: DataFrame, ref_year: int = 2017) -> DataFrame:
    """Household spells with wealth and the estimates of the wealth regression as constants."""
    spells = household_spells(panel_rows, ref_year)
    worth = wealth.select("hid", "year", "GrossWealth", "NetWealth", "GrossDebts")
    joined = joins.natural_left_join(spells, worth, ["hid", "year"])
    names = {f"{t}_{s}": f"{t.lower()}_wealth_{s}" for t in ("age", "income", "Intercept") for s in ("est", "se")}
    return joins.broadcast_scalars(joined, clean.rename_in_select(estimates, names))


def job_consumption_deciles(consumption: DataFrame) -> DataFrame:
    """Income, consumption and the consumption share by income decile, means and deviations."""
    rows = clean.scale_units(consumption.select("hid", "income", "total"), "income", 1 / 1000)
    grouped = panel.ntile_global(rows, "income", 10, ["hid"], "IncomeGroup")
    shares = clean.ratio_percent(grouped, "total", "income", "ConShare")
    out = aggregates.mean_sd_by_group(shares, ["IncomeGroup"], {"income": "Inc", "total": "Con", "ConShare": "ConShare"})
    return out.drop("IncSd")


def job_power_deciles(panel_rows: DataFrame, years: Sequence[int]) -> DataFrame:
    """Income and yearly power cost by income band and year, without both income tails."""
    rows = clean.filter_year_in(panel_rows, years).select("year", "hid", "income", "PowerCosts")
    best = materialize(clean.drop_null_rows(aggregates.max_all_columns(rows, ["year", "hid"]), ["income"]), "best")
    banded = panel.quantile_cut_groups(best, "income", 10, "IncomeGroup")
    middle = aggregates.quantile_trim(banded, "income", 0.025, 0.975)
    out = aggregates.mean_sd_by_group(middle, ["IncomeGroup", "year"], {"income": "Inc", "PowerCosts": "PowerCost"})
    return out.withColumns({c: F.col(c) * 12 for c in ("PowerCostAvg", "PowerCostSd")})


def job_adoption_rate(spells: DataFrame) -> DataFrame:
    """Ownership rate by income decile and year, with the unweighted mean of each year."""
    # A row without income has no decile; dropped first, the test reaches the scan.
    rows = clean.drop_null_rows(spells.select("year", "hid", "YearMoved", "pv", "income"), ["income"])
    grouped = panel.ntile_by_year(rows, "income", 10, ["hid", "YearMoved"], name="IncomeGroup")
    rates = aggregates.rate_by_group(grouped, ["year", "IncomeGroup"], "pv")
    # Ten rows per year.
    year = Window.partitionBy("year")
    return rates.withColumns({"year_obs": F.sum("obs").over(year), "year_prob": F.avg("prob").over(year)})


def job_adoption_rate_balanced(spells: DataFrame, lo: int, hi: int) -> DataFrame:
    """The same for households with one row for every year of a range."""
    return job_adoption_rate(panel.balanced_panel(spells, "hid", lo, hi))


def _consumption_groups(consumption: DataFrame, codebook: DataFrame) -> DataFrame:
    """Long consumption with its group and the household's income decile."""
    grouped = panel.ntile_global(consumption.drop("total", "owner"), "income", 10, ["hid"])
    long = reshape.wide_to_long(grouped, ["hid", "income", "decile"])
    return joins.codebook_join(long, codebook.select("concept", "group").distinct(), "var", "concept")


def job_consumption_by_group(consumption: DataFrame, codebook: DataFrame) -> DataFrame:
    """Mean consumption by decile and group, decile total, share and display position."""
    long = _consumption_groups(consumption, codebook)
    means = aggregates.mean_over_imputations(long, ["decile", "group"], skip_null=False)
    shares = panel.share_of_group(means, ["decile"], "value")
    return attach(shares, panel.order_groups_by_median(shares, "group", "share").drop("median"), ["group"])


def job_consumption_income_matrix(consumption: DataFrame, codebook: DataFrame) -> DataFrame:
    """Consumption groups in percent of the decile's income, with display position."""
    long = _consumption_groups(consumption, codebook)
    shares = aggregates.two_level_mean_share(long, ["decile", "group"])
    order = panel.order_groups_by_median(shares, "group", "total", desc=True).drop("median")
    return attach(shares, order, ["group"])


_MEASURES = {"GrossWealth": "A) Gross Wealth", "GrossDebts": "B) Gross Debt", "NetWealth": "C) Net Wealth"}


def _wealth_means(grouped: DataFrame, year: int) -> DataFrame:
    rows = clean.rename_in_select(clean.filter_year_range(grouped, year, year), {"decile": "decile", **_MEASURES})
    return aggregates.mean_over_imputations(reshape.wide_to_long(rows, ["decile"]), ["decile", "var"], skip_null=False)


def job_wealth_by_income(wealth: DataFrame, year: int) -> DataFrame:
    """Wealth measures of a year by income decile, the deciles taken over all years."""
    return _wealth_means(panel.ntile_global(wealth, "income", 10, ["hid", "year"]), year)


def job_wealth_by_age(wealth: DataFrame, year: int) -> DataFrame:
    """Wealth measures of a year by ten-year age band."""
    return _wealth_means(panel.fixed_bands(wealth, "age", range(10, 90, 10), "decile"), year)


def job_wealth_composition(wealth: DataFrame, year: int, components: Mapping[str, str]) -> DataFrame:
    """Value in thousands and share of each wealth component by income decile, as facets."""
    grouped = clean.filter_year_range(panel.ntile_global(wealth, "income", 10, ["hid", "year"]), year, year)
    long = reshape.wide_to_long(grouped, ["hid", "decile"], list(components))
    means = aggregates.mean_over_imputations(long, ["decile", "var"], skip_null=False)
    shares = panel.share_of_group(clean.scale_units(means, "value", 1 / 1000), ["decile"], "value")
    named = clean.recode_labels(shares, "var", components, "group")
    facets = reshape.metrics_to_facets(named, ["decile", "var", "group"], ["value", "share"])
    labels = {"value": "a) Value in Ths. Euros", "share": "b) Percentage of Net Wealth"}
    facets = clean.recode_labels(facets, "type", labels)
    return attach(facets, panel.order_groups_by_median(facets, "group", "value").drop("median"), ["group"])
