"""Aggregations and distribution statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthpanel.operators.clean import log_column
from hearthpanel.operators.keyed import attach, first_known, group_stats
from hearthpanel.operators.ranking import with_quantiles


def mean_over_imputations(df: DataFrame, keys: Sequence[str], value: str = "value", skip_null: bool = True) -> DataFrame:
    """Mean of the imputed values; without ``skip_null`` one missing value makes the mean null."""
    mean = F.avg(value)
    if not skip_null:
        mean = F.when(F.count(value) == F.count(F.lit(1)), mean)
    return df.groupBy(*keys).agg(mean.alias(value))


def mean_over_imputation_columns(
    df: DataFrame, keys: Sequence[str], variables: Mapping[str, Sequence[str]], skip_null: bool = True
) -> DataFrame:
    """As ``mean_over_imputations`` for a wide table: variable -> its imputation columns.

    The columns of a row are added up in place, so nothing is melted and one grouping suffices.
    """
    def mean(cols: Sequence[str]) -> Column:
        known = reduce(add, [F.count(c) for c in cols])
        total = reduce(add, [F.coalesce(F.sum(c), F.lit(0.0)) for c in cols])
        wanted = known > 0 if skip_null else known == len(cols) * F.count(F.lit(1))
        return F.when(wanted, total / known)

    return df.groupBy(*keys).agg(*[mean(cols).alias(name) for name, cols in variables.items()])


def household_rollup(
    df: DataFrame,
    keys: Sequence[str],
    means: Sequence[str] = (),
    maxima: Sequence[str] = (),
    minima: Mapping[str, str] | None = None,
    distinct: str | None = None,
) -> DataFrame:
    """Persons to households: means, maxima and minima (new name -> column) per key.

    With ``distinct`` there is one row per key and distinct value of that column, all with the
    aggregates of the key.
    """
    aggregates = [F.avg(c).alias(c) for c in means]
    aggregates += [F.max(c).alias(c) for c in maxima]
    aggregates += [F.min(c).alias(name) for name, c in (minima or {}).items()]
    rolled = df.groupBy(*keys).agg(*aggregates)
    if distinct is None:
        return rolled
    return attach(distinct_values_rows(df, keys, distinct), rolled, keys)


def max_all_columns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximum of every other column per key; repeated rows cannot change a maximum."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in df.columns if c not in keys])


def sum_null_as_zero(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Sum that skips nulls; a group of nulls sums to 0."""
    return df.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))


def rate_by_group(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Rows, flagged rows and their percentage per group."""
    flagged = F.coalesce(F.sum(flag), F.lit(0))
    obs = F.count(F.lit(1))
    return df.groupBy(*keys).agg(obs.alias("obs"), flagged.alias(flag), (flagged / obs * 100).alias("prob"))


def mean_sd_by_group(df: DataFrame, keys: Sequence[str], cols: Mapping[str, str]) -> DataFrame:
    """``<name>Avg`` and ``<name>Sd`` (sample) for each column (column -> name)."""
    out: list[Column] = []
    for col, name in cols.items():
        out += [F.avg(col).alias(f"{name}Avg"), F.stddev_samp(col).alias(f"{name}Sd")]
    return df.groupBy(*keys).agg(*out)


def mean_of_rates(df: DataFrame, keys: Sequence[str], obs: str = "obs", rate: str = "prob") -> DataFrame:
    """Second level: total rows and the unweighted mean of the rates."""
    return df.groupBy(*keys).agg(F.sum(obs).alias(obs), F.avg(rate).alias(rate))


def ratio_of_means(df: DataFrame, keys: Sequence[str], num: str, den: str, name: str = "share") -> DataFrame:
    """Percent ratio of group means."""
    means = df.groupBy(*keys).agg(F.avg(num).alias(num), F.avg(den).alias(den))
    return means.withColumn(name, F.when(F.col(den) != 0, F.col(num) / F.col(den) * 100))


def two_level_mean_share(
    df: DataFrame, keys: Sequence[str], var: str = "var", value: str = "value", base: str = "income"
) -> DataFrame:
    """Means per (keys, var), summed over the variables that share a mean ``base``, in percent of it.

    Means are told apart to six decimals: the last bits of a mean depend on the order of addition.
    """
    first = df.groupBy(*keys, var).agg(F.avg(value).alias(value), F.avg(base).alias(base))
    second = first.groupBy(*keys, F.round(base, 6).alias("_base")).agg(
        F.min(base).alias(base), F.sum(value).alias("total")
    )
    return second.drop("_base").withColumn("share", F.when(F.col(base) != 0, F.col("total") / F.col(base) * 100))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter("count > 1")


def panel_coverage(df: DataFrame, person: str = "pid", household: str = "hid") -> DataFrame:
    """One row: observations, distinct persons and households, mean observations per person."""
    # Counts per (person, household) carry everything, with partial aggregation throughout.
    pairs = df.groupBy(person, household).agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(
        F.sum("n").alias("observations"),
        F.countDistinct(person).alias("persons"),
        F.countDistinct(household).alias("households"),
    ).withColumn("mean_observations", F.col("observations") / F.col("persons"))


def quantile_trim(
    df: DataFrame, col: str, lo: float | None = None, hi: float | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Rows strictly between two quantiles of ``col`` (exact, linear interpolation), per key if given."""
    probs = [p for p in (lo, hi) if p is not None]
    cut = with_quantiles(df, keys, col, probs, "_q")
    if lo is not None:
        cut = cut.filter(F.col(col) > F.col("_q")[0])
    if hi is not None:
        cut = cut.filter(F.col(col) < F.col("_q")[len(probs) - 1])
    return cut.drop("_q")


def quantile_trim_by_group(df: DataFrame, keys: Sequence[str], col: str, hi: float) -> DataFrame:
    return quantile_trim(df, col, hi=hi, keys=keys)


def histogram_fixed_width(df: DataFrame, keys: Sequence[str], col: str, width: float) -> DataFrame:
    """Counts per bin centred on a multiple of ``width``."""
    bins = df.filter(F.col(col).isNotNull()).withColumn("bin", F.floor(F.col(col) / width + 0.5).cast("long"))
    return bins.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))


def ecdf_at_points(df: DataFrame, col: str, points: Sequence[float]) -> DataFrame:
    """Share of the non-null values at or below each point: rows (point, share) from one pass."""
    shares = [F.avg((F.col(col) <= F.lit(float(p))).cast("double")).alias(f"p{i}") for i, p in enumerate(points)]
    pairs = [F.struct(F.lit(float(p)).alias("point"), F.col(f"p{i}").alias("share")) for i, p in enumerate(points)]
    return df.agg(*shares).select(F.inline(F.array(*pairs)))


def first_non_null(
    df: DataFrame, keys: Sequence[str], col: str, order: Sequence[str], name: str | None = None
) -> DataFrame:
    """First non-missing value of each group in the given order, on all its rows."""
    return group_stats(df, keys, **{name or col: first_known(col, order)})


def distinct_values_rows(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """One row per key and distinct value, null included."""
    return df.select(*keys, col).distinct()


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def log_density_by_group(df: DataFrame, col: str, keys: Sequence[str], width: float) -> DataFrame:
    """Binned density of the logarithm of ``col`` within each group; positive values only."""
    logs = log_column(df, col, "_log").filter(F.col("_log").isNotNull())
    bins = logs.withColumn("bin", F.floor(F.col("_log") / width + 0.5).cast("long"))
    counts = bins.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    # One row per bin here, a few thousand at most per group.
    total = F.sum("count").over(Window.partitionBy(*keys))
    return counts.withColumn("density", F.col("count") / total / width)


def positive_mean(col: str | Column) -> Column:
    """Aggregate: mean of the positive values, 0 if there is none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.avg(F.when(c > 0, c)), F.lit(0.0))


def share_or_zero(num: Column, den: Column) -> Column:
    """num / den, 0 unless den is positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def mean_positive_only(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(positive_mean(col).alias(name))


def guarded_share(df: DataFrame, keys: Sequence[str], num: str, den: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(share_or_zero(F.sum(num), F.sum(den)).alias(name))
