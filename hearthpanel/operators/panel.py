"""Rank groups, bands, spell states and period comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthpanel.operators.keyed import group_stats
from hearthpanel.operators.ranking import (
    dense_ranks,
    ntile_groups,
    position_groups,
    quantile_groups,
    quantile_table,
)


def ntile_global(df: DataFrame, col: str, n: int, tiebreak: Sequence[str], name: str = "decile") -> DataFrame:
    return ntile_groups(df, col, n, tiebreak, name=name)


def ntile_by_year(
    df: DataFrame, col: str, n: int, tiebreak: Sequence[str], keys: Sequence[str] = ("year",), name: str = "decile"
) -> DataFrame:
    return ntile_groups(df, col, n, tiebreak, keys, name)


quantile_cut_groups = quantile_groups
rank_position_groups = position_groups


def fixed_bands(
    df: DataFrame, col: str, cuts: Sequence[float], name: str = "band", label: str | None = None,
    bounds: tuple[float, float] | None = None,
) -> DataFrame:
    """1-based left-closed bands between given limits.

    The last band is closed at the top, where it reaches up to the largest value present; a value
    below the first limit opens band 0 from the smallest value. ``label`` names a column for the
    text ``[lo,hi)``. ``bounds`` are the smallest and largest value where the caller knows them; else
    they are looked up, which reads the column once more.
    """
    limits = [float(c) for c in cuts]
    bounds = bounds or df.agg(F.min(col), F.max(col)).first()
    least, most = (limits[i] if b is None else float(b) for i, b in zip((0, -1), bounds))
    inner = limits if most > limits[-1] else limits[:-1]
    band = sum((F.when(F.col(col) >= c, 1).otherwise(0) for c in inner), F.lit(0))
    out = df.withColumn(name, F.when(F.col(col).isNotNull(), band))
    if label is None:
        return out
    edges = [min(least, limits[0]), *limits] + ([most] if most > limits[-1] else [])
    shown = [f"{e:g}" if e == int(e) and abs(e) < 1e6 else repr(e) for e in edges]
    texts = [f"[{a},{b})" for a, b in zip(shown, shown[1:])]
    texts[-1] = texts[-1][:-1] + "]"
    shown = F.element_at(F.array(*[F.lit(t) for t in texts]), F.col(name) + 1)
    return out.withColumn(label, F.when(F.col(name).isNotNull(), shown))


def cumulative_flag(
    df: DataFrame, keys: Sequence[str], order: str, flag: str, name: str | None = None
) -> DataFrame:
    """Event flags -> state: 1 from the first event of the group on, 0 before it, null until the
    first known flag. Equal to a running sum of the (non-negative) flags being positive."""
    known = group_stats(
        df,
        keys,
        _first_on=F.min(F.when(F.col(flag) > 0, F.col(order))),
        _first_known=F.min(F.when(F.col(flag).isNotNull(), F.col(order))),
    )
    state = F.when(F.col(order) >= F.col("_first_on"), 1).when(F.col(order) >= F.col("_first_known"), 0)
    return known.withColumn(name or flag, state).drop("_first_on", "_first_known")


def spell_max_broadcast(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Group maximum on all rows; groups without a value are dropped."""
    return group_stats(df, keys, **{col: F.max(col)}).filter(F.col(col).isNotNull())


def share_of_group(
    df: DataFrame, keys: Sequence[str], col: str, name: str = "share", total: str = "total"
) -> DataFrame:
    """Group total, and each value in percent of it."""
    out = group_stats(df, keys, **{total: F.sum(col)})
    return out.withColumn(name, F.when(F.col(total) != 0, F.col(col) / F.col(total) * 100))


def balanced_panel(df: DataFrame, key: str, lo: int, hi: int, rows: int | None = None, year: str = "year") -> DataFrame:
    """Units with exactly ``rows`` rows (default: one per year) between two years."""
    counted = group_stats(df.filter(F.col(year).between(lo, hi)), [key], _rows=F.count(F.lit(1)))
    return counted.filter(F.col("_rows") == (rows or hi - lo + 1)).drop("_rows")


def group_mean_impute(df: DataFrame, keys: Sequence[str], col: str, digits: int = 0) -> DataFrame:
    """Nulls filled by the group mean rounded half to even; groups without a value are dropped."""
    means = group_stats(df, keys, _mean=F.avg(col)).filter(F.col("_mean").isNotNull())
    return means.withColumn(col, F.coalesce(F.col(col), F.bround("_mean", digits))).drop("_mean")


def spell_age(
    df: DataFrame,
    ref_year: int,
    keys: Sequence[str] = ("hid", "year", "YearMoved"),
    start: str = "PanelYear",
    age: str = "PanelAge",
    flag: str = "pv",
    year: str = "year",
) -> DataFrame:
    """Age at the reference year of what started in ``start``; what starts later is not there yet.

    Age and flag are the maximum and the sum over the rows of a key.
    """
    aged = df.withColumn(age, F.when(F.col(year) == ref_year, ref_year - F.col(start)))
    out = group_stats(aged, keys, **{age: F.max(age), flag: F.coalesce(F.sum(flag), F.lit(0))})
    late = F.coalesce(F.col(start) > ref_year, F.lit(False))
    return out.withColumns(
        {flag: F.when(late, 0).otherwise(F.col(flag)), age: F.when(~late, F.col(age))}
    )


# Periods of a series that one task looks through together; any number gives the same rows.
BLOCK = 4096


def earlier_values(
    df: DataFrame, keys: Sequence[str], period: str, cols: dict[str, tuple[str, int]]
) -> DataFrame:
    """Values of earlier periods beside each row: new name -> (column, periods back).

    (keys, period) must be unique, else the query stops; without a period nothing is earlier. A series is cut
    into blocks of consecutive periods, and each block gets a copy of the last rows of the one before. Every row
    is shuffled once, a long series spreads over many tasks, and a task's group has a block's periods at most.
    """
    reach = max(back for _, back in cols.values())
    if min(back for _, back in cols.values()) < 1:
        raise ValueError("earlier values lie at least one period back")
    block = max(BLOCK, reach)
    number = F.unix_date(period) if dict(df.dtypes)[period] == "date" else F.col(period)
    last = F.pmod("_number", F.lit(block)) >= block - reach
    placed = df.withColumn("_number", number.cast("long")).withColumn(
        "_next", F.explode(F.when(last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    placed = placed.withColumn("_block", F.floor(F.col("_number") / block) + F.col("_next"))
    ordered = Window.partitionBy(*keys, "_block").orderBy("_number")
    looked = placed.withColumns(
        {name: F.max(c).over(ordered.rangeBetween(-back, -back)) for name, (c, back) in cols.items()}
        | {"_same": F.count(F.when(F.col("_next") == 0, 1)).over(ordered.rangeBetween(0, 0))}
    )
    twice = F.raise_error(F.concat(F.lit("more than one row in period "), F.col(period).cast("string"))).cast("boolean")
    own = looked.filter((F.col("_next") == 0) & F.when((F.col("_same") > 1) & F.col("_number").isNotNull(), twice).otherwise(True))
    known = {name: F.when(F.col("_number").isNotNull(), F.col(name)).alias(name) for name in cols}
    return own.select(*df.columns, *known.values())


def period_change(
    df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], prefix: str = "Change"
) -> DataFrame:
    """Change against the previous period, 0 where there is none."""
    looked = earlier_values(df, keys, order, {f"_before_{c}": (c, 1) for c in cols})
    changes = {f"{prefix}{c}": F.coalesce(F.col(c) - F.col(f"_before_{c}"), F.lit(0.0)) for c in cols}
    return looked.withColumns(changes).drop(*[f"_before_{c}" for c in cols])


def expected_vs_actual(
    df: DataFrame, keys: Sequence[str], order: str, actual: str, expected: str, name: str = "expected_before"
) -> DataFrame:
    """The value of a period beside the expectation formed in the one before; first periods drop out."""
    looked = earlier_values(df, keys, order, {name: (expected, 1), "_was": (order, 1)})
    return looked.filter(F.col("_was").isNotNull()).select(*keys, order, actual, name)


def order_groups_by_median(
    df: DataFrame, key: str, col: str, desc: bool = False, name: str = "position"
) -> DataFrame:
    """Categories with their exact median and the display position it gives them."""
    medians = quantile_table(df, [key], col, [0.5]).select(key, F.col("quantiles")[0].alias("median"))
    return dense_ranks(medians, "median", desc, name)


def sort_rows(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*keys)


def preview_sorted(df: DataFrame, order: Sequence[Column], k: int = 6) -> DataFrame:
    """First ``k`` rows in an order; the order should end in a unique column."""
    return df.orderBy(*order).limit(k)


def period_slice(df: DataFrame, lo: int, hi: int, year: str = "year") -> DataFrame:
    return df.filter(F.col(year).between(lo, hi))
