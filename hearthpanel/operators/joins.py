"""Left equi-joins and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.operators.hot_joins import split_join
from hearthpanel.operators.keyed import attach, group_stats, null_safe_join
from hearthpanel.workspace import materialize


def natural_left_join(
    df: DataFrame, right: DataFrame, keys: Sequence[str] | None = None, known_keys: bool = False, split_hot: bool = False
) -> DataFrame:
    """Left join on every shared column (or ``keys``); null keys match null keys.

    ``known_keys`` says that no key is null: then plain equality joins, which uses the buckets of tables
    written by ``write_bucketed`` and moves no row. ``split_hot`` looks for hot keys on both sides first and
    spreads their rows (see ``hot_joins``); a key that only the left side holds often is also split by
    adaptive execution.
    """
    shared = list(keys or [c for c in df.columns if c in right.columns])
    if known_keys:
        return df.join(right, shared, "left").select(*df.columns, *[c for c in right.columns if c not in shared])
    return split_join(df, right, shared) if split_hot else null_safe_join(df, right, shared)


def chain_left_join(
    dfs: Sequence[DataFrame], keys: Sequence[str] | None = None, known_keys: bool = False, split_hot: bool = False
) -> DataFrame:
    """Fold tables from the left by natural left joins; with ``split_hot`` every result is written before the next."""
    joined = dfs[0]
    for i, right in enumerate(dfs[1:]):
        left = materialize(joined, "chain") if split_hot and i else joined
        joined = natural_left_join(left, right, keys, known_keys, split_hot)
    return joined


def unique_rows(table: DataFrame, key: str) -> DataFrame:
    """A lookup table, written once; an error if its key repeats, since a join would multiply rows."""
    book = materialize(table, "lookup")
    if book.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"key {key} of a lookup table is not unique")
    return book


def codebook_join(df: DataFrame, codebook: DataFrame, left: str, right: str | None = None) -> DataFrame:
    """Attach concept, group or label to a code column.

    A codebook is a small table; it is written first so that its true size decides whether it is
    broadcast. Its key must be unique, otherwise rows would multiply.
    """
    right = right or left
    book = unique_rows(codebook.distinct(), right)
    return df.join(book.withColumnRenamed(right, "_code"), F.col(left) == F.col("_code"), "left").drop("_code")


def first_event_join(
    df: DataFrame, keys: Sequence[str], flag: str, year: str = "year", name: str = "first_year"
) -> DataFrame:
    """First year with flag = 1 in each group, on all rows of the group."""
    return group_stats(df, keys, **{name: F.min(F.when(F.col(flag) == 1, F.col(year)))})


def broadcast_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """The columns of a one-row table as constants on every row."""
    rows = one_row.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("expected exactly one row")
    types = dict(one_row.dtypes)
    return df.withColumns({c: F.lit(v).cast(types[c]) for c, v in rows[0].asDict().items()})


def percentile_lookup_join(
    df: DataFrame, lookup: DataFrame, percentile: str = "percentile", value: str = "value", name: str = "share"
) -> DataFrame:
    """Value of a percentile table (100 rows) for each row's percentile."""
    table = unique_rows(lookup.select(F.col(percentile).alias("_p"), F.col(value).alias(name)), "_p")
    return df.join(table, F.col(percentile) == F.col("_p"), "left").drop("_p")


def earliest_value(series: DataFrame, year: str = "year", value: str = "value") -> DataFrame:
    return series.agg(F.min_by(value, year).alias("_earliest"))


def year_lookup_earliest_fallback(
    df: DataFrame, series: DataFrame, year: str | Column, name: str, on: str = "year", value: str = "value"
) -> DataFrame:
    """Value of a yearly series in ``year``; outside the series its earliest value."""
    table = unique_rows(series.select(F.col(on).alias("_y"), F.col(value).alias("_v")), "_y")
    wanted = F.col(year) if isinstance(year, str) else year
    joined = broadcast_scalars(df.join(table, wanted == F.col("_y"), "left"), earliest_value(series, on, value))
    return joined.withColumn(name, F.coalesce("_v", "_earliest")).drop("_y", "_v", "_earliest")


def peer_rate_join(df: DataFrame, rates: DataFrame, key: str = "decile", rate: str = "share", name: str = "peer_share") -> DataFrame:
    """Ownership share of each row's own group."""
    return attach(df, rates.select(key, F.col(rate).alias(name)), [key])
