"""Wide to long, long to wide, stacking and binding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthpanel.operators.joins import natural_left_join


def wide_to_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None, name: str = "var", value: str = "value"
) -> DataFrame:
    """One row per id row and value column, nulls kept; numbers as doubles, as text if any column is text."""
    cols = values or [c for c in df.columns if c not in ids]
    types = dict(df.dtypes)
    kind = "string" if any(types[c] == "string" for c in cols) else "double"
    return df.select(*ids, *[F.col(c).cast(kind).alias(c) for c in cols]).unpivot(list(ids), cols, name, value)


def long_to_wide(df: DataFrame, ids: Sequence[str], name: str, value: str, values: Sequence[str]) -> DataFrame:
    """One column per entry of ``values``; giving them saves the job that would look for them.
    A cell given by more than one row stops the query."""
    twice = F.concat(F.lit("more than one value for "), F.max(F.col(name).cast("string")))
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(twice).cast(dict(df.dtypes)[value])).otherwise(F.max(value))
    return df.groupBy(*ids).pivot(name, list(values)).agg(one)


def metrics_to_facets(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Melt the metric columns into (type, value)."""
    return wide_to_long(df, ids, metrics, "type", "value")


def stack_with_id(dfs: Sequence[DataFrame], idcol: str = "spec") -> DataFrame:
    """Union of tables with the 1-based number of the source table."""
    return stack_families([d.withColumn(idcol, F.lit(i)) for i, d in enumerate(dfs, 1)])


def stack_families(dfs: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    first, *rest = dfs
    for d in rest:
        first = first.unionByName(d, allowMissingColumns=True)
    return first


def bind_columns_by_key(df: DataFrame, other: DataFrame, key: Sequence[str]) -> DataFrame:
    """The columns of ``other`` beside those of ``df``, matched by key (rows have no position)."""
    extra = [c for c in other.columns if c in key or c not in df.columns]
    return natural_left_join(df, other.select(*extra), key)


def year_columns_to_rows(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "decile", value: str = "value"
) -> DataFrame:
    """Columns named by integers -> rows with an integer column."""
    return wide_to_long(df, ids, columns, name, value).withColumn(name, F.col(name).cast("int"))
