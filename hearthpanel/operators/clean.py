"""Filters, projections and scalar cleaning of survey columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# --- rows -----------------------------------------------------------------------------------


def filter_year_range(
    df: DataFrame, lo: int | None = None, hi: int | None = None, year: str = "year", open_ends: bool = False
) -> DataFrame:
    """Rows with ``lo <= year <= hi``, or ``lo < year < hi`` when the ends are open."""
    c = F.col(year)
    if lo is not None:
        df = df.filter(c > lo if open_ends else c >= lo)
    if hi is not None:
        df = df.filter(c < hi if open_ends else c <= hi)
    return df


def filter_year_in(df: DataFrame, years: Sequence[int], year: str = "year") -> DataFrame:
    return df.filter(F.col(year).isin(*years))


def drop_null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def owner_renter_rows(
    df: DataFrame, owner: str = "owner", var: str = "var", renter_only: str = "rheat|reletr", owner_only: str = "oheat|oeletr"
) -> DataFrame:
    """Owners keep every variable but those asked of renters, all others (an unknown status
    included) every variable but those asked of owners."""
    owns = F.coalesce(F.col(owner) == 1, F.lit(False))
    return df.filter(F.when(owns, ~F.col(var).rlike(renter_only)).otherwise(~F.col(var).rlike(owner_only)))


# --- columns by name --------------------------------------------------------------------------


def select_name_contains(df: DataFrame, parts: Sequence[str], negate: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Columns whose name contains any of ``parts`` (in any case), or none of them; ``keep`` always stays."""
    def matches(name: str) -> bool:
        return any(p.lower() in name.lower() for p in parts)

    return df.select(*[c for c in df.columns if c in keep or matches(c) != negate])


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def select_column_range(df: DataFrame, first: str, last: str, also: Sequence[str] = ()) -> DataFrame:
    """``also`` and then the contiguous columns ``first`` to ``last``, in table order."""
    names = df.columns
    run = names[names.index(first) : names.index(last) + 1]
    return df.select(*also, *[c for c in run if c not in also])


def rename_in_select(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Project to the columns of ``mapping`` (old name -> new name)."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in mapping.items()])


# --- missing values ---------------------------------------------------------------------------


def negatives_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in cols})


def code_to_null(df: DataFrame, col: str, code: float) -> DataFrame:
    return df.withColumn(col, F.nullif(F.col(col), F.lit(code)))


def text_null_token(df: DataFrame, col: str, token: str = "NA") -> DataFrame:
    return df.withColumn(col, F.nullif(F.col(col), F.lit(token)))


def infinite_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null for both infinities; Spark's own extremes of nothing are null already."""
    return df.withColumns({c: F.when(F.abs(F.col(c)) != F.lit(float("inf")), F.col(c)) for c in cols})


def cast_numeric(df: DataFrame, cols: Sequence[str], to: str = "double") -> DataFrame:
    """Text to number; what does not parse becomes null."""
    return df.withColumns({c: F.col(c).try_cast(to) for c in cols})


# --- codes and categories ---------------------------------------------------------------------


def yes_no_to_binary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The answer 2 (no) becomes 0, everything else stays."""
    return df.withColumns({c: F.when(F.col(c) == 2, 0).otherwise(F.col(c)) for c in cols})


def collapse_categories(df: DataFrame, col: str, codes: Sequence[Any], value: Any) -> DataFrame:
    return df.withColumn(col, F.when(F.col(col).isin(*codes), value).otherwise(F.col(col)))


def classify_by_pattern(
    df: DataFrame, col: str, classes: Mapping[str, str], default: str | None, name: str
) -> DataFrame:
    """First class whose pattern occurs in ``col``, else ``default``; null stays null."""
    found = [F.when(F.col(col).rlike(pattern), label) for label, pattern in classes.items()]
    return df.withColumn(name, F.when(F.col(col).isNotNull(), F.coalesce(*found, F.lit(default))))


def recode_labels(df: DataFrame, col: str, labels: Mapping[str, str], name: str | None = None) -> DataFrame:
    """Whole names replaced by display names; a name without one is kept."""
    pairs = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return df.withColumn(name or col, F.coalesce(F.element_at(pairs, F.col(col)), F.col(col)))


def value_labels(df: DataFrame, col: str, labels: Mapping[int, str], name: str) -> DataFrame:
    """The label of a numeric code beside it; a code without one has a null label."""
    pairs = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return df.withColumn(name, F.element_at(pairs, F.col(col).cast("int")))


def rule_impute(df: DataFrame, col: str, rules: Sequence[tuple[Column, Any]]) -> DataFrame:
    """Fill nulls by the first rule (condition, value) that holds."""
    return df.withColumn(col, F.coalesce(F.col(col), *[F.when(test, F.lit(value)) for test, value in rules]))


# --- text of names and labels -----------------------------------------------------------------


def concept_code(df: DataFrame, col: str = "var", name: str = "code", stem: str = "consum") -> DataFrame:
    """Questionnaire code of a consumption variable: the name without its stem and imputation
    letters, or, without the stem, the part before the underscore."""
    bare = F.regexp_replace(F.col(col), f"b|{stem}|c|d|e", "")
    return df.withColumn(
        name,
        F.when(F.col(col).contains(stem), bare).otherwise(F.regexp_replace(F.col(col), "_.*", "")),
    )


def split_imputation(df: DataFrame, col: str = "var", width: int = 5, name: str = "imp") -> DataFrame:
    """``w010ha`` -> variable ``w010h`` and imputation ``a``."""
    return df.withColumn(name, F.substring(col, width + 1, 1)).withColumn(col, F.substring(col, 1, width))


def parse_interval_label(df: DataFrame, col: str, low: str = "LowAmt", high: str = "HighAmt") -> DataFrame:
    """Bounds of an interval label such as ``[500,900)``."""
    bound = lambda part: F.regexp_extract(col, r"^[\[\(]\s*([^,]+),\s*([^\]\)]+)[\]\)]$", part).try_cast("double")
    return df.withColumns({low: bound(1), high: bound(2)})


def split_stat_name(df: DataFrame, col: str, name: str = "term", stat: str = "stat") -> DataFrame:
    """``(Intercept)_est`` -> term ``Intercept`` and statistic ``est``."""
    return df.withColumns({name: F.regexp_replace(F.col(col), r"[()]|_.*", ""), stat: F.substring_index(F.col(col), "_", -1)})


def stat_name(df: DataFrame, term: str, suffix: str, name: str) -> DataFrame:
    """``(Intercept)`` and ``est`` -> ``Intercept_est``."""
    return df.withColumn(name, F.concat_ws("_", F.regexp_replace(F.col(term), r"[()]", ""), F.lit(suffix)))


def percent_label(df: DataFrame, col: str, name: str = "label", digits: int = 1) -> DataFrame:
    """Number -> ``12.3%``."""
    text = F.concat(F.format_string(f"%.{digits}f", F.round(F.col(col), digits)), F.lit("%"))
    return df.withColumn(name, F.when(F.col(col).isNotNull(), text))


# --- arithmetic -------------------------------------------------------------------------------


def scale_units(df: DataFrame, col: str, factor: float, var: str | None = None, pattern: str | None = None) -> DataFrame:
    """Multiply a column by ``factor``, on rows whose ``var`` matches ``pattern`` if one is given."""
    scaled = F.col(col) * F.lit(factor)
    if pattern is not None:
        scaled = F.when(F.col(var).rlike(pattern), scaled).otherwise(F.col(col))
    return df.withColumn(col, scaled)


def row_total(df: DataFrame, exclude: Sequence[str], name: str = "total") -> DataFrame:
    """Sum across the columns not in ``exclude``; null if any is null."""
    return df.withColumn(name, reduce(add, [F.col(f"`{c}`") for c in df.columns if c not in exclude]))


def round_half_even(df: DataFrame, cols: Sequence[str], digits: int = 0) -> DataFrame:
    return df.withColumns({c: F.bround(F.col(c), digits) for c in cols})


def log_column(df: DataFrame, col: str, name: str) -> DataFrame:
    """Natural logarithm; null at and below zero."""
    return df.withColumn(name, F.when(F.col(col) > 0, F.ln(F.col(col))))


def clamp(df: DataFrame, col: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Limit a column from below and above; null stays null."""
    c = F.col(col)
    bounded = c
    if lo is not None:
        bounded = F.greatest(bounded, F.lit(lo))
    if hi is not None:
        bounded = F.least(bounded, F.lit(hi))
    return df.withColumn(col, F.when(c.isNotNull(), bounded))


def ratio_percent(df: DataFrame, num: str, den: str, name: str) -> DataFrame:
    """100 num / den on the rows where den is positive; the others are dropped."""
    return df.filter(F.col(den) > 0).withColumn(name, F.col(num) / F.col(den) * 100)
