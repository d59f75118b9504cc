"""What a check is, and how its result is brought into one comparable form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views


@dataclass(frozen=True)
class Check:
    """``cols`` lists the result columns as ``name:type``, i = integer, s = text, rN = double
    rounded to N places. ``body`` is SQL over the views and the raw tables; None where SQL cannot
    express the operator."""

    key: str
    cols: str
    run: Callable[[SparkSession, str], DataFrame]
    body: str | None


def _columns(cols: str) -> list[tuple[str, str]]:
    return [tuple(c.rsplit(":", 1)) for c in cols.split()]  # type: ignore[misc]


def _nudge(digits: int) -> float:
    # Averages of cents often lie exactly half way between two rounded values, where the last bit
    # of a sum decides; the shift moves them off that point in both engines alike.
    return 0.037 * 10**-digits


def shape(df: DataFrame, cols: str) -> DataFrame:
    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "i":
            return c.cast("bigint").alias(name)
        if kind == "s":
            return c.cast("string").alias(name)
        digits = int(kind[1:])
        return (F.round(c.cast("double") + F.lit(_nudge(digits)), digits) + F.lit(0.0)).alias(name)

    return df.select(*[one(n, k) for n, k in _columns(cols)])


def sql(check: Check) -> str:
    def one(name: str, kind: str) -> str:
        if kind == "i":
            return f'CAST("{name}" AS BIGINT) AS "{name}"'
        if kind == "s":
            return f'CAST("{name}" AS VARCHAR) AS "{name}"'
        digits = int(kind[1:])
        return f'round(CAST("{name}" AS DOUBLE) + CAST({_nudge(digits)!r} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS "{name}"'

    picked = ", ".join(one(n, k) for n, k in _columns(check.cols))
    return f"WITH RECURSIVE {views.ctes(check.body)}, result AS ({check.body}) SELECT {picked} FROM result"


def build(checks: list[Check]) -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    def runner(check: Check) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: shape(check.run(spark, sf_dir), check.cols)

    queries = {c.key: runner(c) for c in checks}
    oracles = {c.key: sql(c) for c in checks if c.body is not None}
    return queries, oracles
