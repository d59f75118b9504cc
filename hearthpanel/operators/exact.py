"""Sums that do not depend on the order of the rows.

Adding doubles rounds at every step, so a sum changes in its last digits with the order in which partitions
arrive. Here every value is cut into ``LEVELS`` whole numbers of ``WIDTH`` bits, counted from a power of two
above the largest value; the whole numbers are added as integers, which is exact in any order, and put
together with one rounding at the end. 96 bits below the largest value are kept, more than a double has.
Integer sums hold for up to 2^39 rows of a group.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS, WIDTH = 4, 24
# Powers of two beyond these are not doubles.
_LEAST, _MOST = -900, 1000


def exponent(bound: float) -> int:
    """A power of two that ``bound`` and everything smaller stays below."""
    if math.isnan(bound) or math.isinf(bound):
        raise ValueError("sums need finite values")
    return min(max(math.frexp(bound)[1], _LEAST), _MOST) if bound else 0


def parts(value: Column, top: int) -> list[Column]:
    """Whole numbers whose sum, weighted by falling powers of two, is ``value``; |value| < 2^top."""
    whole = [F.rint(value * F.lit(2.0 ** min(WIDTH * (i + 1) - top, 1023))) for i in range(LEVELS)]
    rest = [w - p * F.lit(2.0**WIDTH) for w, p in zip(whole[1:], whole)]
    return [c.cast("long") for c in [whole[0], *rest]]


def sum_columns(name: str, value: Column, top: int) -> list[Column]:
    """Aggregates ``name_0`` ... that hold the exact sum of ``value``; nulls count as 0."""
    return [F.coalesce(F.sum(p), F.lit(0)).alias(f"{name}_{i}") for i, p in enumerate(parts(value, top))]


def total(row: Mapping[str, int], name: str, top: int) -> Fraction:
    """The exact sum from a row of ``sum_columns``."""
    whole = sum(int(row[f"{name}_{i}"]) << (WIDTH * (LEVELS - 1 - i)) for i in range(LEVELS))
    shift = top - WIDTH * LEVELS
    return Fraction(whole) * (Fraction(2) ** shift)


def as_double(name: str, top: int) -> Column:
    """The sum as a double column of a grouped result; the same in every run."""
    scaled = [F.col(f"{name}_{i}").cast("double") * F.lit(2.0 ** max(top - WIDTH * (i + 1), -1074)) for i in range(LEVELS)]
    out = scaled[-1]
    for s in reversed(scaled[:-1]):
        out = s + out
    return out


def extremes(df: DataFrame, cols: Sequence[str]) -> tuple[int, dict[str, tuple[float, float]]]:
    """Number of rows, and smallest and largest value of each column; no order of rows changes them."""
    aggregates = [f(F.col(f"`{c}`")).alias(f"{f.__name__}{i}") for i, c in enumerate(cols) for f in (F.min, F.max)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggregates).first()
    return row["n"], {c: (row[f"min{i}"] or 0.0, row[f"max{i}"] or 0.0) for i, c in enumerate(cols)}


def tops(box: Mapping[str, tuple[float, float]]) -> dict[str, int]:
    return {c: exponent(max(abs(lo), abs(hi))) for c, (lo, hi) in box.items()}


def group_sums(df: DataFrame, keys: Sequence[str], values: Mapping[str, tuple[Column, int]], rows: str = "n") -> DataFrame:
    """Per group the number of rows and the exact sums of ``values`` (column and power of two above it)."""
    aggregates = [c for name, (value, top) in values.items() for c in sum_columns(name, value, top)]
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows), *aggregates)
    return sums.select(*keys, rows, *[as_double(name, top).alias(name) for name, (_, top) in values.items()])
