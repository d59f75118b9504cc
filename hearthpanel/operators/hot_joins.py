"""Equi-joins of two tables of which either may hold hot keys.

A one-row sketch of frequent keys is taken of each side, and only the keys it names are counted. The rows of
a hot key then meet in a grid: rows of the left side are dealt to its lines and copied to its columns,
rows of the right side are dealt to its columns and copied to its lines, so every pair meets in exactly one
cell and a cell makes about ``cell_rows`` rows. All other keys are joined as they are. Which keys are split
is tuning only: the rows are the same. What is broadcast are at most ``2 * TOP`` keys of ``KEY_BYTES`` each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.operators.keyed import null_safe_join
from hearthpanel.workspace import materialize

# Keys a side's sketch names, and counters it keeps: a key with 1/500 of all rows is never missed.
TOP = 1000
TRACKED = 10_000
# Rows that one task may make of one key.
CELL_ROWS = 1_000_000
# Keys that take more than this as text are not split.
KEY_BYTES = 1024


def _hash(keys: Sequence[str], types: dict[str, str]) -> Column:
    return F.xxhash64(*[F.col(k).cast(types[k]) for k in keys])


def _frequent(side: DataFrame, hashed: Column, least: float) -> list[int]:
    """Hashes of the keys that seem to have ``least`` rows."""
    found = side.select(hashed.alias("_hash")).agg(F.expr(f"approx_top_k(_hash, {TOP}, {TRACKED})").alias("top")).first().top
    return [r["item"] for r in found or [] if r["count"] >= least]


def hot_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], cell_rows: int = CELL_ROWS) -> DataFrame | None:
    """The keys whose rows are split, with the ``_lines`` and ``_columns`` of their grids; None if there are none."""
    types = dict(left.select(*keys).limit(0).unionByName(right.select(*keys).limit(0)).dtypes)
    hashed = _hash(keys, types)
    least = cell_rows / 100
    named = sorted({*_frequent(left, hashed, least), *_frequent(right, hashed, least)})
    if not named:
        return None

    def counted(side: DataFrame, name: str) -> DataFrame:
        chosen = side.select(*[F.col(k).cast(types[k]).alias(k) for k in keys]).filter(hashed.isin(named))
        return chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    # Both tables of counts in one grouping; a key that one side lacks has no rows there.
    counts = counted(left, "_n").withColumn("_m", F.lit(0).cast("long")).unionByName(
        counted(right, "_m").withColumn("_n", F.lit(0).cast("long"))
    )
    both = counts.groupBy(*keys).agg(F.sum("_n").cast("double").alias("_n"), F.sum("_m").cast("double").alias("_m"))
    made = F.col("_n") * F.greatest("_m", F.lit(1.0))
    columns = F.greatest(F.ceil(F.col("_m") / cell_rows), F.lit(1))
    lines = F.greatest(F.least(F.ceil(made / cell_rows / columns), F.col("_n")), F.lit(1))
    short = F.octet_length(F.to_json(F.struct(*keys))) <= KEY_BYTES
    grids = both.select(*keys, lines.cast("long").alias("_lines"), columns.cast("long").alias("_columns")).filter(
        short & ((F.col("_lines") > 1) | (F.col("_columns") > 1))
    )
    table = materialize(grids.limit(2 * TOP), "hot-keys")
    return None if table.isEmpty() else table


def split_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Equi-join (``left`` or ``inner``) in which null keys match and hot keys of either side are split.

    Repeated rows are kept. Both inputs are read more than once (their keys alone before the join), so they
    should be tables or cheap to make. Columns besides the keys must have different names.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"cannot split a join of kind {how}")
    if clash := [c for c in right.columns if c in left.columns and c not in keys]:
        raise ValueError(f"columns {clash} are on both sides")
    hot = hot_keys(left, right, keys, cell_rows)
    if hot is None:
        return null_safe_join(left, right, keys, how)

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each row dealt to one of ``own`` and copied to every one of ``other``."""
        plain = [c for c, t in side.dtypes if "map<" not in t and t != "variant"]
        # A row that is computed again after a loss gets the same place.
        place = F.pmod(F.xxhash64(F.spark_partition_id(), *plain), F.coalesce(own, F.lit(1)))
        marked = null_safe_join(side, F.broadcast(hot), keys).withColumn(f"{own}_at", place)
        copies = F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1)
        return marked.withColumn(f"{other}_at", F.explode(copies))

    lefts = dealt(left, "_lines", "_columns").drop("_lines")
    rights = dealt(right, "_columns", "_lines").drop("_lines", "_columns").withColumn("_met", F.lit(True))
    joined = null_safe_join(lefts, rights, [*keys, "_lines_at", "_columns_at"], how)
    if how == "left":
        # A key with several columns has rows on the right, so each of its rows meets one in some column.
        joined = joined.filter(F.col("_met") | F.coalesce(F.col("_columns") == 1, F.lit(True)))
    return joined.select(*left.columns, *[c for c in right.columns if c not in keys])
