"""Joining one-row-per-key tables back to their rows.

``attach`` and ``group_stats`` stand in for windows over whole groups. A window moves a whole
group to one task; here the group is pre-aggregated on the map side and its single result row
joined back. The statistics are written first (see ``workspace``), so the planner knows their
size: a small table is broadcast, a large one shuffled.

A hot key would still send all its rows to one task of a shuffled join. Keys with very many rows
are therefore found in the statistics, broadcast (their number has a fixed bound) and their rows
salted, so that they spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.workspace import materialize

# Tuning only: with or without salt a join gives the same rows (tests set both limits to 0).
# Rows of one key that may go to one task.
HOT_ROWS = 1_000_000
# A hot key has at least this share of all rows, so there are at most 1 / share of them.
HOT_SHARE = 1 / 10_000
SALTS = 9973


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match; the right copies of the keys are dropped."""
    marked = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(marked, condition, how).drop(*[f"_right_{k}" for k in keys])


def attach(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], rows: str | None = None, written: bool = False
) -> DataFrame:
    """Left join of ``stats`` (one row per key) to the rows of ``df``.

    ``rows`` names the column of ``stats`` with the number of rows of a key, if there is one; ``written``
    says that ``stats`` is a written table already.
    """
    if not written:
        stats = materialize(stats, "stats")
    if rows is not None:
        total, most = stats.agg(F.sum(rows), F.max(rows)).first()
        limit = max(HOT_ROWS, (total or 0) * HOT_SHARE)
        if (most or 0) > limit:
            return _attach_salted(df, stats, keys, F.col(rows) > limit)
    return null_safe_join(df, stats, keys)


def _attach_salted(df: DataFrame, stats: DataFrame, keys: Sequence[str], is_hot: Column) -> DataFrame:
    values = [c for c in stats.columns if c not in keys]
    hot = stats.filter(is_hot).withColumnsRenamed({v: f"_hot_{v}" for v in values}).withColumn("_is_hot", F.lit(True))
    marked = null_safe_join(df, F.broadcast(hot), keys).withColumn(
        "_salt", F.when(F.col("_is_hot"), F.pmod(F.xxhash64(F.spark_partition_id(), *df.columns), F.lit(SALTS)) + 1).otherwise(0)
    )
    # Rows of hot keys carry a salt above 0 and find no partner here; they have theirs already.
    joined = null_safe_join(marked, stats.withColumn("_salt", F.lit(0).cast("long")), [*keys, "_salt"])
    return joined.select(
        *df.columns, *[F.when(F.col("_is_hot"), F.col(f"_hot_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    )


def group_stats(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """``df`` with the named aggregates of each row's group as new columns."""
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_group_rows"), *[a.alias(name) for name, a in aggregates.items()]
    )
    replaced = [c for c in aggregates if c in df.columns]
    return attach(df.drop(*replaced), stats, keys, "_group_rows").drop("_group_rows")


def first_known(col: str, order: Sequence[str]) -> Column:
    """Aggregate: first non-missing value of a column in the given order."""
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), place))
