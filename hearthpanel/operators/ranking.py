"""Exact order statistics, quantiles and rank groups without moving a group to one task.

Only the ordered columns are looked at. They are range-partitioned by (key, value), whatever their type
and the number of groups; the rank at which a partition starts follows from the counts of the partitions
before it, and only partitions that hold a wanted rank are sorted.

Equal values are counted together before they are shuffled, or told apart by a tiebreak, so a
value held by a third of all rows does no harm.

Rank groups need no rank per row: each row is compared with the few limits of its group, so wide
rows are never shuffled for them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthpanel.operators.keyed import attach, null_safe_join
from hearthpanel.workspace import materialize


def order_statistics(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ranks: Column, unique: bool = False
) -> DataFrame:
    """The rows at given ranks of each group: one row per key with ``n`` (rows of the group) and
    ``stats``, a map from rank to the struct of the order columns.

    ``ranks`` is an array of 1-based ranks in terms of the group size, column ``n``. Rows with a null
    in the first order column are left out; a null further on comes before all values. ``unique``
    says that (keys, order) never repeats.
    """
    groups = list(keys) or ["_all"]
    values = df.select(*keys, *order).dropna(subset=[order[0]])
    if not keys:
        values = values.withColumn("_all", F.lit(0))
    values = materialize(values, "values")
    sizes = values.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.array_distinct(ranks.cast("array<bigint>")).alias("_wanted")
    hits = _by_ranges(values, groups, order, unique, sizes.select(*groups, "n", wanted))
    # At most one entry per wanted rank.
    found = hits.groupBy(*groups).agg(
        F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_row"))).alias("stats")
    )
    return found.select(*keys, "n", "stats")


def _by_ranges(
    values: DataFrame, keys: Sequence[str], order: Sequence[str], unique: bool, sought: DataFrame
) -> DataFrame:
    """Rows at the ranks ``_wanted`` of each key of ``sought`` (keys, n, _wanted)."""
    if unique:
        counted = values.withColumn("_count", F.lit(1).cast("long"))
    else:
        counted = values.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("_count"))
    placed = materialize(
        counted.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    # One row per key and partition, so the window sees at most one row per partition.
    sizes = placed.groupBy(*keys, "_part").agg(F.sum("_count").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_size")
    starts = (
        null_safe_join(sizes.withColumn("_before", before), sought.select(*keys, "n", "_wanted"), keys)
        .withColumn("_wanted", F.expr("filter(_wanted, r -> r > _before and r <= _before + _size)"))
        .filter(F.size("_wanted") > 0)
        .drop("_size")
    )
    inside = null_safe_join(placed, materialize(starts, "starts"), [*keys, "_part"], "inner")
    last = F.col("_before") + F.sum("_count").over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return (
        inside.withColumn("_last", last)
        .withColumn("_wanted", F.expr("filter(_wanted, r -> r > _last - _count and r <= _last)"))
        .select(*keys, "n", F.explode("_wanted").alias("_rank"), F.struct(*order).alias("_row"))
    )


def passed(n: int, test: Callable[[int], Column], first: int = 0) -> Column:
    """How many of ``n`` ascending limits a row has passed, by bisection; ``test(i)`` asks for one.

    A limit that is missing (null) counts as not passed.
    """
    if n == 0:
        return F.lit(first)
    half = n // 2
    return F.when(test(first + half), passed(n - half - 1, test, first + half + 1)).otherwise(passed(half, test, first))


def _with_group_array(df: DataFrame, table: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``df`` with the array column ``name`` of the group table: joined by key, or, when the whole
    table is one group, as a constant."""
    if keys:
        return attach(df, table.select(*keys, name, F.col("n").alias("_group_rows")), keys, "_group_rows").drop("_group_rows")
    kind = dict(table.dtypes)[name]
    row = table.select(name).first()
    values = None if row is None else row[0]
    return df.withColumn(name, F.lit(None).cast(kind) if values is None else _constant(values, kind))


def _constant(values: list, kind: str) -> Column:
    items = [F.struct(*[F.lit(v) for v in x]) if isinstance(x, tuple) else F.lit(x) for x in values]
    return F.array(*items).cast(kind)


def quantile_table(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per key, array ``quantiles``."""
    points = f"array({', '.join(f'{float(p)!r}D' for p in probs)})"

    # The two ranks around place p(n - 1), counted from 0.
    ranks = F.expr(
        f"concat(transform({points}, p -> floor(p * (n - 1)) + 1), transform({points}, p -> least(floor(p * (n - 1)) + 2, n)))"
    )
    found = order_statistics(df, keys, [col], ranks)
    at = "cast(stats[least(floor(p * (n - 1)) + {}, n)].`" + col + "` as double)"
    low, high = at.format(1), at.format(2)
    interpolated = f"transform({points}, p -> {low} + ({high} - {low}) * (p * (n - 1) - floor(p * (n - 1))))"
    return found.select(*keys, "n", F.expr(interpolated).alias("quantiles"))


def with_quantiles(
    df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float], name: str = "_quantiles"
) -> DataFrame:
    """``df`` with the quantile array of each row's group."""
    table = quantile_table(df, keys, col, probs).withColumnRenamed("quantiles", name)
    return _with_group_array(df, table, keys, name)


def _reached(limit: Column, order: Sequence[str]) -> Column:
    """Whether the row is at or after ``limit`` in the order, column by column, nulls first; null
    where there is no limit.

    Structs compare in just that way. Spelled out column by column, the tests of all limits make code so long
    that a row takes ten times as long.
    """
    return F.struct(*order) >= limit


def ntile_groups(
    df: DataFrame, col: str, n: int, tiebreak: Sequence[str], keys: Sequence[str] = (), name: str = "group"
) -> DataFrame:
    """SQL ``ntile(n)`` over (col, tiebreak) within each key, as a column; null where ``col`` is null.

    ``tiebreak`` must make the rows of a group unique.
    """
    order = [col, *tiebreak]

    # First rank of every bucket but the first; the first (size mod n) buckets hold one row more.
    # The last entry lies past the end of the group and is never found.
    ranks = F.expr(f"transform(sequence(1, {n}), i -> (n - n % {n}) div {n} * i + least(i, n % {n}) + 1)")
    # In the order of the ranks; a group smaller than n has fewer limits.
    sorted_ranks = F.array_sort(F.map_keys("stats"))
    table = order_statistics(df, keys, order, ranks, unique=True).withColumn(
        "_limits", F.transform(sorted_ranks, lambda r: F.element_at("stats", r))
    )
    limited = _with_group_array(df, table, keys, "_limits")
    bucket = 1 + passed(n - 1, lambda i: _reached(F.get("_limits", i), order))
    return limited.withColumn(name, F.when(F.col(col).isNotNull(), bucket)).drop("_limits")


def quantile_groups(df: DataFrame, col: str, n: int, name: str = "group") -> DataFrame:
    """Bands between the n-quantiles, left-closed, so equal values stay together; 1-based."""
    cut = with_quantiles(df, [], col, [i / n for i in range(1, n)])
    below = passed(n - 1, lambda i: F.get("_quantiles", i) <= F.col(col))
    return cut.withColumn(name, F.when(F.col(col).isNotNull(), below + 1)).drop("_quantiles")


def position_groups(
    df: DataFrame, col: str, n: int, keys: Sequence[str] = (), name: str = "group"
) -> DataFrame:
    """0-based groups split at the values in the sorted places round(i(N+1)/n - 1), i = 1..n-1.

    A value equal to a limit falls below it; halves round to even. The places exist in groups of
    at least n - 1 rows; a smaller group stops the query.
    """
    if n < 2:
        raise ValueError("at least two groups")
    places = f"transform(sequence(1, {n - 1}), i -> cast(rint(i * (n + 1) / {n} - 1) as bigint) + 1)"
    kind = dict(df.dtypes)[col]
    table = order_statistics(df, keys, [col], F.expr(places)).withColumn(
        "_limits",
        F.when(
            F.col("n") < n - 1, F.raise_error(F.lit(f"fewer than {n - 1} rows cannot make {n} groups")).cast(f"array<{kind}>")
        ).otherwise(F.expr(f"transform({places}, r -> stats[r].`{col}`)")),
    )
    limited = _with_group_array(df, table, keys, "_limits")
    below = passed(n - 1, lambda i: F.get("_limits", i) < F.col(col))
    return limited.withColumn(name, F.when(F.col(col).isNotNull(), below)).drop("_limits")


def dense_ranks(df: DataFrame, order: str, desc: bool = False, name: str = "position") -> DataFrame:
    """1-based dense rank of each row by ``order``, from the running count of distinct values."""
    key = F.desc(order) if desc else F.asc(order)
    distinct = materialize(
        df.select(order).dropna().distinct().repartitionByRange(key).withColumn("_part", F.spark_partition_id()),
        "distinct",
    )
    per_part = distinct.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition.
    starts = per_part.withColumn("_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    places = distinct.join(starts.drop("_size"), "_part").select(
        order, (F.col("_before") + within).alias(name)
    )
    return null_safe_join(df, materialize(places, "places"), [order])
