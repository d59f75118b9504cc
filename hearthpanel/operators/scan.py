"""Running states of ordered series as a distributed scan.

A state that every row changes by a map whose compositions have a fixed size (an affine map, say) needs no
pass over a whole series in one task. Periods are cut into blocks of ``BLOCK``, a block's maps are composed
into one, the blocks' maps again in blocks, until one is left per series: a tree of groupings. On the way
back every block hands each of its children the state before it. So no task and no row ever holds more
than ``BLOCK`` steps of a series, and a series with most rows spreads like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.operators.keyed import null_safe_join
from hearthpanel.workspace import materialize

BLOCK = 64


def running_states(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    step: Column,
    compose: Callable[[Column, Column], Column],
    apply: Callable[[Column, Column], Column],
    start: Column,
    name: str = "state",
) -> DataFrame:
    """``df`` with the state after each row as the struct ``name``.

    ``order`` holds whole numbers, each once per series. ``step`` is the row's map, ``compose(first, second)``
    their composition and ``apply(map, state)`` the state after it; both must give structs of the same type.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        return df.withColumn(name, start)
    columns = [c for c in df.columns if c not in keys]
    rows = df.select(*keys, (F.col(order) - F.lit(low)).cast("long").alias("_pos"), step.alias("_map"), F.struct(*columns).alias("_row"))
    levels, reach = [], int(high) - int(low)
    while True:
        children = rows.withColumn("_block", F.shiftright("_pos", BLOCK.bit_length() - 1)).groupBy(*keys, "_block").agg(
            # At most BLOCK rows.
            F.array_sort(F.collect_list(F.struct("_pos", "_map", *(["_row"] if not levels else [])))).alias("_children")
        )
        levels.append(materialize(children, "blocks"))
        reach >>= BLOCK.bit_length() - 1
        if not reach:
            break
        rest = F.slice("_children", 2, BLOCK)
        whole = F.aggregate(rest, F.col("_children")[0]["_map"], lambda a, c: compose(a, c["_map"]))
        rows = levels[-1].select(*keys, F.col("_block").alias("_pos"), whole.alias("_map"))
    before = levels[-1].select(*keys, "_block", start.alias("_before"))
    for depth, level in reversed(list(enumerate(levels))):
        given = null_safe_join(level, before, [*keys, "_block"], "inner")
        kind = f"array<{dict(given.dtypes)['_before']}>"

        def go_on(acc: Column, child: Column) -> Column:
            state = apply(child["_map"], acc["now"])
            return F.struct(state.alias("now"), F.concat(acc["all"], F.array(acc["now"] if depth else state)).alias("all"))

        begin = F.struct(F.col("_before").alias("now"), F.array().cast(kind).alias("all"))
        states = F.aggregate("_children", begin, go_on, lambda acc: acc["all"])
        each = F.explode(F.arrays_zip(F.col("_children").alias("child"), states.alias("seen"))).alias("_each")
        told = given.select(*keys, each)
        if depth:
            before = materialize(
                told.select(*keys, F.col("_each.child._pos").alias("_block"), F.col("_each.seen").alias("_before")), "before"
            )
    # Keys of a row are outside its struct.
    return told.select(*keys, "_each.child._row.*", F.col("_each.seen").alias(name)).select(*df.columns, name)
