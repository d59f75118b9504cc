"""Joins of two tables with hot keys, against plain joins."""

import pytest
from pyspark.sql import functions as F

from hearthpanel.operators import hot_joins, joins


def keyed(spark, counts, value):
    rows = [(k, i, f"{value}{i}") for k, n in counts for i in range(n)]
    return spark.createDataFrame(rows, f"k string, {value}_id int, {value} string").repartition(7)


SIDES = {
    "left": ([("hot", 3000), (None, 900), ("a", 40), ("b", 3)], [("hot", 30), (None, 4), ("a", 2), ("c", 5)]),
    "right": ([("hot", 3), (None, 2), ("a", 40), ("b", 3)], [("hot", 3000), (None, 900), ("a", 2), ("c", 5000)]),
    "both": ([("hot", 400), ("b", 700)], [("hot", 300), ("c", 700)]),
    "empty": ([("hot", 400)], []),
}


@pytest.mark.parametrize("sides", SIDES)
@pytest.mark.parametrize("how", ["left", "inner"])
def test_rows_of_a_plain_join(spark, rows, sides, how):
    left, right = [keyed(spark, counts, v) for counts, v in zip(SIDES[sides], ("x", "y"))]
    left = left.unionByName(left.filter("x_id < 2"))  # repeated rows
    got = hot_joins.split_join(left, right, ["k"], how, cell_rows=200)
    assert got.columns == ["k", "x_id", "x", "y_id", "y"]
    marked = right.withColumnRenamed("k", "k2")
    expected = left.join(marked, F.col("k").eqNullSafe(F.col("k2")), how).drop("k2")
    assert rows(got) == rows(expected)


def test_keys_of_both_sides_are_split(spark, rows):
    left, right = [keyed(spark, counts, v) for counts, v in zip(SIDES["both"], ("x", "y"))]
    grids = {r.k: (r._lines, r._columns) for r in hot_joins.hot_keys(left, right, ["k"], 200).collect()}
    assert grids == {"hot": (300, 2), "b": (4, 1), "c": (1, 4)}
    assert hot_joins.hot_keys(left, right, ["k"]) is None


def test_a_hot_key_is_no_task_of_its_own(spark, monkeypatch):
    """A key with a third of the left rows and 100 rows on the right; null keys as many."""
    left = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), F.col("id").alias("v")
    )
    right = spark.range(60100).select(F.when(F.col("id") < 100, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("w"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {c: spark.conf.get(c) for c in settings}
    for c, v in settings.items():
        spark.conf.set(c, v)
    try:
        sizes = {}
        for name, out in (
            ("plain", joins.natural_left_join(left, right, ["k"])), ("split", hot_joins.split_join(left, right, ["k"], cell_rows=2000))
        ):
            assert out.count() == 20000 * 100 + 40000
            sizes[name] = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sizes["plain"][-1] > 2 * sizes["plain"][len(sizes["plain"]) // 2]
    assert sizes["split"][-1] <= 2 * sizes["split"][4]


def test_long_keys_maps_and_clashes(spark, rows):
    long = "z" * 5000
    left = spark.createDataFrame([(long, {"a": i}) for i in range(900)], "k string, m map<string,int>")
    right = spark.createDataFrame([(long, 1), ("q", 2)], "k string, w int")
    assert hot_joins.hot_keys(left, right, ["k"], 100) is None
    assert hot_joins.split_join(left.withColumn("k", F.lit("q")), right, ["k"], cell_rows=100).filter("w = 2").count() == 900
    with pytest.raises(ValueError, match="both sides"):
        hot_joins.split_join(right, right, ["k"])
    with pytest.raises(ValueError, match="outer"):
        hot_joins.split_join(left, right, ["k"], "outer")


def test_key_types_may_differ(spark, rows):
    left = spark.range(1000).select((F.col("id") % 2).cast("int").alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k bigint, w string")
    got = joins.chain_left_join([left, right], ["k"], split_hot=True)
    assert hot_joins.hot_keys(left, right, ["k"], 100).count() == 2
    assert hot_joins.split_join(left, right, ["k"], cell_rows=100).groupBy("w").count().count() == 3
    assert got.count() == 1500
