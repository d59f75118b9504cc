"""Group statistics joined back, for null keys and hot keys."""

import pytest
from pyspark.sql import functions as F

from hearthpanel.operators import joins, keyed, panel


@pytest.fixture
def skewed(spark):
    hot = [("hot", i, float(i)) for i in range(600)]
    cold = [(f"k{i % 90}", i, float(i)) for i in range(300)]
    return spark.createDataFrame(hot + cold + [(None, 1, 1.0), (None, 2, 3.0)], "k string, id int, v double")


@pytest.mark.parametrize("limit", [1_000_000, 100])
def test_group_stats(skewed, rows, monkeypatch, limit):
    monkeypatch.setattr(keyed, "HOT_ROWS", limit)
    monkeypatch.setattr(keyed, "HOT_SHARE", 1 / 10)
    monkeypatch.setattr(keyed, "SALTS", 5)
    out = keyed.group_stats(skewed, ["k"], most=F.max("v"), n=F.count("v"))
    assert out.columns == ["k", "id", "v", "most", "n"]
    groups = {}
    for k, _, v in rows(skewed):
        groups.setdefault(k, []).append(v)
    expected = [(k, i, v, max(groups[k]), len(groups[k])) for k, i, v in rows(skewed)]
    assert rows(out) == sorted(expected, key=lambda r: tuple((x is not None, str(x)) for x in r))
    salted = "_is_hot" in out._jdf.queryExecution().optimizedPlan().toString()
    assert salted == (limit == 100)


def test_replaced_column(skewed, rows):
    out = panel.spell_max_broadcast(skewed, ["k"], "v").filter("k is null")
    assert rows(out, "id", "v") == [(1, 3.0), (2, 3.0)]


def test_null_keys_match(spark, rows):
    left = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id int, k string")
    right = spark.createDataFrame([(None, 10), ("x", 20)], "k string, w int")
    assert rows(joins.natural_left_join(left, right), "id", "w") == [(1, 10), (2, 20), (3, None)]


def test_codebook_must_be_unique(spark):
    left = spark.createDataFrame([("a",)], "code string")
    with pytest.raises(ValueError):
        joins.codebook_join(left, spark.createDataFrame([("a", 1), ("a", 2)], "code string, x int"), "code")


def test_scalars_need_one_row(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        joins.broadcast_scalars(df, spark.range(2).toDF("x"))


def test_cumulative_flag_skips_unknown(spark, rows):
    data = [(1, 2005, None), (1, 2006, 0), (1, 2007, 1), (1, 2008, None), (1, 2009, 0), (2, 2005, 0), (3, 2005, None)]
    df = spark.createDataFrame(data, "p int, year int, f int")
    got = rows(panel.cumulative_flag(df, ["p"], "year", "f"), "p", "year", "f")
    assert got == [
        (1, 2005, None), (1, 2006, 0), (1, 2007, 1), (1, 2008, 1), (1, 2009, 1), (2, 2005, 0), (3, 2005, None)
    ]


def test_shares_sum_to_100(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    sums = panel.share_of_group(df, ["k"], "v").groupBy("k").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 100) < 1e-9 for r in sums)


def test_impute_drops_groups_without_value(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", None)], "k string, v double")
    assert rows(panel.group_mean_impute(df, ["k"], "v")) == [("a", 1.0), ("a", 2.0), ("a", 2.0)]


def test_earlier_values_need_the_period_before(spark, rows):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 4.0), ("a", 4, 9.0)], "k string, t int, v double")
    got = rows(panel.earlier_values(df, ["k"], "t", {"b": ("v", 1), "c": ("v", 2), "was": ("t", 1)}))
    assert got == [("a", 1, 1.0, None, None, None), ("a", 2, 4.0, 1.0, None, 1), ("a", 4, 9.0, None, 4.0, None)]


def test_balanced_panel(spark, rows):
    df = spark.createDataFrame([(1, 2005), (1, 2006), (2, 2005), (3, 2004), (3, 2005), (3, 2006)], "hid int, year int")
    assert rows(panel.balanced_panel(df, "hid", 2005, 2006)) == [(1, 2005), (1, 2006), (3, 2005), (3, 2006)]


def test_spell_age_resets_later_starts(spark, rows):
    df = spark.createDataFrame(
        [(1, 2017, 0, 2010, 1), (2, 2016, 0, 2010, 1), (3, 2017, 0, 2018, 1), (4, 2017, 0, None, 0)],
        "hid int, year int, YearMoved int, PanelYear int, pv int",
    )
    assert rows(panel.spell_age(df, 2017), "hid", "PanelAge", "pv") == [(1, 7, 1), (2, None, 1), (3, None, 0), (4, None, 0)]


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_earlier_values_across_blocks(spark, rows, monkeypatch, block):
    monkeypatch.setattr(panel, "BLOCK", block)
    periods = [t for t in range(-9, 40) if t % 7 != 3]
    data = [("one", t, float(t * t)) for t in periods] + [(None, t, 1.0 * t) for t in periods] + [("one", None, 5.0), ("one", None, 6.0)]
    df = spark.createDataFrame(data, "k string, t int, v double").repartition(5)
    got = rows(panel.earlier_values(df, ["k"], "t", {"b": ("v", 1), "c": ("v", 3)}))
    at = {(k, t): v for k, t, v in data if t is not None}
    expected = [(k, t, v, *[None if t is None else at.get((k, t - n)) for n in (1, 3)]) for k, t, v in data]
    assert got == sorted(expected, key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_earlier_values_shuffle_rows_once(spark):
    df = spark.range(1000).select((F.col("id") * 0).alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    out = panel.earlier_values(df, ["k"], "t", {"b": ("v", 1)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and out.filter("b is not null").count() == 999
    dates = df.select("k", F.date_add(F.lit("1969-12-30").cast("date"), F.col("t").cast("int")).alias("d"), "v")
    assert panel.earlier_values(dates, ["k"], "d", {"b": ("v", 1)}).filter("b = v - 1").count() == 999
