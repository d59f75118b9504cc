"""Lifetimes of intermediate tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hearthpanel import workspace
from hearthpanel.operators import regression
from hearthpanel.operators.aggregates import quantile_trim


def tables(spark):
    return {str(p) for p in Path(workspace.work_folder(spark)).rglob("*.parquet")}


def test_a_job_leaves_only_its_result(spark, tmp_path):
    df = spark.range(3000).select(
        (F.col("id") % 40).alias("hid"), (F.col("id") % 11).alias("year"), (F.col("id") * 37 % 101).cast("double").alias("x"),
        (F.col("id") * 71 % 97).cast("double").alias("y"),
    )
    before = tables(spark)

    def job():
        rows = workspace.materialize(quantile_trim(df, "y", hi=0.9))
        return regression.ols_fitted(rows, [regression.ols_two_way_fe(rows, "y", ["x"], "year", "hid")])

    with workspace.scope(spark):
        want = {tuple(r) for r in job().collect()}
    got = workspace.write_result(spark, job, str(tmp_path / "out"))
    assert tables(spark) == before
    assert {tuple(r) for r in got.collect()} == want and len(want) > 0
    by_year = workspace.write_result(spark, job, str(tmp_path / "years"), partition_by=["year"])
    assert by_year.count() == got.count() and tables(spark) == before


def test_nested_and_failing_scopes(spark):
    before = tables(spark)
    df = spark.range(10)
    with pytest.raises(RuntimeError):
        with workspace.scope(spark):
            outer = workspace.materialize(df)
            with workspace.scope(spark):
                assert workspace.materialize(df).count() == 10
            assert outer.count() == 10 and len(tables(spark)) > len(before)
            raise RuntimeError
    assert tables(spark) == before
    assert workspace.materialize(df).count() == 10 and len(tables(spark)) > len(before)


def test_scan_spreads_over_tasks_as_rows_grow(spark):
    """A table that one task wrote in few bytes is read by several tasks, with the same rows."""
    df = spark.range(200_001).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("few")).coalesce(1)
    written = workspace.materialize(df)
    assert written.rdd.getNumPartitions() > 1
    assert sorted(map(tuple, written.groupBy("few").count().collect()), key=str) == sorted(
        map(tuple, df.groupBy("few").count().collect()), key=str
    )
