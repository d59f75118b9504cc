"""Snapshots that waves are added to, failed and concurrent writers, tables in buckets."""

import pytest
from pyspark.sql import functions as F

from hearthpanel.operators.joins import chain_left_join
from hearthpanel.sources import waves


def frame(spark, rows, schema="id long, year int, v double"):
    return spark.createDataFrame(rows, schema)


def test_waves_are_added_and_replaced(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    assert waves.write_waves(frame(spark, [(1, 2005, 1.0), (2, 2006, 2.0), (3, 2007, None)]), path, "year") == 1
    assert waves.write_waves(frame(spark, [(4, 2006, 5.0), (5, 2008, 6.0)]), path, "year") == 2
    assert rows(waves.read_waves(spark, path), "id", "year", "v") == [(1, 2005, 1.0), (3, 2007, None), (4, 2006, 5.0), (5, 2008, 6.0)]
    assert rows(waves.read_waves(spark, path, version=1), "id") == [(1,), (2,), (3,)]
    assert rows(waves.read_waves(spark, path, [2006, 2008, 1999]), "id") == [(4,), (5,)]
    assert waves.read_waves(spark, path, [1999]).count() == 0


def test_only_touched_waves_are_written_and_read(spark, tmp_path):
    path = str(tmp_path / "s")
    waves.write_waves(frame(spark, [(i, 2000 + i % 5, 1.0) for i in range(50)]), path, "year")
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "s" / "waves").rglob("*.parquet")}
    waves.write_waves(frame(spark, [(99, 2003, 7.0)]), path, "year")
    assert all(f.stat().st_mtime_ns == t for f, t in files.items())
    assert {f.split("_wave=")[1][:4] for f in waves.read_waves(spark, path, [2003]).inputFiles()} == {"2003"}


def test_a_run_that_fails_leaves_the_old_snapshot(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    waves.write_waves(frame(spark, [(1, 2005, 1.0), (2, 2006, 2.0)]), path, "year")
    # Some tasks write their files, one fails.
    bad = frame(spark, [(i, 2006, float(i)) for i in range(40)]).repartition(8)
    bad = bad.withColumn("v", F.when(F.col("id") == 17, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        waves.write_waves(bad, path, "year")
    assert waves.versions(spark, path) == [1]
    assert rows(waves.read_waves(spark, path), "id", "v") == [(1, 1.0), (2, 2.0)]
    with pytest.raises(Exception, match="unknown"):
        waves.write_waves(frame(spark, [(3, None, 1.0)]), path, "year")
    assert waves.write_waves(frame(spark, [(3, 2006, 3.0)]), path, "year") == 2
    assert waves.forget_versions(spark, path) >= 1
    assert rows(waves.read_waves(spark, path), "id", "v") == [(1, 1.0), (3, 3.0)]


def test_of_two_writers_one_stops(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    waves.write_waves(frame(spark, [(1, 2005, 1.0)]), path, "year")
    # The second writer looked before the first was done.
    monkeypatch.setattr(waves, "versions", lambda *_: [])
    with pytest.raises(RuntimeError, match="another run"):
        waves.write_waves(frame(spark, [(2, 2006, 1.0)]), path, "year")
    monkeypatch.undo()
    assert waves.read_waves(spark, path).count() == 1


def test_waves_with_other_columns_and_names(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    waves.write_waves(frame(spark, [(1, "a b/c", 1.0)], "id long, wave string, v double"), path, "wave")
    waves.write_waves(frame(spark, [(2, "d", "x")], "id long, wave string, w string"), path, "wave")
    assert rows(waves.read_waves(spark, path), "id", "wave", "v", "w") == [(1, "a b/c", 1.0, None), (2, "d", None, "x")]
    with pytest.raises(ValueError):
        waves.read_waves(spark, str(tmp_path / "none"))


def test_bucketed_tables_join_without_a_shuffle(spark, rows):
    names = [f"bucketed_{i}" for i in range(3)]
    keys = ["hid", "year"]
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plain = [spark.range(200).selectExpr("id % 90 AS hid", "CAST(id % 7 AS INT) AS year", f"id * {i + 1} AS v{i}").dropDuplicates(keys) for i in range(3)]
        tables = [waves.write_bucketed(df, n, keys, 4) for df, n in zip(plain, names)]
        joined = chain_left_join(tables, keys, known_keys=True)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
        assert rows(joined) == rows(chain_left_join(plain))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")
