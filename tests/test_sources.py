"""Files written and read back."""

from pyspark.sql import functions as F

from hearthpanel import workspace
from hearthpanel.sources import files


def test_waves_with_different_columns(spark, rows, tmp_path):
    spark.createDataFrame([(1, "x")], "id int, a string").write.parquet(f"{tmp_path}/w_1.parquet")
    spark.createDataFrame([(2, 5.0)], "id int, b double").write.parquet(f"{tmp_path}/w_2.parquet")
    assert rows(files.scan_union_waves(spark, f"{tmp_path}/w_*.parquet"), "id", "a", "b") == [(1, "x", None), (2, None, 5.0)]


def test_codebook_skips_absent_variables(spark):
    df = spark.createDataFrame([(1, 2, 3)], "x int, y int, z int")
    out = files.codebook_select_rename(df, {"z": "last", "none": "absent", "x": "first"})
    assert out.columns == ["last", "first"] and tuple(out.first()) == (3, 1)


def test_series_and_vector(spark, rows, tmp_path):
    (tmp_path / "s.csv").write_text("2000,2001,2002\n0.5,0.25,\n")
    assert rows(files.series_csv_to_long(spark, f"{tmp_path}/s.csv")) == [(2000, 0.5), (2001, 0.25), (2002, None)]
    (tmp_path / "v.csv").write_text(",".join(str(i / 2) for i in range(100)) + "\n")
    got = files.indexed_vector_csv(spark, f"{tmp_path}/v.csv").orderBy("percentile").collect()
    assert [(r.percentile, r.value) for r in got] == [(i, i / 2) for i in range(100)]


def test_runs(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "base", 1), (2, None, "base", 2)], "year int, v double, run string, seed int")
    files.write_run_csv(df, f"{tmp_path}/runs")
    assert (tmp_path / "runs" / "run=base" / "seed=2").is_dir()
    back = files.read_run_results(spark, f"{tmp_path}/runs", "year int, v double, run string, seed int")
    assert rows(back) == rows(df)


def test_snapshot(spark, tmp_path):
    out = files.write_snapshot(spark.range(10).withColumn("year", F.col("id") % 2), f"{tmp_path}/s", ["year"])
    assert out.count() == 10 and list((tmp_path / "s").glob("year=0/*.gz.parquet"))
    pruned = out.filter("year = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in pruned


def test_work_folder_is_the_configured_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "_roots", {})
    assert workspace.work_folder(spark).startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    monkeypatch.setattr(workspace, "_roots", {spark.sparkContext.applicationId: f"{tmp_path}/work"})
    assert workspace.materialize(spark.range(3)).count() == 3
    workspace.clear_work(spark)
    assert not list(tmp_path.iterdir())


def test_waves_of_differing_types(spark, tmp_path, rows):
    spark.createDataFrame([(1, 2)], "id int, v int").write.parquet(f"{tmp_path}/w_1.parquet")
    spark.createDataFrame([(2, 2.5)], "id bigint, v double").write.parquet(f"{tmp_path}/w_2.parquet")
    spark.createDataFrame([(3, "x")], "id int, t string").write.parquet(f"{tmp_path}/w_3.parquet")
    got = files.scan_union_waves(spark, f"{tmp_path}/w_*.parquet")
    assert dict(got.dtypes) == {"id": "bigint", "v": "double", "t": "string"}
    assert rows(got, "id", "v", "t") == [(1, 2.0, None), (2, 2.5, None), (3, None, "x")]


def test_vector_of_any_length(spark, tmp_path):
    for n in (99, 101):
        (tmp_path / f"v{n}.csv").write_text(",".join(str(i / 2) for i in range(n)) + "\n")
        got = files.indexed_vector_csv(spark, f"{tmp_path}/v{n}.csv").orderBy("percentile").collect()
        assert [tuple(r) for r in got] == [(i, i / 2) for i in range(n)]
