"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.framework import Check
from checks.views import view
from hearthpanel.operators.panel import preview_sorted
from hearthpanel.operators.reshape import long_to_wide
from hearthpanel.sources import files, waves
from hearthpanel.workspace import new_path

ORDER_BOOK = {"o_orderkey": "row", "o_custkey": "pid", "o_totalprice": "income", "o_comment": "remark"}
RUN_SCHEMA = "hid bigint, year int, income double, liquidity double, pv int, run string, seed int"


def order_waves(spark: SparkSession, sf: str) -> str:
    """The orders as two wave files, the second without the priority column."""
    folder = new_path(spark, "waves")
    orders = view(spark, sf, "orders")
    odd = F.year("o_orderdate") % 2 == 1
    orders.filter(odd).write.parquet(f"{folder}/orders_a.parquet")
    orders.filter(~odd).drop("o_orderpriority").write.parquet(f"{folder}/orders_b.parquet")
    return f"{folder}/orders_*.parquet"


def yearly_series(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "series")
    means = view(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("v"))
    years = [str(y) for y in range(1995, 2002)]
    wide = long_to_wide(means.withColumn("all", F.lit(1)), ["all"], "year", "v", years).drop("all")
    wide.write.csv(path, header=True)
    return files.series_csv_to_long(spark, path)


def percentile_vector(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "vector")
    means = view(spark, sf, "orders").groupBy((F.col("o_custkey") % 100).alias("p")).agg(F.avg("o_totalprice").alias("v"))
    wide = long_to_wide(means.withColumn("all", F.lit(1)), ["all"], "p", "v", [str(p) for p in range(100)]).drop("all")
    wide.write.csv(path)
    return files.indexed_vector_csv(spark, path)


def run_results(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "runs")
    states = view(spark, sf, "hs").withColumn("seed", (F.col("hid") % 3 + 1).cast("int"))
    files.write_run_csv(states.select("hid", "year", "income", "liquidity", "pv", "run", "seed"), path)
    return files.read_run_results(spark, path, RUN_SCHEMA)


def late_waves(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot of the early waves with wrong incomes in one; then that wave again and the later ones."""
    path, rows = new_path(spark, "late"), view(spark, sf, "py").select("pid", "hid", "year", "income", "LodgeEnglish")
    first = rows.filter("year <= 2008").withColumn("income", F.when(F.col("year") == 2006, 0.0).otherwise(F.col("income")))
    waves.write_waves(first, path, "year")
    waves.write_waves(rows.filter("year = 2006 or year > 2008"), path, "year")
    return waves.read_waves(spark, path)


CHECKS = [
    Check(
        "scan_union_waves",
        "o_orderkey:i o_custkey:i o_totalprice:r2 o_orderpriority:s",
        lambda s, d: files.scan_union_waves(s, order_waves(s, d)),
        """SELECT o_orderkey, o_custkey, o_totalprice,
            CASE WHEN year(o_orderdate) % 2 = 1 THEN o_orderpriority END AS o_orderpriority FROM orders""",
    ),
    Check(
        "codebook_select_rename",
        "row:i pid:i income:r2",
        lambda s, d: files.codebook_select_rename(view(s, d, "orders"), ORDER_BOOK),
        "SELECT o_orderkey AS row, o_custkey AS pid, o_totalprice AS income FROM orders",
    ),
    Check(
        "series_csv_to_long",
        "year:i value:r4",
        yearly_series,
        "SELECT year(o_orderdate) AS year, avg(o_totalprice) AS value FROM orders GROUP BY 1",
    ),
    Check(
        "indexed_vector_csv",
        "percentile:i value:r4",
        percentile_vector,
        "SELECT o_custkey % 100 AS percentile, avg(o_totalprice) AS value FROM orders GROUP BY 1",
    ),
    Check(
        "write_snapshot",
        "pid:i hid:i year:i income:r2 LodgeEnglish:s",
        lambda s, d: files.write_snapshot(view(s, d, "py"), new_path(s, "snapshot"), ["year"]),
        "SELECT * FROM py",
    ),
    Check(
        "write_waves",
        "pid:i hid:i year:i income:r2 LodgeEnglish:s",
        late_waves,
        "SELECT pid, hid, year, income, LodgeEnglish FROM py",
    ),
    Check(
        "write_run_csv",
        "run:s seed:i hid:i year:i income:r4 liquidity:r4 pv:i",
        run_results,
        "SELECT *, hid % 3 + 1 AS seed FROM hs",
    ),
    Check(
        "preview_sorted",
        "hid:i year:i income:r2",
        lambda s, d: preview_sorted(view(s, d, "hw"), [F.desc("year"), F.asc("hid")]),
        "SELECT * FROM hw ORDER BY year DESC, hid LIMIT 6",
    ),
    Check(
        "read_run_results",
        "run:s seed:i year:i households:i income:r4",
        lambda s, d: run_results(s, d)
        .groupBy("run", "seed", "year")
        .agg(F.count("hid").alias("households"), F.avg("income").alias("income")),
        """SELECT run, hid % 3 + 1 AS seed, year, count(*) AS households, avg(income) AS income
            FROM hs GROUP BY 1, 2, 3""",
    ),
]
