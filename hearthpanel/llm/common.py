"""What several operators share: words, columns picked by exact name, order numbers of rows."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthpanel.workspace import materialize

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
# A worker holds a batch of texts and its results; texts may be long.
BATCH_ROWS = 500
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact spelling, so that further columns cannot clash."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The columns renamed by position, and the names to give back with ``renamed``."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def renamed(df: DataFrame, names: list[str], **replaced: Column) -> DataFrame:
    """Undo ``numbered``; ``replaced`` gives new values of columns by name."""
    return df.select(*[replaced.get(n, F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's text, modulo ``divisor``; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(divisor))


def range_parts(df: DataFrame, *order: Column) -> DataFrame:
    """A written copy of ``df`` in ranges of ``order``, with the number of the range as ``_part``."""
    return materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def with_ordinal(df: DataFrame, *order: Column) -> DataFrame:
    """Rows numbered from 0 as ``ordinal`` in a total order, without sorting all rows in one task."""
    parts = range_parts(df, *order)
    per_part = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per range, that is per task of the sort.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (
        parts.join(starts, "_part").withColumn("ordinal", (F.col("_start") + within).cast("long")).drop("_part", "_start")
    )


def prepare_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and hand them no more than
    ``BATCH_ROWS`` documents at a time. On a cluster whose machines do not have that folder, ship the
    package with ``--py-files``."""
    if int(spark.conf.get(_BATCH_SETTING)) > BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    given = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in given.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, given]))
    return spark
