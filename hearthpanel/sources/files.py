"""Files in, files out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthpanel.operators.reshape import stack_families


# Each type holds the values of those before it.
_WIDENING = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()]


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    both = [T.DoubleType() if isinstance(t, (T.FloatType, T.DecimalType)) else t for t in (a, b)]
    if any(t not in _WIDENING for t in both):
        raise ValueError(f"no common type of {a.simpleString()} and {b.simpleString()}")
    return max(both, key=_WIDENING.index)


def scan_union_waves(spark: SparkSession, pattern: str) -> DataFrame:
    """Every wave (Parquet file or folder) whose path matches ``pattern``, stacked; columns a wave
    lacks are null, columns whose type differs between waves get the wider one. One footer is read
    per wave."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    waves = [spark.read.parquet(p) for p in sorted(s.getPath().toString() for s in found)]
    if not waves:
        raise FileNotFoundError(pattern)
    types: dict[str, T.DataType] = {}
    for field in (f for w in waves for f in w.schema):
        types[field.name] = _wider(types.get(field.name, field.dataType), field.dataType)
    return stack_families([w.select(*[F.col(c).cast(types[c]).alias(c) for c in w.columns]) for w in waves])


def codebook_select_rename(df: DataFrame, codebook: Mapping[str, str]) -> DataFrame:
    """Keep the columns the codebook (source name -> study name) lists and rename them.

    Columns are matched by name; an entry the file lacks is skipped.
    """
    return df.select(*[F.col(source).alias(study) for source, study in codebook.items() if source in df.columns])


def series_csv_to_long(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of one row whose columns are years -> rows (year, value)."""
    wide = spark.read.csv(path, header=True)
    long = wide.unpivot([], wide.columns, "year", "value")
    return long.select(F.col("year").cast("int"), F.col("value").cast("double"))


def indexed_vector_csv(spark: SparkSession, path: str, index: str = "percentile") -> DataFrame:
    """A headerless CSV row of any number of values -> rows (index, value), counted from 0."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    values = rows.select(F.posexplode(F.split("value", ",")).alias(index, "value"))
    number = F.nullif(F.trim(F.col("value"), F.lit('" ')), F.lit(""))
    return values.select(index, number.cast("double").alias("value"))


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = (), codec: str = "gzip") -> DataFrame:
    """Write a stage as compressed Parquet and return a scan of it.

    Partitioning by a low-cardinality column such as the year lets later reads skip folders.
    """
    writer = df.write.mode("overwrite").option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_run_csv(df: DataFrame, path: str, run: str = "run", seed: str = "seed") -> None:
    """Write result tables as CSV in one folder per run name and seed."""
    df.write.mode("overwrite").partitionBy(run, seed).csv(path, header=True)


def read_run_results(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Read what ``write_run_csv`` wrote; the schema names run and seed among the columns."""
    return spark.read.csv(path, header=True, schema=schema)
