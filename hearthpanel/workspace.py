"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A written table survives the loss of executors, is computed once however often it is read, and
has a size the planner knows: small ones are broadcast within
``spark.sql.autoBroadcastJoinThreshold``, larger ones are shuffled and adaptive execution may
split their skewed partitions.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Rows of one file of an intermediate table. A table of a few megabytes may hold millions of rows, and every
# row may carry much work; a file is the least that Spark hands to a task. Any number gives the same rows.
FILE_ROWS = 100_000

_roots: dict[str, str] = {}
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def work_folder(spark: SparkSession) -> str:
    """The folder of this application below the configured checkpoint folder."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            # One machine, one process: its own temporary folder is shared by all tasks.
            base = tempfile.mkdtemp(prefix="hearthpanel-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        _roots[app] = f"{base.rstrip('/')}/hearthpanel-{app}"
    return _roots[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_scope.get() or work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and return a scan of the written table.

    Files are cut by rows, so the scan spreads over tasks as rows grow, however well they compress and
    however few tasks wrote them.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted at the end, whether the work succeeds or fails.

    They live until then, so executors may be lost meanwhile. Write or collect what is wanted inside: lazy
    results still read the tables. Scopes may be nested; each deletes its own tables.
    """
    place = f"{_scope.get() or work_folder(spark)}/scope-{uuid.uuid4().hex[:12]}"
    token = _scope.set(place)
    try:
        yield
    finally:
        _scope.reset(token)
        _delete(spark, place)


def write_result(
    spark: SparkSession, make: Callable[[], DataFrame], path: str, mode: str = "error", partition_by: Sequence[str] = ()
) -> DataFrame:
    """Write the DataFrame that ``make`` returns as Parquet, delete all tables made on the way, return a scan."""
    with scope(spark):
        result = make()
        result.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(result.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def clear_work(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results read from them are lost."""
    _delete(spark, work_folder(spark))
