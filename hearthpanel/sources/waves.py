"""Snapshots of survey waves that arrive one after the other.

A snapshot is a folder of wave folders and commit records. Writing waves adds new folders for the waves the
data holds and then one record that says which folder every wave of the snapshot is in; waves that are not
touched keep theirs. A record appears under its name in one step, after all its files are written, and
readers follow the last record only. A run that fails leaves the snapshot as it was, and files no record
names. Two writers at a time cannot both take the next number: the second one stops.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RECORDS, _DATA = "_commits", "waves"


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits of a snapshot, oldest first."""
    hadoop, fs = _files(spark, path)
    folder = hadoop.Path(f"{path}/{_RECORDS}")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def _record(spark: SparkSession, path: str, version: int) -> dict:
    text = spark.read.text(f"{path}/{_RECORDS}/{version:08d}", wholetext=True).first()[0]
    return json.loads(text)


def write_waves(df: DataFrame, path: str, wave: str, codec: str = "gzip") -> int:
    """Replace the waves that ``df`` holds, keep all others, and return the number of the commit.

    The column ``wave`` must be a whole number or text, of few values (a survey has some dozens), and known.
    """
    spark = df.sparkSession
    before = versions(spark, path)
    known = _record(spark, path, before[-1])["waves"] if before else {}
    folder = f"{_DATA}/{uuid.uuid4().hex}"
    # Rows of a wave stay where they are: a task writes a file for each wave it has.
    kept = df.withColumn("_wave", F.coalesce(F.col(wave).cast("string"), F.raise_error(F.lit(f"{wave} is unknown"))))
    kept.write.option("compression", codec).partitionBy("_wave").parquet(f"{path}/{folder}")
    hadoop, fs = _files(spark, path)
    written = [f.getPath().getName() for f in fs.listStatus(hadoop.Path(f"{path}/{folder}")) if f.isDirectory()]
    touched = {n.split("=", 1)[1]: f"{folder}/{n}" for n in written if n.startswith("_wave=")}
    number = before[-1] + 1 if before else 1
    record = {"wave": wave, "waves": {**known, **touched}}
    _commit(spark, path, number, json.dumps(record, sort_keys=True))
    return number


def _commit(spark: SparkSession, path: str, number: int, text: str) -> None:
    hadoop, fs = _files(spark, path)
    made = hadoop.Path(f"{path}/{_RECORDS}/.{uuid.uuid4().hex}")
    out = fs.create(made, False)
    out.write(bytearray(text.encode()))
    out.close()
    final = hadoop.Path(f"{path}/{_RECORDS}/{number:08d}")
    # A rename never replaces a file, so of two writers one fails.
    if fs.exists(final) or not fs.rename(made, final):
        fs.delete(made, False)
        raise RuntimeError(f"another run has written commit {number} of {path}")


def read_waves(spark: SparkSession, path: str, waves: Sequence[object] | None = None, version: int | None = None) -> DataFrame:
    """The rows of a snapshot as of its last commit (or an earlier one), of all waves or the given ones.

    Waves may have different columns; those a wave lacks are null.
    """
    numbers = versions(spark, path)
    if not numbers or (version is not None and version not in numbers):
        raise ValueError(f"{path} has no commit {'' if version is None else version}".rstrip())
    record = _record(spark, path, numbers[-1] if version is None else version)
    chosen = record["waves"] if waves is None else {str(w): record["waves"][str(w)] for w in waves if str(w) in record["waves"]}
    if not chosen:
        return spark.read.parquet(*[f"{path}/{p}" for p in record["waves"].values()]).limit(0)
    # Folders that one run wrote have the same columns and are one scan.
    runs: dict[str, list[str]] = {}
    for place in chosen.values():
        runs.setdefault(place.rsplit("/", 1)[0], []).append(f"{path}/{place}")
    frames = [spark.read.parquet(*sorted(places)) for _, places in sorted(runs.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def forget_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all but the last ``keep`` commits and every folder none of these names; returns how many folders.

    Only for times when nothing else writes the snapshot or reads its older commits.
    """
    numbers = versions(spark, path)
    hadoop, fs = _files(spark, path)
    needed = {p.split("/")[1] for n in numbers[-keep:] for p in _record(spark, path, n)["waves"].values()}
    for n in numbers[:-keep]:
        fs.delete(hadoop.Path(f"{path}/{_RECORDS}/{n:08d}"), False)
    gone = [f.getPath() for f in fs.listStatus(hadoop.Path(f"{path}/{_DATA}")) if f.getPath().getName() not in needed]
    for place in gone:
        fs.delete(place, True)
    return len(gone)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write ``df`` as a table in buckets of ``keys``, sorted within each, and return it.

    Tables with equal buckets join on these keys without a shuffle (see ``natural_left_join`` with
    ``known_keys``). Rows are first sent to their buckets, so that each bucket is one file.
    """
    placed = df.repartition(buckets, *keys)
    placed.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)
