"""Written tables: Parquet cache, CSV and JSON sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from seriesloom.session import scratch_dir


def write_panel(df: DataFrame, path: str, keys: tuple[str, ...] = ("series_id", "date")) -> None:
    """Write a panel clustered by series, so that Parquet statistics prune by series.

    Clustering within files is used instead of one folder per series: a panel of millions
    of series would otherwise write millions of small files.
    """
    present = [k for k in keys if k in df.columns]
    out = df
    if present:
        out = df.repartition(present[0]).sortWithinPartitions(*present)
    out.write.mode("overwrite").parquet(path)


POINTER = "current.txt"


def _pointer(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{POINTER}")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def published(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that the cache at `path` points to; None without one."""
    files, place = _pointer(spark, path)
    if not files.exists(place):
        return None
    name = spark.read.text(place.toString()).first()[0]
    return f"{path.rstrip('/')}/{name}"


def publish(df: DataFrame, path: str) -> str:
    """Write a new version below `path`, then point to it.

    Readers follow the pointer, which is put in place by one rename after the write has
    ended: a write that dies is never read and blocks nothing. Readers of the version before
    keep their files; the one before that is deleted.
    """
    spark = df.sparkSession
    files, place = _pointer(spark, path)
    jvm = spark.sparkContext._jvm
    version = f"v-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{version}"
    before = published(spark, path)
    write_panel(df, folder)
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{POINTER}-{version}")
    out = files.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    files.delete(place, False)
    files.rename(fresh, place)
    for status in files.listStatus(place.getParent()):
        old = status.getPath()
        if old.getName().startswith("v-") and old.getName() not in (version, (before or "").rsplit("/", 1)[-1]):
            files.delete(old, True)
    return folder


def read_published(spark: SparkSession, path: str) -> DataFrame:
    folder = published(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no published table at {path}")
    return spark.read.parquet(folder)


def cached_table(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame], use_cache: bool = True
) -> DataFrame:
    """Read the table published at `path`; compute and publish it when absent or not wanted."""
    if not use_cache or published(spark, path) is None:
        publish(compute(), path)
    return read_published(spark, path)


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write the table to the shared scratch folder and go on from the files.

    Used where one result feeds many jobs (folds, candidates, repeats): the plan is run
    once, and a lost executor costs a re-read instead of the whole upstream plan.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
