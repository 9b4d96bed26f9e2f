"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Settings that fit both a laptop and a cluster. Partition counts are left to adaptive
# execution, which merges small shuffle blocks.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# On a cluster shuffles start from many partitions, so that a stage over terabytes gets blocks
# an executor can sort in memory; adaptive execution merges them where the data is small.
CLUSTER_CONF = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
}


def build_session(master: str | None = None, app: str = "seriesloom", **conf: str) -> SparkSession:
    """Start (or reuse) a session with the defaults above; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    local = master is not None and master.startswith("local")
    for key, value in {**SESSION_CONF, **({} if local else CLUSTER_CONF), **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local"):
        ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import its functions.

    `build_session` does so on a cluster; call it for a session that was built elsewhere and
    whose executors don't have the package.
    """
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="seriesloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "seriesloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for at, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(home)))
    spark.sparkContext.addPyFile(archive)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file systems; an absent one is no error."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


_SCOPES: list[str] = []


@contextmanager
def scratch_scope(spark: SparkSession, label: str) -> Iterator[str]:
    """Scratch tables written inside lie in one folder, which is deleted at the end.

    For jobs that write all their results: nothing that is read later may depend on them.
    """
    folder = scratch_dir(spark, label)
    _SCOPES.append(folder)
    try:
        yield folder
    finally:
        _SCOPES.remove(folder)
        delete_folder(spark, folder)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for a written table, below the cluster's shared checkpoint folder.

    The folder named by `spark.checkpoint.dir` is used when the session has one. Only a
    local session may fall back to a temporary folder of this machine: on a cluster the
    executors would each write to their own disk.
    """
    if _SCOPES:
        return f"{_SCOPES[-1]}/{label}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="seriesloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
