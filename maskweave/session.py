"""Session settings and the shared work folder."""

from __future__ import annotations

import contextvars
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on; all but the first four are Spark defaults made explicit.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


# Default size of one file split.
SPLIT_BYTES = 128 * 1024 * 1024


def build_session(app: str = "maskweave", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; keyword names use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session's application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="maskweave-zip-")
        archive = shutil.make_archive(
            f"{folder}/maskweave", "zip", os.path.dirname(here), os.path.basename(here)
        )
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` when the cluster names one.

    Only a local master falls back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    fresh = tempfile.mkdtemp(prefix="maskweave-")
    spark.conf.set("spark.checkpoint.dir", fresh)
    return fresh


_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, for jobs that have written their results by then.

    Without it they stay, since a DataFrame that reads them may be used later.
    """
    paths: list[str] = []
    token = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage at a narrow table that several later steps read, so the expensive scan
    before it runs once and its result survives the loss of an executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    kept = _SCRATCH.get()
    if kept is not None:
        kept.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a DataFrame; starts no job."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


# Tables up to this size are spread over the cores by a shuffle; larger ones by their file splits.
SPREAD_BYTES = 256 * 1024 * 1024
SPREAD_ROW_BYTES = 256 * 1024


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a small input over the cores before per-row text work.

    Only tables of at most ``SPREAD_BYTES`` are shuffled, whatever the number of cores, and to no
    more tasks than their size is worth; a larger table has file splits enough, and
    ``spark.sql.files.maxPartitionBytes`` makes them smaller.  ``keys`` should name single rows.
    """
    size = plan_bytes(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if size <= SPREAD_BYTES and size * 4 < cores * SPLIT_BYTES:
        return df.repartition(min(cores, max(1, -(-size // SPREAD_ROW_BYTES))), *keys)
    return df
