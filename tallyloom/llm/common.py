"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import math
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one is set only where there is none, and only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
        base = sc._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


class _Scratch(threading.local):
    """The scratch folders that are open, the innermost last; those of each thread are its own."""

    def __init__(self):
        self.folders: list[str] = []


_scratch = _Scratch()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch.folders[-1] if _scratch.folders else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside goes into a folder that is removed at the end; so results must be written outside of it before."""
    folder = fresh_path(spark, "scratch")
    _scratch.folders.append(folder)
    try:
        yield
    finally:
        _scratch.folders.remove(folder)
        remove(spark, folder)


def written(spark: SparkSession, df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again."""
    path = path or fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of plans that nothing refers to any more deleted now, not when the driver happens to collect garbage."""
    for _ in range(2):  # what the first round frees in Python, the second one frees in the JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows with whole texts go to Python so many at a time at most: batches are held several times, on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts(n_bytes: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(n_bytes / each))


def few(df: DataFrame) -> DataFrame:
    """Narrow rows dealt to an eighth of the shuffle partitions, so that many small tasks don't write a file each."""
    return df.repartition(max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
