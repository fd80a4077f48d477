"""Tables and intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; one is set only where there is none, and only in local mode, where all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
        base = sc._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, evaluated once: written as Parquet into the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """df with each row's place (from 1) in the total order of the given columns.

    A range-partitioned sort, written once with each row's place in its partition; the partitions' sizes (one
    number each) then give the offsets. No task sees more than its range. Ties share no place but any order of them is as good.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"), "sorted")
    sizes = sorted(placed.groupBy("_part").agg(F.count("*")).collect())  # a row for each partition
    offsets, total = [], 0
    for part, size in sizes:
        offsets.append((part, total))
        total += size
    first = spark.createDataFrame(offsets, "_part long, _first long")
    return placed.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_at") + 1).drop("_part", "_at", "_first")
