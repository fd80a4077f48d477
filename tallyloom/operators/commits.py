"""Replacing documents and tables in one step, by the session's own file systems.

A table is a folder with a version of it each in a folder of its own, and a document CURRENT that names the one that counts. Executors write a new version beside the old one; a guard may look at both;
then CURRENT is replaced by a rename, so readers see the old or the new rows and never a part, and a write that fails or is refused leaves what was there. A rename over a file
is one step wherever the file system's is (HDFS, object stores with conditional puts; a local disk deletes first).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURRENT = "CURRENT"


class Refused(ValueError):
    """A guard found reasons against a replacement."""


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


def replace_document(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a document beside the old one and rename it over that."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, at = _hadoop(spark, path)
    _, new = _hadoop(spark, f"{path}.new-{uuid.uuid4().hex}")
    out = fs.create(new, False)
    try:
        out.write(bytearray(data))
        out.hsync()
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(new, at, options)
    except BaseException:
        fs.delete(new, False)
        raise


def read_document(spark: SparkSession, path: str) -> bytes | None:
    fs, at = _hadoop(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that count, or None where nothing was written yet."""
    name = read_document(spark, f"{path}/{CURRENT}")
    return None if name is None else spark.read.parquet(f"{path}/{name.decode()}")


def replace_table(df: DataFrame, path: str, guard: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Make df the rows of the table at path and give them, read again.

    guard(old, new) gives a row (problem) for each reason against it; with any the new version is removed and Refused raised. A first version has no guard.
    """
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    fs, version = _hadoop(spark, f"{path}/{name}")
    try:
        df.write.parquet(f"{path}/{name}")
        new, old = spark.read.schema(df.schema).parquet(f"{path}/{name}"), read_table(spark, path)
        if guard is not None and old is not None:
            problems = [r["problem"] for r in guard(old, new).select("problem").limit(10).collect()]
            if problems:
                raise Refused("; ".join(problems))
        last = read_document(spark, f"{path}/{CURRENT}")
        replace_document(spark, f"{path}/{CURRENT}", name.encode())
    except BaseException:
        fs.delete(version, True)
        raise
    if last is not None:
        fs.delete(_hadoop(spark, f"{path}/{last.decode()}")[1], True)
    return new


def no_loss(keys: list[str], value: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A guard against losing measurements: every key with a value must have one afterwards."""

    def guard(old: DataFrame, new: DataFrame) -> DataFrame:
        had, has = (df.filter(F.col(value).isNotNull()).select(*keys).distinct() for df in (old, new))
        return had.join(has, keys, "left_anti").select(F.concat(F.lit(f"{value} would be lost: "), F.to_json(F.struct(*keys))).alias("problem"))

    return guard
