"""Queries over files that a query writes first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.operators import commits
from tallyloom.operators.merge import merge_sorted, read_file_list
from tallyloom.plans.registry import query
from tallyloom.plans.shared import shared_dir, table


@query("""WITH l AS (SELECT o_orderpriority || ' ' || o_orderstatus || ' ' || o_custkey AS line FROM orders)
SELECT row_number() OVER (ORDER BY line DESC) AS place, line FROM l""")
def merged_files(spark, sf_dir):
    """A sorted file of lines for each priority of orders, named in a list with NULs, merged in falling order."""
    base = f"{shared_dir(spark)}/sorted-{uuid.uuid4().hex}"
    line = F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string"))
    orders = table(spark, sf_dir, "orders").select(line.alias("line"), F.xxhash64("o_orderpriority").alias("k"))
    orders.repartition("k").sortWithinPartitions("k", F.desc("line")).write.partitionBy("k").text(f"{base}/lines")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{base}/lines").select("path")
    files.coalesce(1).write.option("lineSep", "\0").text(f"{base}/list")
    return merge_sorted(read_file_list(spark, f"{base}/list"), reverse=True, block=1 << 16).select("place", F.decode("line", "UTF-8").alias("line"))


@query("SELECT p_partkey, p_size + 1 AS value FROM part")
def replaced_measurements(spark, sf_dir):
    """Measurements that are replaced once, and then not by such as lack some of them."""
    path = f"{shared_dir(spark)}/measured-{uuid.uuid4().hex}"
    p, guard = table(spark, sf_dir, "part"), commits.no_loss(["p_partkey"], "value")
    for value in (F.col("p_size"), F.col("p_size") + 1, F.when(F.col("p_size") > 25, F.col("p_size"))):
        try:
            commits.replace_table(p.select("p_partkey", value.alias("value")), path, guard)
        except commits.Refused:
            pass
    return commits.read_table(spark, path)
