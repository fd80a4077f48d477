"""Queries over run directories that are written first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.plans.registry import query
from tallyloom.plans.shared import shared_dir, table
from tallyloom.sources import files, listing


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_runs(spark, sf_dir) -> str:
    """An attempt for each nation: its suppliers are files that changed, and files that are new: binary, of three lines, of two without an end, or missing."""
    root = _fresh(spark, "runs")
    n, k = table(spark, sf_dir, "nation").select("n_nationkey"), F.col("s_suppkey")
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    folder = lambda c: F.concat(F.lit("temp-"), (F.col(c) % 3).cast("string"), F.lit("/rep-"), F.col(c).cast("string"))
    numbers = F.when(k % 3 > 0, F.concat_ws("\t", (k % 7).cast("string"), (k % 5).cast("string"))).otherwise("-\t-")
    tracked = s.groupBy("s_nationkey").agg(F.concat_ws("\n", F.collect_list(F.concat(numbers, F.lit("\tsrc/t"), key, F.lit(".c")))).alias("content"))
    named = s.groupBy("s_nationkey").agg(F.concat_ws("\n", F.collect_list(F.concat(F.lit(" new/u"), key, F.lit(".c")))).alias("content"))
    body = F.when(k % 4 == 0, F.concat("s_name", F.lit("\n\0\n"))).when(k % 4 == 1, F.concat("s_name", F.lit("\r\nb\rc\n"))).when(k % 4 == 2, F.concat("s_name", F.lit("\nend")))
    new = s.select(F.concat(folder("s_nationkey"), F.lit("/candidate/new/u"), key, F.lit(".c")).alias("path"), body.alias("content")).filter("content is not null")
    meta = n.select(F.concat(folder("n_nationkey"), F.lit("/metadata.json")).alias("path"), F.to_json(F.struct(F.col("n_nationkey").alias("nation"), (F.col("n_nationkey") % 4 > 0).alias("success"))).alias("content"))
    at = lambda df, name: df.select(F.concat(folder("s_nationkey"), F.lit(f"/{name}")).alias("path"), "content")
    listing.write_files(meta.unionByName(at(tracked, "diff-numstat.txt")).unionByName(at(named, "untracked-files.txt")).unionByName(new), root)
    return root


@query("""WITH s AS (SELECT s_nationkey AS n, s_suppkey AS k FROM supplier),
f AS (SELECT n, 'src/t' || k || '.c' AS file, CASE WHEN k % 3 > 0 THEN k % 7 ELSE 0 END AS added, CASE WHEN k % 3 > 0 THEN k % 5 ELSE 0 END AS deleted, true AS tracked FROM s
  UNION ALL SELECT n, 'new/u' || k || '.c', CASE k % 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END, 0, false FROM s)
SELECT 'temp-' || n_nationkey % 3 || '/rep-' || n_nationkey AS folder, CAST(coalesce(sum(added), 0) AS BIGINT) AS lines_added, CAST(coalesce(sum(deleted), 0) AS BIGINT) AS lines_deleted, CAST(coalesce(sum(added + deleted), 0) AS BIGINT) AS lines_edited,
  CAST(count(file) AS INTEGER) AS files_edited, count(file) FILTER (WHERE tracked) AS tracked_files_edited, count(file) FILTER (WHERE NOT tracked) AS untracked_files_created, coalesce(string_agg(file, ',' ORDER BY file), '') AS changed_paths
FROM nation LEFT JOIN f ON n = n_nationkey GROUP BY n_nationkey""")
def run_changes(spark, sf_dir):
    """Attempts of the sandbox layout with what each changed, new text files line by line."""
    root = write_runs(spark, sf_dir)
    attempts = listing.sandbox_attempts(listing.listing(spark, root, ["metadata.json"]))
    return listing.change_metrics(spark, root, attempts).withColumn("changed_paths", F.array_join("changed_paths", ","))


@query("""SELECT 'suites/' || s_nationkey AS folder, 's' || s_suppkey AS suite, 'suites/' || s_nationkey || '/s' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '.json' ELSE '.json.gz' END AS path FROM supplier""")
def suite_inventory(spark, sf_dir):
    """Suites of every folder: some plain, some packed, some both; manifests and notes beside them."""
    root, s, key = _fresh(spark, "suites"), table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    at = lambda name: F.concat(F.lit("suites/"), F.col("s_nationkey").cast("string"), F.lit("/"), *name)
    one = lambda when, *name: s.filter(when).select(at(name).alias("path"), F.lit("[]").alias("content"))
    kinds = [one("s_suppkey % 3 <> 1", F.lit("s"), key, F.lit(".json")), one("s_suppkey % 3 <> 0", F.lit("s"), key, F.lit(".json.gz")), one("true", F.lit("s"), key, F.lit(".json.txt")), one("true", F.lit(listing.MANIFEST)).distinct()]
    listing.write_files(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3]), root)
    return listing.suite_files(listing.listing(spark, root, below="suites/"))


@query("""SELECT 'attempt-' || n_nationkey AS attempt, n_nationkey AS nation, n_nationkey % 4 > 0 AS success FROM nation""")
def attempt_scan(spark, sf_dir):
    """metadata.json of every attempt folder, in either layout, as a table."""
    root, n = _fresh(spark, "attempts"), table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    where = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("attempt-"), key)).otherwise(F.concat(F.lit("temp-0p5/attempt-"), key))
    meta = F.to_json(F.struct(F.col("n_nationkey").alias("nation"), (F.col("n_nationkey") % 4 > 0).alias("success")))
    listing.write_files(n.select(F.concat(where, F.lit("/metadata.json")).alias("path"), meta.alias("content")), root)
    return files.read_attempts(spark, root, "nation long, success boolean")


@query("""SELECT 'lineage-' || n_nationkey AS lineage, CASE n_nationkey % 4 WHEN 0 THEN 'controller_interrupted' WHEN 1 THEN 'controller_interrupted' WHEN 2 THEN 'completed' ELSE 'stopped' END AS state,
CASE WHEN n_nationkey % 4 > 1 THEN n_name END AS name FROM nation""")
def lineage_scan(spark, sf_dir):
    """A row for every lineage folder, those with a broken record or none as interrupted."""
    root, n = _fresh(spark, "lineages"), table(spark, sf_dir, "nation")
    key, kind = F.col("n_nationkey").cast("string"), F.col("n_nationkey") % 4
    record = F.to_json(F.struct(F.when(kind == 2, "completed").otherwise("stopped").alias("status"), F.col("n_name").alias("name"), F.lit("f").alias("config_fingerprint")))
    rows = n.select(F.concat(F.lit("lineage-"), key, F.when(kind == 0, "/notes.txt").otherwise("/lineage.json")).alias("path"), F.when(kind == 1, "{broken").otherwise(record).alias("content"))
    listing.write_files(rows, root)
    found = files.read_lineages(spark, root, "status string, name string, config_fingerprint string")
    return found.select("lineage", "state", F.col("record.name").alias("name"))
