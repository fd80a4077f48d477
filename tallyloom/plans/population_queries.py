"""Queries of several populations at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import populations as P
from tallyloom.plans.registry import query
from tallyloom.plans.rate_queries import rounded
from tallyloom.plans.shared import table

ORDER = [f"c{i}" for i in range(1, 9)]  # orders have seven lines at most, so nothing reaches the last one

STAGES = """
WITH s AS (SELECT l_orderkey AS lineage, l_linenumber AS pos, 'c' || l_linenumber AS checkpoint, l_returnflag <> 'R' AS ok, l_tax > 0 AS measured, l_suppkey % 4 AS n_findings,
  CASE WHEN l_partkey % 50 > 0 THEN 1000.0 * (l_suppkey % 4) / (l_partkey % 50) END AS per_kloc, CAST(l_quantity AS BIGINT) % 3 AS unsafe_calls FROM lineitem),
g AS (SELECT lineage, bool_and(ok) AS whole, max(pos) AS top FROM s GROUP BY lineage),
m AS (SELECT 'final' AS population, s.* FROM s JOIN g USING (lineage) WHERE whole AND pos = top UNION ALL SELECT checkpoint, * FROM s WHERE ok),
d AS (SELECT unnest(range(0, 9)) AS ord, unnest(['final', 'c1', 'c2', 'c3', 'c4', 'c5', 'c6', 'c7', 'c8']) AS population)
"""


def stages(spark, sf_dir):
    """Order lines as the stages of lineages, with what a scanner found in them."""
    loc = F.col("l_partkey") % 50
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("lineage"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("checkpoint"), (F.col("l_returnflag") != "R").alias("success"),
        (F.col("l_tax") > 0).alias("measured"), (F.col("l_suppkey") % 4).alias("n_findings"), F.when(loc > 0, 1000.0 * (F.col("l_suppkey") % 4) / loc).alias("per_kloc"),
        (F.col("l_quantity").cast("long") % 3).alias("unsafe_calls"), F.slice(F.array(F.lit("CWE-1"), F.lit("CWE-2"), F.lit("CWE-3")), F.lit(1), (F.col("l_suppkey") % 4).cast("int")).alias("cwe_ids"),
    )
    return P.with_stage_mask(rows, ORDER)


@query(STAGES + """SELECT d.population, d.ord, count(lineage) AS runs, count(*) FILTER (WHERE measured) AS measured_runs, round(count(*) FILTER (WHERE measured) / nullif(count(lineage), 0), 6) AS coverage,
  CASE WHEN count(lineage) > 0 AND count(*) FILTER (WHERE measured) = count(lineage) THEN round(count(*) FILTER (WHERE n_findings > 0) / count(lineage), 6) END AS prevalence,
  CASE WHEN count(lineage) > 0 AND count(*) FILTER (WHERE measured) = count(lineage) THEN round(count(*) FILTER (WHERE unsafe_calls > 0) / count(lineage), 6) END AS unsafe_prevalence,
  round(avg(unsafe_calls) FILTER (WHERE measured), 6) AS mean_unsafe_calls, count(n_findings) FILTER (WHERE measured) AS findings_n, round(avg(n_findings) FILTER (WHERE measured), 6) AS findings_mean,
  round(median(n_findings) FILTER (WHERE measured), 6) AS findings_median, round(stddev_samp(n_findings) FILTER (WHERE measured), 6) AS findings_sample_sd, min(n_findings) FILTER (WHERE measured) AS findings_min, max(n_findings) FILTER (WHERE measured) AS findings_max,
  round(avg(per_kloc) FILTER (WHERE measured), 6) AS per_kloc_mean, round(median(per_kloc) FILTER (WHERE measured), 6) AS per_kloc_median, CAST(coalesce(max(n_findings) FILTER (WHERE measured), 0) AS INTEGER) AS distinct_cwes
FROM d LEFT JOIN m USING (population) GROUP BY d.population, d.ord""")
def security_populations(spark, sf_dir):
    """The final population and that of every checkpoint, of one scan."""
    return rounded(P.security_rollup(stages(spark, sf_dir), P.stage_populations(ORDER)))


@query(STAGES + """, f AS (SELECT population, lineage, pos, i % 2 + n_findings AS level, count(*) AS n FROM (SELECT *, unnest(range(0, n_findings)) AS i FROM m) GROUP BY ALL), z AS (SELECT population, count(*) AS n_all FROM m GROUP BY population)
SELECT population, level, CAST(sum(n) AS BIGINT) AS n, count(*) AS runs, round(count(*) / any_value(n_all), 6) AS share FROM f JOIN z USING (population) GROUP BY population, level""")
def severity_populations(spark, sf_dir):
    s = stages(spark, sf_dir).withColumn("run", F.struct("lineage", "pos"))
    found = s.filter("n_findings > 0").select("run", "mask", "n_findings", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_findings") - 1)).alias("i"))
    return rounded(P.severity_rollup(found.select("run", "mask", (F.col("i") % 2 + F.col("n_findings")).alias("level")), s, P.stage_populations(ORDER)))


@query("""WITH v AS (SELECT vec_id AS run, embedding::DOUBLE[] AS e, label > 2 AS c, label < 7 AS p FROM embeddings),
m AS (SELECT 'all' AS population, run FROM v UNION ALL SELECT 'complete', run FROM v WHERE c UNION ALL SELECT 'passing', run FROM v WHERE p UNION ALL SELECT 'passing_complete', run FROM v WHERE c AND p),
x AS (SELECT a.run AS l, b.run AS r, 1 - greatest(-1.0, least(1.0, list_cosine_similarity(a.e, b.e))) AS distance FROM v a JOIN v b ON a.run < b.run),
q AS (SELECT s.population, l, r, distance FROM x JOIN m s ON s.run = l JOIN m t ON t.run = r AND t.population = s.population),
o AS (SELECT population, unnest([l, r]) AS run, distance FROM q), k AS (SELECT population, run, avg(distance) AS mean, max(distance) AS most FROM o GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY population ORDER BY mean, run) AS nth FROM k),
d AS (SELECT unnest(range(0, 4)) AS ord, unnest(['all', 'complete', 'passing', 'passing_complete']) AS population)
SELECT population, ord, (SELECT count(*) FROM m WHERE m.population = d.population) AS runs, count(q.distance) AS n_pairs, round(avg(q.distance), 5) AS mean_distance, any_value(b.run) AS medoid, round(any_value(b.mean), 5) AS medoid_mean, round(any_value(b.most), 5) AS medoid_max, CAST(NULL AS VARCHAR) AS reason
FROM d JOIN q USING (population) JOIN b USING (population) WHERE nth = 1 GROUP BY population, ord""")
def population_structure(spark, sf_dir):
    """Four populations of the same vectors, whose blocks meet once."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("run"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), (F.col("label") > 2).alias("c"), (F.col("label") < 7).alias("p"))
    v = v.select("run", "vector", P.run_mask("c", "p").alias("mask"))
    out = P.vector_structure(v, P.RUN_POPULATIONS)
    return out.withColumns({c: F.round(c, 5) for c in ("mean_distance", "medoid_mean", "medoid_max")})
