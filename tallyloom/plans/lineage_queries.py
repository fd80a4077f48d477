"""Lineages, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import distance as D
from tallyloom.operators import lineage as L
from tallyloom.operators import security as S
from tallyloom.operators import suites as U
from tallyloom.plans.rate_queries import rounded, wilson_sql
from tallyloom.plans.registry import query
from tallyloom.plans.shared import table

STAGES = """
WITH s AS (SELECT conv_id AS lineage, turn AS pos, 'c' || turn AS checkpoint, role, text, length(text) > 60 AS success, length(text) AS lines, length(text) % 4 AS loops FROM conversations),
ok AS (SELECT *, min(CASE WHEN coalesce(success, false) THEN 1 ELSE 0 END) OVER (PARTITION BY lineage ORDER BY pos) AS good FROM s),
t AS (SELECT lineage, pos, lag(checkpoint) OVER p AS from_checkpoint, checkpoint AS to_checkpoint, lag(lines) OVER p AS lines_before, lines AS lines_after, row_number() OVER p AS nth
  FROM ok WHERE good = 1 WINDOW p AS (PARTITION BY lineage ORDER BY pos))
"""


def stages(spark, sf_dir):
    """Conversations as lineages: turns are stages, a text of over 60 characters passes."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("lineage"), F.col("turn").alias("pos"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("checkpoint"), "role", "text", (F.length("text") > 60).alias("success"), F.length("text").alias("lines"), (F.length("text") % 4).alias("loops"))


@query(STAGES + "SELECT lineage, pos, from_checkpoint, to_checkpoint, lines_before, lines_after FROM t WHERE nth > 1")
def stage_transitions(spark, sf_dir):
    return L.transitions(stages(spark, sf_dir), ["lines"])


@query(STAGES + """, d AS (SELECT to_checkpoint, greatest(lines_after - lines_before, 0) AS added, greatest(lines_before - lines_after, 0) AS deleted FROM t WHERE nth > 1)
SELECT to_checkpoint, count(*) AS n, count(added) AS measured, round(avg(added), 6) AS mean_added, round(avg(deleted), 6) AS mean_deleted, round(avg(added + deleted), 6) AS mean_edited, round(median(added + deleted), 6) AS median_edited FROM d GROUP BY to_checkpoint""")
def transition_summary(spark, sf_dir):
    t = L.transitions(stages(spark, sf_dir), ["lines"])
    delta = F.col("lines_after") - F.col("lines_before")
    return rounded(L.transition_summary(t.withColumns({"added": F.greatest(delta, F.lit(0)), "deleted": F.greatest(-delta, F.lit(0))})))


@query(STAGES + "SELECT lineage, count(*) AS n_stages, arg_min(lines, pos) AS lines_first, arg_max(lines, pos) AS lines_last, sum(loops)::BIGINT AS loops_sum FROM s GROUP BY lineage HAVING count(*) >= 2 AND bool_and(coalesce(success, false))")
def first_last_change(spark, sf_dir):
    return L.first_last(stages(spark, sf_dir), ["lines"], ["loops"])


@query(STAGES + f""", c AS (SELECT 'c' || i AS checkpoint, i::INTEGER AS pos FROM range(0, 12) r(i)),
a AS (SELECT checkpoint, count(*) AS reached, count(*) FILTER (WHERE success) AS passed, count(*) FILTER (WHERE success AND loops = 0) AS initial_successes, count(*) FILTER (WHERE success AND loops > 0) AS after_repair,
  count(loops) AS loops_n, sum(loops)::BIGINT AS loops_total, round(avg(loops), 6) AS loops_mean, round(median(loops), 6) AS loops_median, max(loops)::INTEGER AS loops_max FROM s GROUP BY checkpoint)
SELECT checkpoint, pos, coalesce(reached, 0) AS reached, coalesce(passed, 0) AS passed, coalesce(initial_successes, 0) AS initial_successes, coalesce(after_repair, 0) AS after_repair,
  coalesce(loops_n, 0) AS loops_n, loops_total, loops_mean, loops_median, loops_max, CASE WHEN reached > 0 THEN round(passed::DOUBLE / reached, 6) END AS pass_rate,
  {wilson_sql("passed", "reached", "lower")} AS lower, {wilson_sql("passed", "reached", "upper")} AS upper FROM c LEFT JOIN a USING (checkpoint)""")
def checkpoint_rows(spark, sf_dir):
    declared = spark.createDataFrame([(f"c{i}", i) for i in range(12)], "checkpoint string, pos int")
    return rounded(L.checkpoint_rows(stages(spark, sf_dir), declared))


@query(STAGES + "SELECT checkpoint, role AS stop_reason, count(*) AS n FROM s WHERE NOT success GROUP BY ALL")
def stop_reasons(spark, sf_dir):
    return L.stop_reasons(stages(spark, sf_dir).withColumnRenamed("role", "stop_reason"))


@query(STAGES + """, h AS (SELECT lineage, pos, checkpoint, role, sha256(text) AS candidate, lag(sha256(text)) OVER (PARTITION BY lineage ORDER BY pos) AS before,
    CASE WHEN pos % 3 = 2 THEN 'other' ELSE coalesce(lag(sha256(text)) OVER (PARTITION BY lineage ORDER BY pos), '') END AS seed, row_number() OVER (PARTITION BY lineage ORDER BY pos) AS nth FROM s)
SELECT lineage, pos, checkpoint, CASE WHEN nth = 1 THEN 'the first stage is not new' ELSE 'the seed differs from the candidate before' END AS problem
FROM h WHERE (nth = 1 AND role <> 'user') OR (nth > 1 AND seed IS DISTINCT FROM before)""")
def provenance_check(spark, sf_dir):
    order = Window.partitionBy("lineage").orderBy("pos")
    s = stages(spark, sf_dir).withColumn("candidate_hash", F.sha2("text", 256))
    s = s.withColumn("seed_hash", F.when(F.col("pos") % 3 == 2, "other").otherwise(F.coalesce(F.lag("candidate_hash").over(order), F.lit(""))))
    return L.seed_problems(s.withColumn("source_mode", F.when(F.col("role") == "user", "new").otherwise(F.col("role"))))


@query(STAGES + """, e AS (SELECT lineage, CASE WHEN bool_and(coalesce(success, false)) THEN 'completed' WHEN max(pos) % 2 = 0 THEN 'stopped' ELSE 'controller_interrupted' END AS state FROM s GROUP BY lineage)
SELECT count(*) AS started, count(*) FILTER (WHERE state = 'completed') AS completed, count(*) FILTER (WHERE state = 'stopped') AS stopped, count(*) FILTER (WHERE state = 'controller_interrupted') AS interrupted,
  round(count(*) FILTER (WHERE state = 'completed')::DOUBLE / count(*), 6) AS completion_rate,
  """ + wilson_sql("count(*) FILTER (WHERE state = 'completed')", "count(*)", "lower") + " AS lower, " + wilson_sql("count(*) FILTER (WHERE state = 'completed')", "count(*)", "upper") + " AS upper FROM e")
def lineage_reliability(spark, sf_dir):
    s = stages(spark, sf_dir).groupBy("lineage").agg(F.bool_and(F.coalesce("success", F.lit(False))).alias("_all"), F.max("pos").alias("_top"))
    rows = s.withColumn("status", F.when(F.col("_all"), "completed").when(F.col("_top") % 2 == 0, "stopped").otherwise("running")).withColumn("stop_reason", F.lit(None).cast("string"))
    return rounded(L.reliability(rows.withColumn("state", L.classify()), []))


@query(STAGES + "SELECT lineage, pos, checkpoint FROM s WHERE checkpoint = 'c1' AND success")
def population_at(spark, sf_dir):
    s = stages(spark, sf_dir)
    return L.population(s, s.select("lineage").distinct(), "c1").select("lineage", "pos", "checkpoint")


@query(STAGES + ", d AS (SELECT lineage FROM s GROUP BY lineage HAVING bool_and(coalesce(success, false))) SELECT lineage, max(pos) AS pos FROM s SEMI JOIN d USING (lineage) GROUP BY lineage")
def final_population(spark, sf_dir):
    s = stages(spark, sf_dir)
    done = s.groupBy("lineage").agg(F.bool_and(F.coalesce("success", F.lit(False))).alias("_all")).filter("_all")
    return L.population(s, done).select("lineage", "pos")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def planned_not_started(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return L.not_started(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@query("""
WITH l AS (SELECT user_id, CASE WHEN user_id % 9 = 0 THEN 'zzz' ELSE max(event_type) END AS f FROM events GROUP BY user_id), c AS (SELECT unnest(['signup', 'view', 'click', 'never']) AS checkpoint)
SELECT checkpoint, (SELECT count(*) FROM l WHERE f = checkpoint) AS n FROM c UNION ALL SELECT 'other', count(*) FROM l WHERE f NOT IN (SELECT checkpoint FROM c)""")
def dense_failure_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_type").alias("_t")).withColumn("failed_checkpoint", F.when(F.col("user_id") % 9 == 0, "zzz").otherwise(F.col("_t")))
    declared = spark.createDataFrame([(c,) for c in ("signup", "view", "click", "never")], "checkpoint string")
    return L.failure_counts(rows, declared)


@query("""
WITH a AS (SELECT l_returnflag || l_linestatus AS k, l_linenumber AS line, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY ALL),
b AS (SELECT l_returnflag || l_linestatus AS k, l_linenumber AS line, count(*) AS n FROM lineitem WHERE l_quantity <= 25 GROUP BY ALL)
SELECT k, line, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM a FULL JOIN b USING (k, line) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def counter_delta(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("k"), F.col("l_linenumber").alias("line"), "l_quantity")
    count = lambda df: df.groupBy("k", "line").agg(F.count("*").alias("n"))
    return D.counter_delta(count(rows.filter("l_quantity > 25")), count(rows.filter("l_quantity <= 25")), ["k", "line"], "n")


@query("""
WITH d AS (SELECT event_type, count(*) FILTER (WHERE value > 50) - count(*) FILTER (WHERE value <= 50) AS delta FROM events GROUP BY event_type)
SELECT 'node.' || CASE WHEN delta > 0 THEN 'added.' ELSE 'removed.' END || event_type AS feature, abs(delta) AS delta FROM d WHERE delta <> 0""")
def signed_delta(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("feature")).agg((F.count_if(F.col("value") > 50) - F.count_if(F.col("value") <= 50)).alias("delta"))
    return D.signed_features(e, "node")


@query("""
WITH a AS (SELECT o_orderkey AS name, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey AS name, o_orderstatus AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderpriority END AS priority FROM orders WHERE o_orderkey % 5 <> 0)
SELECT name, 'only_fresh' AS kind, CAST(NULL AS VARCHAR) AS field, true AS semantic FROM a ANTI JOIN b USING (name)
UNION ALL SELECT name, 'only_committed', NULL, true FROM b ANTI JOIN a USING (name)
UNION ALL SELECT a.name, 'differs', 'priority', false FROM a JOIN b USING (name) WHERE a.priority IS DISTINCT FROM b.priority""")
def case_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    committed = o.filter("name % 5 <> 0").withColumn("priority", F.when(F.col("name") % 7 == 0, "changed").otherwise(F.col("priority")))
    return U.case_diff(o.filter("name % 3 <> 0"), committed, ["name"], {"status": True, "priority": False})


@query("""
WITH b AS (SELECT c_nationkey AS k, c_name AS name, sha256(CAST(c_acctbal > 0 AS VARCHAR)) AS h FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0),
a AS (SELECT c_nationkey AS k, c_name AS name, sha256(CAST(c_acctbal > 5000 AS VARCHAR)) AS h FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 3 = 0),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, b.name) AS name, a.h AS ah, b.h AS bh FROM a FULL JOIN b ON a.k = b.k AND a.name = b.name)
SELECT k, count(*) FILTER (WHERE bh IS NULL) AS n_created, count(*) FILTER (WHERE ah IS NULL) AS n_deleted, count(*) FILTER (WHERE ah <> bh) AS n_edited, count(*) FILTER (WHERE ah IS NOT NULL AND bh IS NOT NULL) AS n_common FROM j GROUP BY k""")
def function_changes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    side = lambda when, level: c.filter(when).select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), F.sha2((F.col("c_acctbal") > level).cast("string"), 256).alias("sha256"))
    out = D.function_changes(side("c_custkey % 2 = 0 or c_custkey % 3 = 0", 0), side("c_custkey % 2 = 1 or c_custkey % 3 = 0", 5000), ["k"])
    return out.select("k", "n_created", "n_deleted", "n_edited", "n_common")


@query("""
WITH r AS (SELECT p_brand, p_name AS name, p_partkey AS start_byte, regexp_matches(p_name, '(?i)(parse|arg|opt|usage)') AS parser FROM part)
SELECT p_brand, name, start_byte, CASE WHEN parser THEN 'created_parser_helper_' ELSE 'created_behavior_helper_' END || (row_number() OVER (PARTITION BY p_brand, parser ORDER BY start_byte, name) - 1) AS canonical FROM r WHERE name <> 'main'""")
def helper_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("name"), F.col("p_partkey").alias("start_byte"))
    return D.helper_names(p, ["p_brand"])


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_event(spark, sf_dir):
    return L.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type")


@query("SELECT n_regionkey, max(n_regionkey) AS agreed FROM nation GROUP BY n_regionkey")
def agreed_value(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("agreed", F.col("n_regionkey"))
    return L.agreed(n, ["n_regionkey"], "agreed")


@query("SELECT url, CASE WHEN starts_with(url, 'http://') THEN '/data/' || substr(url, 8) END AS moved FROM pages")
def relocated_paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url", F.regexp_replace("url", "^http://", "http:/root/").alias("u"), F.lit("http:/root").alias("old"))
    return p.select("url", L.relocated("u", "old", "/data").alias("moved"))


# ---- findings: what regular expressions find in pages ----

FINDINGS = """
WITH f AS (
  SELECT page_id AS run, page_id % 10 AS lineage, 3 AS level, 'CWE-79' AS cwe, len(regexp_extract_all(html, '<script')) AS k FROM pages
  UNION ALL SELECT page_id, page_id % 10, 2, 'CWE-601', len(regexp_extract_all(html, 'href="http:')) FROM pages
  UNION ALL SELECT page_id, page_id % 10, 4, 'CWE-200', len(regexp_extract_all(html, '@example')) FROM pages),
x AS (SELECT lineage, run, level, cwe FROM (SELECT *, unnest(range(0, k)) AS i FROM f)),
p AS (SELECT page_id AS run, page_id % 10 AS lineage, page_id % 13 <> 0 AS measured, length(html) - length(replace(html, '<', '')) AS loc FROM pages),
r AS (SELECT p.lineage, p.run, measured, loc, CASE WHEN measured THEN count(x.level) END AS n_findings, CASE WHEN measured THEN max(x.level) END AS max_level,
  CASE WHEN measured THEN coalesce(list_sort(list(DISTINCT x.cwe) FILTER (WHERE x.cwe IS NOT NULL)), []) END AS cwe_ids FROM p LEFT JOIN x ON x.run = p.run GROUP BY p.lineage, p.run, measured, loc)
"""


def findings(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("lineage"), F.col("page_id").alias("run"), "html")
    kinds = F.array(*[F.struct(F.lit(level).alias("level"), F.array(F.lit(cwe)).alias("cwe_ids"), F.regexp_count("html", F.lit(pattern)).alias("k")) for level, cwe, pattern in ((3, "CWE-79", "<script"), (2, "CWE-601", 'href="http:'), (4, "CWE-200", "@example"))])
    rows = p.select("lineage", "run", F.explode(kinds).alias("x")).filter("x.k > 0")
    return rows.select("lineage", "run", "x.level", "x.cwe_ids", F.explode(F.sequence(F.lit(1), "x.k")).alias("_i")).drop("_i")


def profiles(spark, sf_dir):
    runs = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("lineage"), F.col("page_id").alias("run"), (F.col("page_id") % 13 != 0).alias("measured"), F.regexp_count("html", F.lit("<")).alias("loc"))
    return S.run_rollup(findings(spark, sf_dir), runs, ["lineage"])


@query(FINDINGS + "SELECT lineage, run, measured, n_findings, max_level, array_to_string(cwe_ids, ',') AS cwes, CASE WHEN loc > 0 THEN round(1000.0 * n_findings / loc, 6) END AS per_kloc FROM r")
def finding_rollup(spark, sf_dir):
    return rounded(profiles(spark, sf_dir).select("lineage", "run", "measured", "n_findings", "max_level", F.array_join("cwe_ids", ",").alias("cwes"), "per_kloc"))


@query(FINDINGS + """SELECT lineage, count(*) AS runs, count(*) FILTER (WHERE measured) AS measured_runs, round(count(*) FILTER (WHERE measured)::DOUBLE / count(*), 6) AS coverage,
  CASE WHEN count(*) FILTER (WHERE measured) = count(*) THEN round(count(*) FILTER (WHERE measured AND n_findings > 0)::DOUBLE / count(*), 6) END AS prevalence,
  round(avg(n_findings), 6) AS findings_mean, round(median(n_findings), 6) AS findings_median, round(stddev_samp(n_findings), 6) AS findings_sample_sd, min(n_findings) AS findings_min, max(n_findings) AS findings_max
FROM r GROUP BY lineage""")
def security_population(spark, sf_dir):
    return rounded(S.paper_row(S.population_rollup(profiles(spark, sf_dir), ["lineage"]), ["lineage"]))


@query(FINDINGS + "SELECT cwe, count(*) AS n, count(DISTINCT run) AS runs FROM x GROUP BY cwe")
def cwe_distribution(spark, sf_dir):
    return S.cwe_distribution(findings(spark, sf_dir), [])


@query(FINDINGS + "SELECT level, count(*) AS n, count(DISTINCT run) AS runs FROM x GROUP BY level")
def severity_distribution(spark, sf_dir):
    return S.level_distribution(findings(spark, sf_dir), [])


@query(FINDINGS + "SELECT coalesce(CAST(max_level AS VARCHAR), 'none') AS level, count(*) AS n, coalesce(max_level, -1) AS ord FROM r WHERE measured GROUP BY max_level")
def max_level_distribution(spark, sf_dir):
    return S.max_level_distribution(profiles(spark, sf_dir), [])


#: calls of every class, some of none, and names that only contain one
CALLED = ["strcpy", "strcat", "sprintf", "gets", "vsprintf", "strncpy", "strncat", "snprintf", "memcpy", "memmove", "stpcpy", "malloc", "calloc", "realloc", "free", "strdup", "reallocarray", "scanf", "fgets", "my_strcpy", "freed", "getline"]


@query(f"""
WITH n AS (SELECT p_partkey, {CALLED} AS names FROM part),
c AS (SELECT p_partkey, [names[1 + CAST(p_partkey % 22 AS INTEGER)], names[1 + CAST(p_partkey * 7 % 22 AS INTEGER)], names[1 + CAST(p_partkey * 5 % 22 AS INTEGER)]] AS calls FROM n)
SELECT p_partkey, len(list_filter(calls, lambda x: x IN ('strcpy', 'strcat', 'sprintf', 'gets', 'vsprintf'))) AS unsafe_calls,
  len(list_filter(calls, lambda x: x IN ('strncpy', 'strncat', 'snprintf', 'memcpy', 'memmove', 'stpcpy'))) AS bounded_calls,
  len(list_filter(calls, lambda x: x IN ('malloc', 'calloc', 'realloc', 'free', 'strdup', 'reallocarray'))) AS heap_calls FROM c""")
def construct_profile(spark, sf_dir):
    """Each part has a source with three calls; what stands in comments and literals is no call."""
    k, names = F.col("p_partkey"), F.array(*map(F.lit, CALLED))
    name = lambda m: F.get(names, (k * m % len(CALLED)).cast("int"))
    code = F.concat(F.lit("/* strcpy(x); */ // free(y)\nchar *s = \"gets(\\\"z\"; char c = '('; "), name(1), F.lit("(a); "), name(7), F.lit(" (b, "), name(5), F.lit("\n(c));"))
    return S.construct_profile(table(spark, sf_dir, "part").select("p_partkey", code.alias("source")), "source").drop("source")


@query(FINDINGS + """, g AS (SELECT lineage, run AS to_run, lag(run) OVER (PARTITION BY lineage ORDER BY run) AS from_run FROM r),
j AS (SELECT g.lineage, g.from_run, g.to_run, a.measured AND b.measured AS both_known, a.measured AS am, b.n_findings - a.n_findings AS d, a.cwe_ids AS ac, b.cwe_ids AS bc
  FROM g JOIN r a ON a.run = g.from_run JOIN r b ON b.run = g.to_run WHERE from_run IS NOT NULL)
SELECT lineage, from_run, to_run, CASE WHEN both_known THEN 'measured' ELSE 'unavailable' END AS status,
  CASE WHEN NOT am THEN 'no measurement before' WHEN NOT both_known THEN 'no measurement after' END AS reason, CASE WHEN both_known THEN d END AS finding_delta,
  CASE WHEN both_known THEN array_to_string(list_sort(list_filter(bc, lambda x: NOT list_contains(ac, x))), ',') END AS newly, CASE WHEN both_known THEN array_to_string(list_sort(list_filter(ac, lambda x: NOT list_contains(bc, x))), ',') END AS gone FROM j""")
def security_transitions(spark, sf_dir):
    p = profiles(spark, sf_dir)
    pairs = p.select("lineage", F.col("run").alias("to_run"), F.lag("run").over(Window.partitionBy("lineage").orderBy("run")).alias("from_run")).filter("from_run is not null")
    out = S.transitions(pairs, p)
    return out.select("lineage", "from_run", "to_run", "status", "reason", "finding_delta", F.array_join("newly_observed", ",").alias("newly"), F.array_join("no_longer_observed", ",").alias("gone"))
