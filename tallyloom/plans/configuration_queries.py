"""Queries of configurations: one for each customer, as JSON text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import configurations as C
from tallyloom.plans.registry import query
from tallyloom.plans.shared import table

K = "c_custkey"


def _rows(spark, sf_dir, **texts):
    """The customers' keys with texts, expressions of SQL, as variants."""
    return table(spark, sf_dir, "customer").select(K, *[F.parse_json(F.expr(t)).alias(n) for n, t in texts.items()])


@query("""SELECT c_custkey, sha256('{"model":"m' || c_custkey % 5 || '","note":"\\u00e9 \\ud83d\\ude00","stages":[' || c_custkey || ',{"a":"' || c_name || '","b":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'null' END || '}],"temperature":0.' || c_custkey % 9 + 1 || '}') AS fingerprint FROM customer""")
def configuration_fingerprints(spark, sf_dir):
    """Keys in any order, at any level, with spaces, and with what doesn't count."""
    text = """concat('{ "temperature": 0.', c_custkey % 9 + 1, ', "n_lineages": ', c_custkey, ', "stages": [', c_custkey, ', {"b": ', if(c_custkey % 2 = 0, 'true', 'null'), ', "a": "', c_name, '"}], "config_fingerprint": "old", "output_dir": "/x/', c_custkey, '", "note": "é 😀", "model": "m', c_custkey % 5, '"}')"""
    return C.fingerprints(_rows(spark, sf_dir, config=text), [K], "config")


@query("""WITH a AS (SELECT c_custkey AS k FROM customer),
s AS (SELECT k, CASE WHEN k % 3 = 0 THEN 0.25 WHEN k % 2 = 0 AND k % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN 0.4 ELSE 0.3 END AS architecture, CASE WHEN k % 3 = 0 THEN 'cli' WHEN k % 2 = 0 THEN 'experiment_metadata' ELSE 'default' END AS source,
  CASE WHEN k % 3 > 0 AND k % 2 = 0 AND k % 5 = 0 THEN 'architecture: must be a positive finite number' END AS problem FROM a)
SELECT k AS c_custkey, architecture AS architecture_threshold, source AS architecture_threshold_source, problem AS architecture_threshold_problem,
  CASE WHEN k % 4 = 1 THEN NULL ELSE architecture END AS strategy_threshold, CASE WHEN k % 4 = 1 THEN 'cli' ELSE 'architecture_threshold' END AS strategy_threshold_source, CASE WHEN k % 4 = 1 THEN 'strategy: must be a positive finite number' END AS strategy_threshold_problem,
  CASE WHEN k % 2 = 0 AND k % 7 > 1 THEN CAST(k % 7 AS INTEGER) END AS diversity_k_max, CASE WHEN k % 2 = 0 THEN 'experiment_metadata' ELSE 'default' END AS diversity_k_max_source,
  CASE WHEN k % 2 = 0 AND k % 7 = 0 THEN 'diversity: must be a positive whole number or null' END AS diversity_k_max_problem FROM s""")
def resolved_settings(spark, sf_dir):
    """Thresholds given, recorded or by default; some of the wrong type or sign, a recorded null, and runs that don't inherit."""
    given = "concat('{', if(c_custkey % 3 = 0, '\"architecture_threshold\": 0.25', '\"architecture_threshold\": null'), if(c_custkey % 4 = 1, ', \"strategy_threshold\": true', ''), '}')"
    k = "case c_custkey % 7 when 0 then '0' when 1 then 'null' else cast(c_custkey % 7 as string) end"
    recorded = f"concat('{{\"analysis_architecture_threshold\": ', if(c_custkey % 5 = 0, '\"0.4\"', '0.40'), ', \"analysis_diversity_k_max\": ', {k}, '}}')"
    rows = _rows(spark, sf_dir, given=given, recorded=recorded).withColumn("inherit", F.col(K) % 2 == 0)
    return C.settings(rows).drop("given", "recorded", "inherit")


@query("""WITH a AS (SELECT c_custkey AS k FROM customer)
SELECT k AS c_custkey, 'architecture_threshold' AS setting, '0.3' AS recorded, '0.35' AS resolved, CAST(NULL AS VARCHAR) AS reason FROM a WHERE k % 2 = 0
UNION ALL SELECT k, 'bootstrap_seed', CAST(k AS VARCHAR), CAST(k + 1 AS VARCHAR), NULL FROM a WHERE k % 2 = 0 AND k % 3 = 0
UNION ALL SELECT k, 'clang_extra_args', '[]', '["-I' || k || '"]', NULL FROM a WHERE k % 2 = 1 AND k % 5 = 0
UNION ALL SELECT k, 'strategy_threshold', NULL, '0.3', 'missing recorded configuration' FROM a WHERE k % 2 = 1 AND k % 3 = 0""")
def configuration_departures(spark, sf_dir):
    """Frozen configurations and such that were recorded setting by setting; numbers written in different ways are the same."""
    frozen = """concat('{"frozen_analysis_configuration": {"bootstrap_seed": ', c_custkey, ', "architecture_threshold": 0.30, "strategy_threshold": 0.30, "strategy_exclusion_regex": "x", "strategy_include_functions": ["a"],
      "include_main": true, "clang_extra_arguments": [], "threshold_sensitivity": {"rule": "r", "grid": null}, "bootstrap_repetitions": 1000}}')"""
    single = """concat('{"analysis_architecture_threshold": 0.35, "analysis_diversity_k_max": null, "analysis_strategy_exclude_regex": "x", "analysis_strategy_include_functions": ["a"]', if(c_custkey % 3 = 0, '', ', "analysis_strategy_threshold": 3e-1'), '}')"""
    resolved = """concat('{"architecture_threshold": 0.35, "strategy_threshold": 0.3, "diversity_k_max": null, "strategy_exclude_regex": "x", "strategy_include_functions": ["a"], "strategy_main_included": true, "clang_extra_args": ',
      if(c_custkey % 2 = 1 and c_custkey % 5 = 0, concat('["-I', c_custkey, '"]'), '[]'), ', "threshold_sensitivity": {"grid": null, "rule": "r"}, "bootstrap_repetitions": 1000, "bootstrap_seed": ', c_custkey + if(c_custkey % 3 = 0, 1, 0), '}')"""
    rows = _rows(spark, sf_dir, recorded=f"if(c_custkey % 2 = 0, {frozen}, {single})", resolved=resolved)
    return C.departures(rows, [K])


@query("""WITH c AS (SELECT p_partkey AS k, p_size AS s, 'c' || p_partkey AS name FROM part)
SELECT 'search' AS corpus, name, 'search' AS rule, 'exit 0 without a line' AS problem FROM c WHERE k % 4 = 0
UNION ALL SELECT 'chmod', name, 'exit status', 'exit status outside 0, 1' FROM c WHERE s % 5 = 2
UNION ALL SELECT 'chmod', name, 'report line', 'a changed line has one mode twice' FROM c WHERE s % 8 = 4
UNION ALL SELECT 'chmod', name, 'report line', '064' || s % 8 || ' isn''t shown as rw-r--r--' FROM c WHERE s % 8 <> 4
UNION ALL SELECT 'chmod', name, 'tree', 'a malformed mode: f' || k || ' x' FROM c WHERE s % 3 = 0
UNION ALL SELECT 'heldout', 'heldout-' || name, 'dual', 'no visible case that it mirrors' FROM c WHERE s % 2 = 0
UNION ALL SELECT 'heldout', name, 'name', 'a name that doesn''t begin with heldout-' FROM c WHERE k % 7 = 0 AND s % 2 = 1""")
def contract_violations(spark, sf_dir):
    """Cases of the three contracts out of the parts, broken in ways that their numbers say."""
    from tallyloom.operators.rules import corpus_violations

    p, k, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    name, none = F.concat(F.lit("c"), k.cast("string")).alias("name"), F.array().cast("array<string>")
    b64 = lambda c: F.base64(F.encode(c, "UTF-8"))
    search = p.select(
        name, F.array(F.lit("-i"), F.lit("x")).alias("args"), F.array(F.lit("-i")).alias("flags"), none.alias("absent_flags"), F.lit("golden").alias("check"), F.lit(0).alias("exit_code"),
        b64(F.when(k % 4 == 0, "").otherwise("x\n")).alias("stdout_b64"), F.lit("empty").alias("stderr_class"),
    )
    file, mode = F.concat(F.lit("f"), k.cast("string")), F.concat(F.lit("064"), (s % 8).cast("string"))
    line = F.concat(F.lit("mode of '"), file, F.lit("' changed from 0644 (rw-r--r--) to "), mode, F.lit(" (rw-r--r--)\n"))
    chmod = p.select(
        name, F.array(F.lit("-vR"), F.lit("644"), file).alias("args"), F.array(F.lit("-R"), F.lit("-v")).alias("flags"), none.alias("absent_flags"), none.alias("tags"), F.lit("golden").alias("check"),
        F.when(s % 5 == 2, 3).otherwise(0).alias("exit_code"), b64(line).alias("stdout_b64"), F.lit("empty").alias("stderr_class"),
        F.array(F.struct(file.alias("path"), F.lit("file").alias("type"))).alias("fixture"), F.create_map(file, F.when(s % 3 == 0, "x").otherwise("0644")).alias("expected_tree"),
    )
    odd = (k % 7 == 0) & (s % 2 == 1)
    held = p.select(F.when(odd, name).otherwise(F.concat(F.lit("heldout-"), name)).alias("name"), none.alias("args"), none.alias("flags"), F.lit(0).alias("exit_code"), F.when(s % 2 == 1, "visible").alias("dual_of"))
    return corpus_violations(search, chmod, held)
