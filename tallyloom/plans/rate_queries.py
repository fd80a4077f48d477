"""Rates, repair outcomes and numeric summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.stats import five_numbers, six_numbers
from tallyloom.operators import reliability as R
from tallyloom.plans.registry import query
from tallyloom.plans.shared import table

Z = "1.959963984540054"


def wilson_sql(s: str, n: str, side: str) -> str:
    """One bound of the interval in SQL."""
    sign, clamp = ("-", "greatest(0.0, {})") if side == "lower" else ("+", "least(1.0, {})")
    p = f"({s}::DOUBLE / {n})"
    inner = f"({p} + {Z} * {Z} / (2.0 * {n}) {sign} {Z} * sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4.0 * {n} * {n}))) / (1 + {Z} * {Z} / {n})"
    return f"CASE WHEN {n} > 0 THEN round({clamp.format(inner)}, 6) END"


def pass_sql(n: str, c: str, k: int) -> str:
    product = f"list_product(list_transform(range({k}), lambda i: ({n} - {c} - i)::DOUBLE / greatest({n} - i, 1)))"
    return f"CASE WHEN {n} >= {k} THEN round(CASE WHEN {n} - {c} < {k} THEN 1.0 ELSE 1 - {product} END, 6) END"


def rounded(df, *keep: str):
    """Doubles to six places, -0.0 as 0.0."""
    return df.select(*[(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


ATTEMPTS = """
WITH a AS (
  SELECT d.source, d.lang, d.doc_id, coalesce(l.quality = 1, false) AS success, l.doc_id IS NULL AS infra, d.n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
r AS (
  SELECT source, count(*) AS n_attempts, count(*) FILTER (WHERE infra) AS n_infrastructure_failures,
         count(*) FILTER (WHERE success) AS successes, count(*) FILTER (WHERE success AND NOT infra) AS successes_valid,
         count(*) FILTER (WHERE NOT infra) AS n_valid
  FROM a GROUP BY source)
"""


def attempts(spark, sf_dir):
    """Documents as attempts: quality 1 is success, no label an infrastructure failure."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left").withColumns({"success": F.coalesce(F.col("quality") == 1, F.lit(False)), "infrastructure_failure": F.col("quality").isNull()})


@query(ATTEMPTS + f"""
SELECT source, n_attempts, n_infrastructure_failures, successes, successes_valid, n_valid,
  round(n_infrastructure_failures::DOUBLE / n_attempts, 6) AS attrition_rate, round(successes::DOUBLE / n_attempts, 6) AS end_to_end_rate,
  CASE WHEN n_valid > 0 THEN round(successes_valid::DOUBLE / n_valid, 6) END AS conditional_rate,
  {wilson_sql("successes", "n_attempts", "lower")} AS end_to_end_lower, {wilson_sql("successes", "n_attempts", "upper")} AS end_to_end_upper,
  {wilson_sql("successes_valid", "n_valid", "lower")} AS conditional_lower, {wilson_sql("successes_valid", "n_valid", "upper")} AS conditional_upper,
  {pass_sql("n_attempts", "successes", 1)} AS pass_at_1, {pass_sql("n_attempts", "successes", 5)} AS pass_at_5, {pass_sql("n_attempts", "successes", 10)} AS pass_at_10
FROM r""")
def rate_report(spark, sf_dir):
    rates = R.success_rates(attempts(spark, sf_dir), ["source"])
    rates = R.with_wilson(rates, {"end_to_end": ("successes", "n_attempts"), "conditional": ("successes_valid", "n_valid")})
    return rounded(R.with_pass_at_k(rates))


@query(ATTEMPTS + f""", t AS (SELECT sum(n_attempts)::BIGINT AS n, sum(n_infrastructure_failures)::BIGINT AS i, sum(successes)::BIGINT AS s, sum(n_valid)::BIGINT AS v, sum(successes_valid)::BIGINT AS sv FROM r)
SELECT 'attrition' AS metric, round(i::DOUBLE / n, 6) AS estimate, {wilson_sql("i", "n", "lower")} AS lower, {wilson_sql("i", "n", "upper")} AS upper, n FROM t
UNION ALL SELECT 'end_to_end', round(s::DOUBLE / n, 6), {wilson_sql("s", "n", "lower")}, {wilson_sql("s", "n", "upper")}, n FROM t
UNION ALL SELECT 'conditional', round(sv::DOUBLE / v, 6), {wilson_sql("sv", "v", "lower")}, {wilson_sql("sv", "v", "upper")}, v FROM t""")
def wilson_bundle(spark, sf_dir):
    total = R.success_rates(attempts(spark, sf_dir), [])
    return rounded(R.wilson_bundle(total, {"attrition": ("n_infrastructure_failures", "n_attempts"), "end_to_end": ("successes", "n_attempts"), "conditional": ("successes_valid", "n_valid")}))


@query("""
WITH a AS (SELECT d.lang, coalesce(l.quality = 1, false) AS ok, coalesce(d.n_chars >= 1000, false) AS complete
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT lang, count(*) FILTER (WHERE ok AND complete) AS included, count(*) FILTER (WHERE ok) AS successful,
  CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN round(count(*) FILTER (WHERE ok AND complete)::DOUBLE / count(*) FILTER (WHERE ok), 6) END AS coverage
FROM a GROUP BY lang""")
def primary_population(spark, sf_dir):
    rows = attempts(spark, sf_dir).withColumn("complete", F.col("n_chars") >= 1000)
    return rounded(R.primary_population(rows, ["lang"], "complete"))


@query("""
WITH a AS (SELECT d.lang, coalesce(l.quality = 1, false) AS ok, coalesce(d.n_chars >= 1000, false) AS complete
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT population, count(*) AS n FROM (
  SELECT unnest(list_filter(['all', CASE WHEN complete THEN 'complete' END, CASE WHEN ok THEN 'passing' END, CASE WHEN ok AND complete THEN 'passing_complete' END], lambda x: x IS NOT NULL)) AS population FROM a)
GROUP BY population""")
def populations(spark, sf_dir):
    rows = attempts(spark, sf_dir).withColumn("complete", F.col("n_chars") >= 1000)
    return R.populations(rows, "complete", "success").groupBy("population").agg(F.count("*").alias("n"))


@query("""
SELECT l_returnflag, count(l_extendedprice) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 4) AS mean,
  round(median(l_extendedprice), 4) AS median, max(l_extendedprice) AS max, round(stddev_samp(l_extendedprice), 4) AS sample_sd, min(l_extendedprice) AS min
FROM lineitem GROUP BY l_returnflag""")
def summary_stats(spark, sf_dir):
    x = "l_extendedprice"
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*five_numbers(x), *[c for c in six_numbers(x, "s_")])
    return out.select("l_returnflag", "n", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), "max", F.round("s_sample_sd", 4).alias("sample_sd"), F.col("s_min").alias("min"))


@query("""
SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, round(median(n_chars), 4) AS median, round(stddev_samp(n_chars), 4) AS sample_sd,
  round(stddev_samp(n_chars) / avg(n_chars), 6) AS cv FROM documents GROUP BY lang""")
def source_size(spark, sf_dir):
    out = table(spark, sf_dir, "documents").groupBy("lang").agg(*six_numbers("n_chars"))
    return out.select("lang", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round("sample_sd", 4).alias("sample_sd"), F.round(F.try_divide("sample_sd", "mean"), 6).alias("cv"))


CONVERSATIONS = """
WITH t AS (SELECT *, length(text) > 200 AS ok FROM conversations),
a AS (
  SELECT conv_id, arg_min(role, turn) AS kind, coalesce(arg_min(ok, turn), false) AS initial_success, max(CASE WHEN ok THEN 1 ELSE 0 END) = 1 AS public_success,
    min(turn) FILTER (WHERE ok) AS success_loop, max(turn) AS repair_loops, count(*) AS llm_invocations, sum(length(text)) AS repair_ms,
    conv_id % 11 = 0 AS infra,
    CASE WHEN conv_id % 7 = 0 THEN 'timeout' WHEN conv_id % 5 = 0 THEN 'timeout_with_candidate' ELSE 'completed' END AS status
  FROM t GROUP BY conv_id),
v AS (SELECT *, NOT initial_success AND status IN ('completed', 'timeout_with_candidate') AS eligible FROM a WHERE NOT infra)
"""


def conversation_attempts(spark, sf_dir):
    """Conversations as attempts: turns are loops, a long text is a success, ids decide on other outcomes."""
    t = table(spark, sf_dir, "conversations").withColumn("ok", F.length("text") > 200)
    return t.groupBy("conv_id").agg(
        F.coalesce(F.min_by("ok", "turn"), F.lit(False)).alias("initial_success"), F.coalesce(F.bool_or("ok"), F.lit(False)).alias("public_success"),
        F.min(F.when(F.col("ok"), F.col("turn"))).alias("success_loop"), F.max("turn").alias("repair_loops"), F.count("*").alias("llm_invocations"), F.sum(F.length("text")).alias("repair_ms"),
    ).withColumns({
        "infrastructure_failure": F.col("conv_id") % 11 == 0,
        "status": F.when(F.col("conv_id") % 7 == 0, "timeout").when(F.col("conv_id") % 5 == 0, "timeout_with_candidate").otherwise("completed"), "all": F.lit("all"),
    })


@query(CONVERSATIONS + """
SELECT 'all' AS "all", count(*) AS n_valid, count(*) FILTER (WHERE initial_success) AS initial_successes, count(*) FILTER (WHERE public_success) AS final_successes,
  count(*) FILTER (WHERE eligible) AS eligible,
  count(*) FILTER (WHERE eligible AND public_success AND coalesce(CASE WHEN success_loop IS NOT NULL THEN success_loop > 0 ELSE repair_loops > 0 END, false)) AS recovered,
  count(*) FILTER (WHERE NOT initial_success AND NOT eligible) AS ineligible,
  round(avg(repair_loops), 6) AS mean_loops, round(median(repair_loops), 6) AS median_loops, max(repair_loops) AS max_loops, round(avg(llm_invocations), 6) AS mean_invocations,
  round(avg(repair_ms / 1000.0), 6) AS mean_repair_s, round(avg(repair_loops) FILTER (WHERE public_success), 6) AS mean_loops_success,
  round(avg(repair_loops) FILTER (WHERE NOT public_success), 6) AS mean_loops_failed,
  round(count(*) FILTER (WHERE initial_success)::DOUBLE / count(*), 6) AS initial_rate, round(count(*) FILTER (WHERE public_success)::DOUBLE / count(*), 6) AS final_rate,
  round(count(*) FILTER (WHERE eligible AND public_success AND coalesce(CASE WHEN success_loop IS NOT NULL THEN success_loop > 0 ELSE repair_loops > 0 END, false))::DOUBLE / nullif(count(*) FILTER (WHERE eligible), 0), 6) AS recovery_rate
FROM v""")
def repair_summary(spark, sf_dir):
    return rounded(R.repair_summary(conversation_attempts(spark, sf_dir), ["all"]))


@query(CONVERSATIONS + """
SELECT CAST(g.loop AS INTEGER) AS loop, (SELECT count(*) FROM v WHERE success_loop <= g.loop) AS successful,
  round((SELECT count(*) FROM v WHERE success_loop <= g.loop)::DOUBLE / (SELECT count(*) FROM v), 6) AS success_rate
FROM (SELECT unnest(range(0, (SELECT greatest(max(repair_loops), 8) FROM v) + 1)) AS loop) g""")
def success_curve(spark, sf_dir):
    return rounded(R.success_curve(conversation_attempts(spark, sf_dir), ["all"], 8).drop("all"))


@query(CONVERSATIONS + "SELECT status, count(*) AS n FROM v WHERE NOT initial_success AND NOT eligible GROUP BY status")
def ineligible_stages(spark, sf_dir):
    return R.ineligible_stages(conversation_attempts(spark, sf_dir), ["all"]).drop("all")


STATUS_INPUT = """
WITH e AS (SELECT event_id, event_id % 13 = 0 AS infra, event_id % 3 = 0 AS late, event_type, user_id,
  CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 0 WHEN event_id % 4 = 2 THEN 124 ELSE 1 END AS first_code,
  event_id % 17 = 0 AS rejected, event_id % 5 AS repair_loops,
  CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 1 THEN 0 WHEN event_id % 6 = 2 THEN 124 ELSE 2 END AS code, event_id % 2 = 0 AS has_loops
  FROM events)
"""


@query(STATUS_INPUT + """
SELECT status, count(*) AS n FROM (SELECT CASE WHEN infra THEN 'infrastructure_failure'
  WHEN has_loops THEN CASE WHEN rejected THEN 'permission_rejection' WHEN first_code = 0 THEN 'completed' WHEN first_code = 124 THEN CASE WHEN late THEN 'timeout_with_candidate' ELSE 'timeout' END
    WHEN first_code IS NOT NULL THEN 'opencode_error' ELSE 'unknown_initial_invocation' END
  WHEN repair_loops > 0 THEN 'completed' WHEN rejected THEN 'permission_rejection' WHEN code = 0 THEN 'completed'
  WHEN code = 124 THEN CASE WHEN late THEN 'timeout_with_candidate' ELSE 'timeout' END WHEN code IS NOT NULL THEN 'opencode_error'
  ELSE 'unknown_initial_invocation' END AS status FROM e) GROUP BY status""")
def initial_status(spark, sf_dir):
    i = F.col("event_id")
    code = F.when(i % 4 == 0, None).when(i % 4 == 1, 0).when(i % 4 == 2, 124).otherwise(1)
    rows = table(spark, sf_dir, "events").select(
        (i % 13 == 0).alias("infrastructure_failure"), (i % 3 == 0).alias("candidate_after_timeout"), (i % 17 == 0).alias("permission_rejected"), (i % 5).alias("repair_loops"),
        F.lit(None).cast("int").alias("initial_exit_code"), F.when(i % 6 == 0, None).when(i % 6 == 1, 0).when(i % 6 == 2, 124).otherwise(2).alias("exit_code"),
        F.lit(False).alias("agent_failure"), F.lit(None).cast("string").alias("agent_failure_stage"),
        F.when(i % 2 == 0, F.array(F.struct((i % 17 == 0).alias("permission_rejected"), code.alias("exit_code")))).alias("loops"),
    )
    return rows.groupBy(R.initial_status().alias("status")).agg(F.count("*").alias("n"))
