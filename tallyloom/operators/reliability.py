"""Success rates, repair outcomes and the classification of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import pass_at_k, rate, wilson

REPAIRABLE = ["completed", "timeout_with_candidate"]


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def success_rates(attempts: DataFrame, by: list[str], success: str = "success", infrastructure: str = "infrastructure_failure") -> DataFrame:
    """Counts and rates by group; those out of 0 are null."""
    ok, infra = _flag(success), _flag(infrastructure)
    out = attempts.groupBy(*by).agg(F.count("*").alias("n_attempts"), F.count_if(infra).alias("n_infrastructure_failures"), F.count_if(ok).alias("successes"), F.count_if(ok & ~infra).alias("successes_valid"))
    out = out.withColumn("n_valid", F.col("n_attempts") - F.col("n_infrastructure_failures"))
    return out.withColumns({"attrition_rate": rate("n_infrastructure_failures", "n_attempts"), "end_to_end_rate": rate("successes", "n_attempts"), "conditional_rate": rate("successes_valid", "n_valid")})


def with_wilson(rates: DataFrame, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """For each metric (successes, total) the columns <metric>_lower and <metric>_upper."""
    out = rates
    for name, (hit, total) in metrics.items():
        w = wilson(hit, total)
        out = out.withColumns({f"{name}_lower": w["lower"], f"{name}_upper": w["upper"]})
    return out


def wilson_bundle(row: DataFrame, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """metric, estimate, lower, upper, n: one row a metric for each row of counts."""
    items = [F.struct(F.lit(m).alias("metric"), wilson(h, t).alias("w")) for m, (h, t) in metrics.items()]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.metric", "x.w.*")


def with_pass_at_k(rates: DataFrame, ks=(1, 5, 10), total: str = "n_attempts", correct: str = "successes") -> DataFrame:
    return rates.withColumns({f"pass_at_{k}": pass_at_k(total, correct, k) for k in ks})


def initial_status(loops: Column | None = None) -> Column:
    """How the first invocation ended, from infrastructure_failure, candidate_after_timeout, loops, initial_exit_code, repair_loops,
    permission_rejected, exit_code, agent_failure and agent_failure_stage; the first record counts before totals do.
    """
    loops = F.col("loops") if loops is None else loops
    first = F.get(loops, F.lit(0))
    late = F.when(_flag("candidate_after_timeout"), "timeout_with_candidate").otherwise("timeout")

    def by_code(code: Column) -> Column:
        return F.when(code == 0, "completed").when(code == 124, late).when(code.isNotNull(), "opencode_error")

    with_loops = (
        F.when(F.coalesce(first["permission_rejected"], F.lit(False)), "permission_rejection")
        .when(first["exit_code"].isNotNull(), by_code(first["exit_code"]))
        .when(F.size(loops) > 1, "completed").otherwise("unknown_initial_invocation")
    )
    by_stage = F.when(F.col("agent_failure_stage") == "permission", "permission_rejection").when(F.col("agent_failure_stage") == "timeout", "timeout").otherwise("opencode_error")
    return (
        F.when(_flag("infrastructure_failure"), "infrastructure_failure")
        .when(F.coalesce(F.size(loops), F.lit(0)) > 0, with_loops)
        .when(F.col("initial_exit_code").isNotNull(), by_code(F.col("initial_exit_code")))
        .when(F.col("repair_loops") > 0, "completed")
        .when(_flag("permission_rejected"), "permission_rejection")
        .when(F.col("exit_code").isNotNull(), by_code(F.col("exit_code")))
        .when(_flag("agent_failure"), by_stage)
        .otherwise("unknown_initial_invocation")
    )


def public_success(explicit: str = "public_validation", codes: tuple[str, ...] = ("build_exit_code", "feature_exit_code", "regression_exit_code")) -> Column:
    """What is recorded, else that all exit codes are 0."""
    all_zero = F.lit(True)
    for c in codes:
        all_zero = all_zero & F.coalesce(F.col(c) == 0, F.lit(False))
    return F.coalesce(F.col(explicit), all_zero)


def normalized_attempts(attempts: DataFrame) -> DataFrame:
    """infrastructure_failure, agent_failure, agent_failure_stage and success of attempts, from what was recorded.

    Setup that failed before any invocation is infrastructure. Exit 124 with a candidate is no agent failure. Of
    several stages permission goes before timeout, before what is recorded, before a nonzero exit. Either failure undoes success.
    """
    infra = _flag("setup_failed") & (F.coalesce("llm_invocations", F.lit(0)) == 0)
    code = F.col("exit_code")
    stage = (
        F.when(_flag("permission_rejected"), "permission")
        .when((code == 124) & ~_flag("candidate_after_timeout"), "timeout")
        .when(F.col("recorded_stage").isNotNull(), F.col("recorded_stage"))
        .when((code != 0) & (code != 124), "opencode")
    )
    out = attempts.withColumn("infrastructure_failure", infra)
    out = out.withColumn("agent_failure_stage", F.when(~F.col("infrastructure_failure"), stage)).withColumn("agent_failure", F.col("agent_failure_stage").isNotNull())
    return out.withColumn("success", F.coalesce("success", F.lit(False)) & ~F.col("infrastructure_failure") & ~F.col("agent_failure"))


def repair_summary(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Repair outcomes of the attempts that aren't infrastructure failures.

    attempts: initial_success, public_success, status (initial_status), success_loop, repair_loops, llm_invocations, repair_ms.
    """
    valid = attempts.filter(~_flag("infrastructure_failure"))
    first, final = _flag("initial_success"), _flag("public_success")
    eligible = ~first & F.col("status").isin(REPAIRABLE)
    recovered = eligible & final & F.coalesce(F.when(F.col("success_loop").isNotNull(), F.col("success_loop") > 0).otherwise(F.col("repair_loops") > 0), F.lit(False))
    loops = F.coalesce("repair_loops", F.lit(0))
    out = valid.groupBy(*by).agg(
        F.count("*").alias("n_valid"), F.count_if(first).alias("initial_successes"), F.count_if(final).alias("final_successes"),
        F.count_if(eligible).alias("eligible"), F.count_if(recovered).alias("recovered"), F.count_if(~first & ~F.col("status").isin(REPAIRABLE)).alias("ineligible"),
        F.avg(loops).alias("mean_loops"), F.median(loops).alias("median_loops"), F.max(loops).alias("max_loops"),
        F.avg(F.coalesce("llm_invocations", F.lit(1))).alias("mean_invocations"), F.avg(F.coalesce("repair_ms", F.lit(0)) / 1000).alias("mean_repair_s"),
        F.avg(F.when(final, F.col("repair_loops"))).alias("mean_loops_success"), F.avg(F.when(~final, F.col("repair_loops"))).alias("mean_loops_failed"),
    )
    return out.withColumns({"initial_rate": rate("initial_successes", "n_valid"), "final_rate": rate("final_successes", "n_valid"), "recovery_rate": rate("recovered", "eligible")})


def ineligible_stages(attempts: DataFrame, by: list[str]) -> DataFrame:
    """How often each status kept an initial failure from repair."""
    valid = attempts.filter(~_flag("infrastructure_failure") & ~_flag("initial_success") & ~F.col("status").isin(REPAIRABLE))
    return valid.groupBy(*by, "status").agg(F.count("*").alias("n"))


def success_curve(attempts: DataFrame, by: list[str], max_loops: int = 0) -> DataFrame:
    """Cumulative successes by loop budget, from 0 to the larger of max_loops and what was seen; by group."""
    valid = attempts.filter(~_flag("infrastructure_failure"))
    size = valid.groupBy(*by).agg(F.count("*").alias("n"), F.greatest(F.max(F.coalesce("repair_loops", F.lit(0))), F.lit(max_loops)).alias("_top"))
    at = valid.filter("success_loop is not null").groupBy(*by, F.col("success_loop").cast("int").alias("loop")).agg(F.count("*").alias("_k"))
    grid = size.select(*by, "n", F.explode(F.sequence(F.lit(0), F.col("_top").cast("int"))).alias("loop"))
    so_far = Window.partitionBy(*by).orderBy("loop").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(at, [*by, "loop"], "left").withColumn("successful", F.coalesce(F.sum("_k").over(so_far), F.lit(0)))
    return out.select(*by, "loop", "successful", rate("successful", "n").alias("success_rate"))


def stage_ratios(attempts: DataFrame, by: list[str], codes: list[str]) -> DataFrame:
    """For each exit-code column the share of zeros among those not null."""
    return attempts.groupBy(*by).agg(*[F.avg((F.col(c) == 0).cast("int")).alias(f"{c}_ratio") for c in codes])


def primary_population(rows: DataFrame, by: list[str], complete: str, member: str = "success") -> DataFrame:
    """included, successful, coverage: successful runs that were measured completely."""
    ok = _flag(member)
    out = rows.groupBy(*by).agg(F.count_if(ok & _flag(complete)).alias("included"), F.count_if(ok).alias("successful"))
    return out.withColumn("coverage", rate("included", "successful"))


def populations(rows: DataFrame, complete: str, passing: str) -> DataFrame:
    """Each row once for every population that it is in: all, complete, passing, passing_complete."""
    c, p = _flag(complete), _flag(passing)
    names = F.array(F.lit("all"), F.when(c, "complete"), F.when(p, "passing"), F.when(c & p, "passing_complete"))
    return rows.withColumn("population", F.explode(F.array_compact(names)))


def with_source(rows: DataFrame, members: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """The rows of a population's members (key) that have a source (key)."""
    return rows.join(members.select(*key).distinct(), key, "left_semi").join(sources.select(*key).distinct(), key, "left_semi")
