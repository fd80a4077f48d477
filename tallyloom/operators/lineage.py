"""Lineages: runs through a ladder of checkpoints, their transitions, losses and provenance.

Stages are rows (lineage, pos, checkpoint, success, ...), ordered by pos within a lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import five_numbers, rate, wilson


def _stages(by: str = "lineage") -> Window:
    return Window.partitionBy(by).orderBy("pos")


def classify(status: str = "status", stop_reason: str = "stop_reason") -> Column:
    """completed, stopped or controller_interrupted; a record that still runs, or none, was interrupted."""
    s = F.col(status)
    return F.when(s == "completed", "completed").when((s == "stopped") | (s.isNull() & F.col(stop_reason).isNotNull()), "stopped").otherwise("controller_interrupted")


def passed_prefix(stages: DataFrame, success: str = "success") -> DataFrame:
    """Stages up to the first that failed, that one not included."""
    so_far = _stages().rowsBetween(Window.unboundedPreceding, 0)
    return stages.withColumn("_ok", F.min(F.coalesce(F.col(success).cast("int"), F.lit(0))).over(so_far)).filter("_ok = 1").drop("_ok")


def transitions(stages: DataFrame, values: list[str], success: str = "success", measured: str | None = None) -> DataFrame:
    """lineage, pos, from_checkpoint, to_checkpoint and, for each value, before and after, of adjacent stages that both passed."""
    order = _stages()
    rows = passed_prefix(stages, success)
    keep = ["checkpoint", *values]
    out = rows.withColumns({f"_before_{c}": F.lag(c).over(order) for c in keep} | {"_nth": F.row_number().over(order)}).filter("_nth > 1")
    if measured:
        out = out.filter(F.col(measured))
    columns = [c for v in values for c in (F.col(f"_before_{v}").alias(f"{v}_before"), F.col(v).alias(f"{v}_after"))]
    return out.select("lineage", "pos", F.col("_before_checkpoint").alias("from_checkpoint"), F.col("checkpoint").alias("to_checkpoint"), *columns)


def transition_summary(changes: DataFrame, added: str = "added", deleted: str = "deleted") -> DataFrame:
    """By destination: transitions, measured ones, mean added, deleted and edited lines, median edited."""
    edited = F.col(added) + F.col(deleted)
    return changes.groupBy("to_checkpoint").agg(F.count("*").alias("n"), F.count(edited).alias("measured"), F.avg(added).alias("mean_added"), F.avg(deleted).alias("mean_deleted"), F.avg(edited).alias("mean_edited"), F.median(edited).alias("median_edited"))


def first_last(stages: DataFrame, values: list[str], sums: list[str] = ()) -> DataFrame:
    """For completed lineages of two stages or more: first and last of each value, and sums over the stages."""
    out = stages.groupBy("lineage").agg(
        F.count("*").alias("n_stages"), F.bool_and(F.coalesce(F.col("success").cast("boolean"), F.lit(False))).alias("_all"),
        *[F.min_by(v, "pos").alias(f"{v}_first") for v in values], *[F.max_by(v, "pos").alias(f"{v}_last") for v in values],
        *[F.sum(s).alias(f"{s}_sum") for s in sums],
    )
    return out.filter("_all and n_stages >= 2").drop("_all")


def checkpoint_rows(stages: DataFrame, checkpoints: DataFrame, value: str = "loops") -> DataFrame:
    """For every declared checkpoint (checkpoint, pos), even unreached: reached, passed, rate with bounds, first-try passes, loop numbers."""
    ok, tries = F.coalesce(F.col("success").cast("boolean"), F.lit(False)), F.coalesce(F.col(value), F.lit(0))
    agg = stages.groupBy("checkpoint").agg(F.count("*").alias("reached"), F.count_if(ok).alias("passed"), F.count_if(ok & (tries == 0)).alias("initial_successes"), F.count_if(ok & (tries > 0)).alias("after_repair"), *five_numbers(value, f"{value}_"))
    out = checkpoints.join(agg, "checkpoint", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("reached", "passed", "initial_successes", "after_repair", f"{value}_n")})
    w = wilson("passed", "reached")
    return out.withColumns({"pass_rate": rate("passed", "reached"), "lower": w["lower"], "upper": w["upper"]})


def stop_reasons(stages: DataFrame) -> DataFrame:
    """checkpoint, stop_reason, n of stages that failed."""
    return stages.filter("not success").groupBy("checkpoint", "stop_reason").agg(F.count("*").alias("n"))


def failure_counts(lineages: DataFrame, checkpoints: DataFrame, failed: str = "failed_checkpoint") -> DataFrame:
    """Failures at every declared checkpoint, 0 included, and all others under `other`."""
    known = checkpoints.select(F.col("checkpoint").alias("_c"))
    hit = lineages.filter(F.col(failed).isNotNull()).join(known, F.col(failed) == F.col("_c"), "left").groupBy(F.coalesce("_c", F.lit("other")).alias("checkpoint")).agg(F.count("*").alias("n"))
    every = checkpoints.select("checkpoint").unionByName(lineages.sparkSession.createDataFrame([("other",)], "checkpoint string"))
    return every.join(hit, "checkpoint", "left").select("checkpoint", F.coalesce("n", F.lit(0)).alias("n"))


def reliability(lineages: DataFrame, by: list[str]) -> DataFrame:
    """started, completed, stopped, interrupted, rate with bounds, over all lineages that started (column state)."""
    out = lineages.groupBy(*by).agg(F.count("*").alias("started"), *[F.count_if(F.col("state") == s).alias(n) for s, n in (("completed", "completed"), ("stopped", "stopped"), ("controller_interrupted", "interrupted"))])
    w = wilson("completed", "started")
    return out.withColumns({"completion_rate": rate("completed", "started"), "lower": w["lower"], "upper": w["upper"]})


def not_started(planned: DataFrame, started: DataFrame, key: str) -> DataFrame:
    return planned.join(started.select(key), key, "left_anti")


def population(stages: DataFrame, completed: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """Members of a population: the last stage of each completed lineage, or the stages that passed one checkpoint."""
    if checkpoint is not None:
        return stages.filter((F.col("checkpoint") == checkpoint) & F.col("success"))
    last = F.row_number().over(Window.partitionBy("lineage").orderBy(F.desc("pos")))
    return stages.join(completed.select("lineage"), "lineage", "left_semi").withColumn("_n", last).filter("_n = 1").drop("_n")


def seed_problems(stages: DataFrame, seed: str = "seed_hash", candidate: str = "candidate_hash", mode: str = "source_mode") -> DataFrame:
    """Stages whose seed isn't the candidate before, or first stages that don't start new."""
    order = _stages()
    rows = stages.withColumns({"_before": F.lag(candidate).over(order), "_nth": F.row_number().over(order)})
    problem = F.when((F.col("_nth") == 1) & ~F.col(mode).eqNullSafe(F.lit("new")), "the first stage is not new").when((F.col("_nth") > 1) & ~F.col(seed).eqNullSafe(F.col("_before")), "the seed differs from the candidate before")
    return rows.withColumn("problem", problem).filter("problem is not null").select("lineage", "pos", "checkpoint", "problem")


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key; the order must be total."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return events.withColumn("_n", nth).filter("_n = 1").drop("_n")


def agreed(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The one non-null value of each group; an error where there are several."""
    many = F.count_distinct(value) > 1
    message = F.concat(F.lit(f"{value} disagrees: "), F.min(F.col(value).cast("string")), F.lit(" and "), F.max(F.col(value).cast("string")))
    kind = dict(rows.dtypes)[value]
    return rows.groupBy(*by).agg(F.when(many, F.raise_error(message).cast(kind)).otherwise(F.max(value)).alias(value))


def relocated(path: str, recorded_root: str, root: str) -> Column:
    """A recorded path under another root; null if it isn't below the recorded one."""
    p, old = F.col(path), F.regexp_replace(F.col(recorded_root), "/+$", "")
    return F.when(F.startswith(p, F.concat(old, F.lit("/"))), F.concat(F.regexp_replace(F.lit(root), "/+$", ""), F.substr(p, F.length(old) + 1)))


def checkpoint_order(stages: DataFrame, declared: list[str] | None = None) -> DataFrame:
    """checkpoint, pos: as declared, else by first appearance (lineage, pos)."""
    if declared:
        return stages.sparkSession.createDataFrame([(c, i) for i, c in enumerate(declared)], "checkpoint string, pos int")
    first = stages.groupBy("checkpoint").agg(F.min(F.struct("lineage", "pos")).alias("_f"))  # a row for each checkpoint
    return first.withColumn("pos", F.row_number().over(Window.orderBy("_f")) - 1).drop("_f")


def added_flags(stages: DataFrame, flags: str = "implemented_flags") -> DataFrame:
    """lineage, pos, added_flags: what each stage but the first implements beyond the stage before, in text order."""
    none = F.array().cast("array<string>")
    own = F.coalesce(F.col(flags), none)
    rows = stages.withColumns({"_before": F.coalesce(F.lag(flags).over(_stages()), none), "_nth": F.row_number().over(_stages())})
    return rows.filter("_nth > 1").select("lineage", "pos", F.array_sort(F.array_except(own, F.col("_before"))).alias("added_flags"))
