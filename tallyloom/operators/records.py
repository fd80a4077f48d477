"""Lineage records as a table of events, folded into their state.

An event is (lineage, kind, checkpoint, success, reason, ts): kind init, stage or finish. A checkpoint that runs again replaces its
stage. A failed stage stops the record; finishing decides, whatever came before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.lineage import latest


def stage_table(events: DataFrame, order: DataFrame) -> DataFrame:
    """The last stage of each (lineage, checkpoint) with its place in the declared order (checkpoint, pos); undeclared ones come last."""
    stages = latest(events.filter("kind = 'stage'"), ["lineage", "checkpoint"], ["ts"])
    return stages.join(F.broadcast(order), "checkpoint", "left").withColumn("pos", F.coalesce("pos", F.lit(2**31 - 1)))


def record_state(events: DataFrame, order: DataFrame) -> DataFrame:
    """lineage, state, checkpoints_completed, completed_ids, failure_stage, failure_reason, started_at, updated_at, finished_at."""
    failed = F.when((F.col("kind") == "stage") & ~F.coalesce("success", F.lit(False)), F.struct("ts", "checkpoint", F.coalesce("reason", F.lit("unknown")).alias("reason")))
    finish = F.when(F.col("kind") == "finish", F.struct("ts", "success", "checkpoint", "reason"))
    facts = events.groupBy("lineage").agg(
        F.min(F.when(F.col("kind") == "init", F.col("ts"))).alias("started_at"), F.max("ts").alias("updated_at"), F.max(failed).alias("_f"), F.max(finish).alias("_e"),
    )
    passed = stage_table(events, order).filter("success").groupBy("lineage").agg(F.count("*").alias("checkpoints_completed"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "checkpoint"))), lambda x: x["checkpoint"]).alias("completed_ids"))
    won = F.coalesce("_e.success", F.lit(False))
    out = facts.join(passed, "lineage", "left")
    return out.select(
        "lineage", F.when(F.col("_e").isNotNull(), F.when(won, "completed").otherwise("stopped")).when(F.col("_f").isNotNull(), "stopped").otherwise("running").alias("state"),
        F.coalesce("checkpoints_completed", F.lit(0)).alias("checkpoints_completed"), F.coalesce("completed_ids", F.array().cast("array<string>")).alias("completed_ids"),
        F.when(~won, F.coalesce("_e.checkpoint", "_f.checkpoint")).alias("failure_stage"), F.when(~won, F.coalesce("_e.reason", "_f.reason")).alias("failure_reason"),
        "started_at", "updated_at", F.coalesce("_e.ts", "_f.ts").alias("finished_at"),
    )


def interrupted(records: DataFrame, now, patience: str) -> DataFrame:
    """records with the state controller_interrupted for those that still run and whose last event (a timestamp) lies more than patience before now."""
    quiet = (F.col("state") == "running") & (F.col("updated_at") + F.expr(f"interval '{patience}'") <= now)
    return records.withColumn("state", F.when(quiet, "controller_interrupted").otherwise(F.col("state")))
