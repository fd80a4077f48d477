"""Queries that run a stream over a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.registry import query
from tallyloom.plans.shared import shared_dir, table
from tallyloom.streaming import records


def lifecycle(events: DataFrame) -> DataFrame:
    """Users as lineages: signups start them, high purchases finish them, what else happens are their stages."""
    high, stage = (F.col("event_type") == "purchase") & (F.col("value") > 99), F.concat_ws("-", "event_type", (F.col("event_id") % 3).cast("string"))
    kind = F.when(F.col("event_type") == "signup", "init").when(high, "finish").otherwise("stage")
    return events.select(
        F.col("user_id").alias("lineage"), kind.alias("kind"), F.when(kind == "stage", stage).alias("checkpoint"), F.when(kind == "stage", F.coalesce(F.col("value") > 1, F.lit(True))).otherwise(F.col("event_id") % 2 == 0).alias("success"),
        F.when(kind == "stage", F.concat(F.lit("value "), F.round("value", 2).cast("string"))).when(kind == "finish", "late").alias("reason"),
        F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")).alias("ts"),  # whatever the session's time zone
    )


def order(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{t}-{k}", i) for i, (t, k) in enumerate((t, k) for t in ("view", "click", "error") for k in range(3))], "checkpoint string, pos int")


@query("""WITH e AS (SELECT user_id AS lineage, ts, CASE WHEN event_type = 'signup' THEN 'init' WHEN event_type = 'purchase' AND value > 99 THEN 'finish' ELSE 'stage' END AS kind, event_type || '-' || event_id % 3 AS checkpoint,
  coalesce(value > 1, true) AS ok, event_id % 2 = 0 AS won FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
l AS (SELECT lineage, checkpoint, arg_max(ok, ts) AS ok FROM e WHERE kind = 'stage' GROUP BY ALL), p AS (SELECT lineage, count(*) AS n FROM l WHERE ok GROUP BY lineage),
r AS (SELECT lineage, min(ts) FILTER (WHERE kind = 'init') AS started_at, max(ts) AS updated_at, max(ts) FILTER (WHERE kind = 'finish') AS ended_at, arg_max(won, ts) FILTER (WHERE kind = 'finish') AS won,
  max(ts) FILTER (WHERE kind = 'stage' AND NOT ok) AS failed_at, arg_max(checkpoint, ts) FILTER (WHERE kind = 'stage' AND NOT ok) AS failed FROM e GROUP BY lineage)
SELECT lineage, CASE WHEN ended_at IS NOT NULL THEN CASE WHEN won THEN 'completed' ELSE 'stopped' END WHEN failed_at IS NOT NULL THEN 'stopped' WHEN updated_at + INTERVAL 1 DAY <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR THEN 'controller_interrupted' ELSE 'running' END AS state,
  CAST(coalesce(n, 0) AS INTEGER) AS checkpoints_completed, CASE WHEN NOT coalesce(won, false) THEN failed END AS failure_stage, epoch_us(started_at) AS started_us, epoch_us(updated_at) AS updated_us, epoch_us(coalesce(ended_at, failed_at)) AS finished_us
FROM r LEFT JOIN p USING (lineage)""")
def streamed_records(spark, sf_dir):
    """Records kept by a stream over all events, as it leaves them."""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    base = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    found = records.record_stream(lifecycle(stream), order(spark))
    records.write_records(found, f"{base}/rows", f"{base}/checkpoint").awaitTermination()
    out = records.read_records(spark, f"{base}/rows")
    return out.select("lineage", "state", "checkpoints_completed", "failure_stage", *[F.unix_micros(f"{c}_at").alias(f"{c}_us") for c in ("started", "updated", "finished")])
