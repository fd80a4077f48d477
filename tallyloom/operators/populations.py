"""Populations as bits of a mask, so that all of them come from one scan and one table of pairs.

A row's mask says which populations it is in. Rows are expanded by their bits only where they are aggregated; a pair is in the populations that both of its runs are in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import rate, six_numbers
from tallyloom.operators.distance import run_distances, vector_pairs

MOST = 62  # populations in one mask
RUN_POPULATIONS = ["all", "complete", "passing", "passing_complete"]
FINAL = "final"


def bits(*flags: Column) -> Column:
    """A mask of conditions, the first one as bit 0; null is false."""
    if len(flags) > MOST:
        raise ValueError(f"at most {MOST} populations")
    out = F.lit(0).cast("long")
    for i, f in enumerate(flags):
        out = out + F.when(F.coalesce(f, F.lit(False)), F.lit(1 << i)).otherwise(0)
    return out


def run_mask(complete: str, passing: str) -> Column:
    """The mask of RUN_POPULATIONS."""
    c, p = F.col(complete).cast("boolean"), F.col(passing).cast("boolean")
    return bits(F.lit(True), c, p, c & p)


def stage_populations(order: list[str]) -> list[str]:
    return [FINAL, *order]


def with_stage_mask(stages: DataFrame, order: list[str]) -> DataFrame:
    """stages (lineage, checkpoint, pos, success) with the mask of stage_populations: the last stage of a lineage whose stages all passed, and the passed stages of each checkpoint."""
    own, ok = Window.partitionBy("lineage"), F.coalesce(F.col("success").cast("boolean"), F.lit(False))
    last = F.bool_and(ok).over(own) & (F.col("pos") == F.max("pos").over(own))
    return stages.withColumn("mask", bits(last, *[ok & (F.col("checkpoint") == c) for c in order]))


def expanded(rows: DataFrame, names: list[str], mask: str = "mask") -> DataFrame:
    """Each row once for every population that it is in, with the population in place of the mask."""
    held = F.filter(F.transform(F.array(*map(F.lit, names)), lambda n, i: F.when(F.getbit(mask, i) == 1, n)), lambda n: n.isNotNull())
    return rows.withColumn("population", F.explode(held)).drop(mask)


def declared(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "ord int, population string")


def security_rollup(profiles: DataFrame, names: list[str]) -> DataFrame:
    """A row for every population, also without members. profiles: mask, measured, n_findings, per_kloc, unsafe_calls, cwe_ids.

    Shares of runs are given only where every run was measured; numbers are over the measured ones.
    """
    rows = expanded(profiles.select("mask", "measured", *[F.when(F.col("measured"), F.col(c)).alias(c) for c in ("n_findings", "per_kloc", "unsafe_calls", "cwe_ids")]), names)
    out = rows.groupBy("population").agg(
        F.count("*").alias("runs"), F.count_if("measured").alias("measured_runs"), F.count_if(F.col("n_findings") > 0).alias("_found"), F.count_if(F.col("unsafe_calls") > 0).alias("_unsafe"),
        F.avg("unsafe_calls").alias("mean_unsafe_calls"), *six_numbers("n_findings", "findings_"), F.avg("per_kloc").alias("per_kloc_mean"), F.median("per_kloc").alias("per_kloc_median"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("cwe_ids")))).alias("cwe_ids"),
    )
    out = declared(profiles.sparkSession, names).join(out, "population", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("runs", "measured_runs", "findings_n")})
    whole = (F.col("runs") > 0) & (F.col("measured_runs") == F.col("runs"))
    return out.select(
        "population", "ord", "runs", "measured_runs", rate("measured_runs", "runs").alias("coverage"), F.when(whole, rate("_found", "runs")).alias("prevalence"), F.when(whole, rate("_unsafe", "runs")).alias("unsafe_prevalence"),
        "mean_unsafe_calls", *[f"findings_{c}" for c in ("n", "mean", "median", "sample_sd", "min", "max")], "per_kloc_mean", "per_kloc_median", F.coalesce(F.size("cwe_ids"), F.lit(0)).alias("distinct_cwes"),
    )


def severity_rollup(findings: DataFrame, runs: DataFrame, names: list[str]) -> DataFrame:
    """population, level, n findings, n runs with one, and their share of the population's runs. findings: run, level, mask; runs: mask."""
    sizes = expanded(runs.select("mask"), names).groupBy("population").agg(F.count("*").alias("_all"))
    per_run = findings.groupBy("run", "level", "mask").agg(F.count("*").alias("_n"))
    out = expanded(per_run, names).groupBy("population", "level").agg(F.sum("_n").alias("n"), F.count("*").alias("runs"))
    return out.join(sizes, "population").select("population", "level", "n", "runs", rate("runs", "_all").alias("share"))


def population_pairs(vectors: DataFrame, names: list[str]) -> DataFrame:
    """population, left, right, distance of all pairs of runs that share a population. vectors: run, vector, mask; each distance is computed once."""
    return expanded(vector_pairs(vectors, [], "run", "vector", mask="mask"), names)


def structure(vectors: DataFrame, pairs: DataFrame, names: list[str]) -> DataFrame:
    """A row for every population: runs, n_pairs, mean_distance, medoid (least mean distance to the others, then first) with its mean and largest distance, and why there is none."""
    ends = pairs.select("population", F.explode(F.array("left", "right")).alias("run"), "distance")
    each = ends.groupBy("population", "run").agg(F.sum("distance").alias("_sum"), F.count("*").alias("_n"), F.max("distance").alias("_max"))
    return _structure(vectors, each, names)


def vector_structure(vectors: DataFrame, names: list[str]) -> DataFrame:
    """structure() without a table of pairs: sums and maxima by run are made where blocks of runs meet. vectors: run, vector, mask."""
    each = run_distances(vectors, [], "run", "vector", "mask", len(names))
    return _structure(vectors, each.withColumn("population", F.element_at(F.array(*map(F.lit, names)), F.col("bit") + 1)), names)


def _structure(vectors: DataFrame, each: DataFrame, names: list[str]) -> DataFrame:
    """each: population, run with _sum, _n and _max of its distances. Means are compared to twelve places, so that equal ones are, in whatever order they were added."""
    sizes = expanded(vectors.select("run", "mask"), names).groupBy("population").agg(F.count("*").alias("runs"), F.min("run").alias("_first"))
    mean = F.col("_sum") / F.col("_n")
    best = F.min(F.struct(F.round(mean, 12), "run", mean.alias("mean"), F.col("_max").alias("max")))
    totals = each.groupBy("population").agg((F.sum("_n") / 2).cast("long").alias("n_pairs"), (F.sum("_sum") / F.sum("_n")).alias("mean_distance"), best.alias("_b"))
    out = declared(vectors.sparkSession, names).join(sizes, "population", "left").join(totals, "population", "left")
    some = F.col("runs").isNotNull()
    return out.select(
        "population", "ord", F.coalesce("runs", F.lit(0).cast("long")).alias("runs"), F.coalesce("n_pairs", F.lit(0).cast("long")).alias("n_pairs"), F.when(some, F.coalesce("mean_distance", F.lit(0.0))).alias("mean_distance"),
        F.coalesce("_b.run", "_first").alias("medoid"), F.when(some, F.coalesce("_b.mean", F.lit(0.0))).alias("medoid_mean"), F.when(some, F.coalesce("_b.max", F.lit(0.0))).alias("medoid_max"),
        F.when(~some, "no run in the population").alias("reason"),
    )
