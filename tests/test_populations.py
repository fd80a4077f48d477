"""Populations by masks: one scan, one table of pairs, declared populations without members."""

import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA

from tallyloom.operators import populations as P
from tallyloom.plans import population_queries as Q


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_scan(spark):
    plan = executed(P.security_rollup(Q.stages(spark, DATA), P.stage_populations(Q.ORDER)))
    final = plan.split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and final.count("Expand") == 0 and final.count("Generate") == 1


def test_masks(spark):
    rows = [(1, "a", 0, True), (1, "b", 1, True), (2, "a", 0, True), (2, "b", 1, None), (3, "x", 0, True), (None, "a", 0, False)]
    stages = spark.createDataFrame(rows, "lineage int, checkpoint string, pos int, success boolean")
    order = ["a", "b", "c"]
    got = {(r.population, r.lineage, r.checkpoint) for r in P.expanded(P.with_stage_mask(stages, order), P.stage_populations(order)).collect()}
    assert got == {("final", 1, "b"), ("final", 3, "x"), ("a", 1, "a"), ("a", 2, "a"), ("b", 1, "b")}
    runs = spark.createDataFrame([(1, True, None), (2, True, True), (3, False, True)], "run int, c boolean, p boolean")
    named = P.expanded(runs.withColumn("mask", P.run_mask("c", "p")), P.RUN_POPULATIONS)
    assert {(r.population, r.run) for r in named.collect()} == {("all", 1), ("all", 2), ("all", 3), ("complete", 1), ("complete", 2), ("passing", 2), ("passing", 3), ("passing_complete", 2)}
    with pytest.raises(ValueError):
        P.bits(*[F.lit(True)] * (P.MOST + 1))


def test_structure_of_few_runs(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 0b011), (2, [0.0, 1.0], 0b001), (3, [1.0, 1.0], 0b001)], "run int, vector array<double>, mask long")
    names = ["all", "one", "none"]
    pairs = P.population_pairs(vectors, names)
    assert {(r.population, r.left, r.right) for r in pairs.collect()} == {("all", 1, 2), ("all", 1, 3), ("all", 2, 3)}
    got = {r.population: r for r in P.structure(vectors, pairs, names).collect()}
    assert (got["all"].runs, got["all"].n_pairs, got["all"].medoid) == (3, 3, 3) and got["all"].medoid_max == pytest.approx(1 - 0.5**0.5)
    assert (got["one"].runs, got["one"].n_pairs, got["one"].medoid, got["one"].mean_distance) == (1, 0, 1, 0.0)
    assert (got["none"].runs, got["none"].mean_distance, got["none"].reason) == (0, None, "no run in the population")
