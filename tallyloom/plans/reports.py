"""Whole reports, each a set of named tables made by the operators from the tables of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import behavior as B
from tallyloom.operators import cluster as C
from tallyloom.operators import distance as D
from tallyloom.operators import families as A
from tallyloom.operators import lineage as L
from tallyloom.operators import populations as P
from tallyloom.operators import reliability as R
from tallyloom.operators import security as S
from tallyloom.operators import suites as U
from tallyloom.operators import telemetry as T
from tallyloom.plans.shared import written

METRICS = {"attrition": ("n_infrastructure_failures", "n_attempts"), "end_to_end": ("successes", "n_attempts"), "conditional": ("successes_valid", "n_valid")}


def space_report(members: DataFrame, features: DataFrame, threshold: float, k_max: int | None = None, replicates: int = 1000, seed: int = 20260723) -> dict[str, DataFrame]:
    """One space's populations: members (population, run), features (run, block, feature, value). Bootstrap for passing_complete only.

    Vectors and distances are made once for the runs of all populations, which then go by the bits of a mask.
    """
    names = sorted(r["population"] for r in members.select("population").distinct().limit(P.MOST + 1).collect())
    masks = members.groupBy("run").agg(F.bit_or(P.bits(*[F.col("population") == n for n in names])).alias("mask"))
    rows = masks.select("run", F.lit("all").alias("space")).join(features, "run")
    held = written(C.dense_vectors(D.normalized_features(rows, ["space"]), ["space"]).join(masks, "run").select("run", "vector", "mask"), "vectors")
    vectors = P.expanded(held, names).select("population", "run", "vector")
    labels = written(C.clusters(vectors, ["population"], threshold), "families")
    families = vectors.join(labels, ["population", "run"])
    curve = A.discovery_curve(labels, ["population"], "family")
    small = vectors.filter("population = 'passing_complete'")
    return {
        "labels": labels, "structure": P.vector_structure(held, names), "family_stats": A.family_stats(labels, ["population"], "family"), "representatives": D.vector_representatives(families, ["population"], "run", "vector", "family"), "mean_pairwise": D.vector_mean(vectors, ["population"], "run", "vector"),
        "discovery_curve": curve, "discovery_auc": A.discovery_auc(curve, ["population"]), "discovery_auc_at_k": A.discovery_auc(curve, ["population"], k_max) if k_max else None,
        "vendi": C.vendi_scores(vectors, ["population"]), "sensitivity": C.sensitivity(vectors, ["population"], threshold), "bootstrap": C.bootstrap(small, ["population"], threshold, replicates, seed, k_max),
    }


def population_report(attempts: DataFrame, features: DataFrame, threshold: float = 0.3, max_loops: int = 0, **options) -> dict[str, DataFrame]:
    """Reliability, repair and structure of one experiment's attempts (run, complete, success, ... as in operators.reliability)."""
    whole = R.success_rates(attempts, [])
    members = R.populations(attempts, "complete", "success").select("population", F.col("run").cast("string").alias("run"))
    out = {"reliability": R.with_pass_at_k(whole, (1, 5, 10, 20, 50, 100)), "wilson": R.wilson_bundle(whole, METRICS), "primary_population": R.primary_population(attempts, [], "complete")}
    if "status" in attempts.columns:
        out |= {"repair": R.repair_summary(attempts, []), "success_curve": R.success_curve(attempts, [], max_loops), "ineligible": R.ineligible_stages(attempts, [])}
    if "source_sha256" in attempts.columns:
        out["exact_repetition"] = A.exact_repetition(attempts.filter("success"), [], "source_sha256", "run")
    return out | space_report(members, features, threshold, **options)


def lineage_report(stages: DataFrame, lineages: DataFrame, checkpoints: DataFrame, planned: DataFrame | None = None, profiles: DataFrame | None = None) -> dict[str, DataFrame]:
    """Reliability, checkpoints, transitions and provenance; lineages: lineage, state, failed_checkpoint."""
    moves = L.transitions(stages, ["lines"])
    delta = F.col("lines_after") - F.col("lines_before")
    out = {
        "reliability": L.reliability(lineages, []), "failures": L.failure_counts(lineages, checkpoints), "checkpoints": L.checkpoint_rows(stages, checkpoints), "transitions": moves,
        "transition_summary": L.transition_summary(moves.withColumns({"added": F.greatest(delta, F.lit(0)), "deleted": F.greatest(-delta, F.lit(0))})), "total_change": L.first_last(stages, ["lines"], ["loops"]),
    }
    if {"seed_hash", "candidate_hash", "source_mode"} <= set(stages.columns):
        out["provenance_problems"] = L.seed_problems(stages)
    if planned is not None:
        out["never_started"] = L.not_started(planned, lineages, "lineage")
    if profiles is not None:
        out["security"] = S.population_rollup(profiles, [])
    return out


def behavior_report(results: DataFrame, labels: DataFrame | None = None) -> dict[str, DataFrame]:
    """Convergence, disagreement and stability of verdict traces (space, run, case_id, verdict); labels: space, run, family."""
    prints = B.trace_fingerprints(results, ["space"])
    pairs = B.disagreement(results, ["space"])
    out = {"problems": B.trace_problems(results, ["space"]), "fingerprints": prints, "convergence": A.exact_repetition(prints, ["space"], "fingerprint", "run"), "disagreement": B.disagreement_summary(pairs, ["space"]), "stability": B.case_count_stability(results, ["space"])}
    if labels is not None:
        out["agreement"] = A.agreement(labels.join(prints, ["space", "run"]), ["space"], "family", "fingerprint")
    return out


def suite_report(results: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """Counts, summaries and worst failures of results (suite, case_id, verdict)."""
    return {"counts": B.verdict_counts(results, []), "by_suite": B.verdict_counts(results, ["suite"]), "summary": U.suite_summary(results, ["suite"]), "failures": U.top_failures(results, ["suite"], k, ["case_id"])}


def telemetry_report(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> dict[str, DataFrame]:
    """Sessions in order with their messages' totals, parts by type, tools over all; tables: (id, directory, time_created), (session_id, data)."""
    numbered = T.with_ordinal(sessions, ["directory"], "time_created", "id")
    totals = T.message_rollup(messages, ["session_id"])
    by_part = T.part_rollup(parts, ["session_id"])
    sums = [F.sum(c).alias(c) for c, t in totals.dtypes if c != "session_id" and t in ("bigint", "double")]
    return {"sessions": numbered.join(totals, F.col("id") == F.col("session_id"), "left"), "parts": by_part, "tools": T.tool_totals(by_part), "total": totals.agg(*sums)}
