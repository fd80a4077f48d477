"""The two wide rows of an experiment in a report, and the row of the experiment that lineages belong to.

A summary is a table of one row an experiment and population with the columns named on the right below; what it doesn't have is null.
Views of survivors have no reliability and no baseline, so those columns are null whatever the summary says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.stats import pass_at_k

# The columns of both rows in order, and the summary's column for each
LABELS = {"Issue": "issue", "Checkpoint": "checkpoint", "Model": "model", "Temp": "temperature"}
SCOPE = {"Reliability Scope": "reliability_scope", "Population N": "population_n"}
LINEAGES = {"Lineages Started": "lineages_started", "Lineages Completed": "lineages_completed", "Lineage Completion Rate": "lineage_completion_rate"}
RELIABILITY = {
    "N Attempts": "n_attempts", "Valid Agent Trials": "n_valid_agent_trials", "Infrastructure Failures": "n_infrastructure_failures", "Infrastructure Attrition Rate": "attrition_rate",
    "Successful Runs": "successes", "End-to-End Success Rate": "end_to_end_rate", "Conditional Agent Success Rate": "conditional_rate", "Initial Public Success Rate": "initial_public_success_rate",
    "Final Public Success Rate": "final_public_success_rate", "Repair Recovery Rate": "repair_recovery_rate", "Pass@1": "pass_at_1", "Pass@5": "pass_at_5", "Pass@10": "pass_at_10",
}
STRUCTURE = {
    "Architecture Population N": "architecture_n", "Effective Architecture Families": "architecture_effective", "Dominant Architecture Family Share": "architecture_dominant_share", "Mean Pairwise Architecture Distance": "architecture_mean_distance",
    "Strategy Population N": "strategy_n", "Effective Strategy Families": "strategy_effective", "Dominant Strategy Family Share": "strategy_dominant_share", "Mean Pairwise Strategy Distance": "strategy_mean_distance",
    "Diversity K Max": "k_max",
}
DESCRIPTION = {
    "Raw Architecture Families": "architecture_raw", "Architecture Family-Discovery AUC@K": "architecture_auc", "Architecture Vendi Score": "architecture_vendi",
    "Raw Strategy Families": "strategy_raw", "Strategy Family-Discovery AUC@K": "strategy_auc", "Strategy Vendi Score": "strategy_vendi",
    "Exact Unique Rate": "unique_rate", "Exact Modal Share": "modal_share", "Mean Repair Loops": "repair_loops_mean", "Median Repair Loops": "repair_loops_median", "Max Repair Loops": "repair_loops_max",
    "Mean LLM Invocations": "llm_invocations_mean", "Mean Repair LLM Runtime (s)": "repair_seconds_mean", "Mean Total Runtime (s)": "runtime_mean", "Median Total Runtime (s)": "runtime_median",
    "Mean Source LOC": "loc_mean", "Median Source LOC": "loc_median", "SD Source LOC": "loc_sample_sd", "Source LOC CV": "loc_cv", "Mean Source Bytes": "bytes_mean",
}
MAINTENANCE = {
    "Mean Lines Edited": "lines_edited_mean", "Mean Files Edited": "files_edited_mean", "Mean Functions Edited": "functions_edited_mean", "Mean Functions Created": "functions_created_mean",
    "Mean Functions Deleted": "functions_deleted_mean", "Mean Normalized GumTree Edit-Action Magnitude": "edit_magnitude_mean",
}
UNSUPPORTED, BACKED = "unsupported_for_lineage_population_empty_baseline", "baseline_backed_experiment"
PARENT, CURRENT = "parent_lineage_experiment", "current_experiment"


def _columns(summary: DataFrame, names: dict[str, str], hidden: bool = False) -> list:
    return [(F.col(c) if c in summary.columns and not hidden else F.lit(None).cast("double")).alias(shown) for shown, c in names.items()]


def metrics_row(summary: DataFrame, survivors: bool = False) -> DataFrame:
    """The thirty-one columns of results, for each row of the summary."""
    scope = F.lit(PARENT if survivors else CURRENT).alias("Reliability Scope")
    return summary.select(*_columns(summary, LABELS), scope, *_columns(summary, {"Population N": "population_n"}), *_columns(summary, LINEAGES, True), *_columns(summary, RELIABILITY, survivors), *_columns(summary, STRUCTURE))


def descriptive_row(summary: DataFrame, survivors: bool = False) -> DataFrame:
    """The thirty-one columns of description, the last of which says whether there was a baseline to compare with."""
    scope = F.lit(UNSUPPORTED if survivors else BACKED).alias("Maintenance Change Scope")
    return summary.select(*_columns(summary, LABELS), *_columns(summary, DESCRIPTION), *_columns(summary, MAINTENANCE, survivors), scope)


def parent_row(final: DataFrame, reliability: DataFrame, by: list[str] = ()) -> DataFrame:
    """The metrics rows of final survivors with the reliability of the lineages that were started: by, lineages_started,
    lineages_completed, lineage_completion_rate. Attempts are lineages here, and a rate that only single runs have is null."""
    rows = final.join(reliability, list(by)) if by else final.crossJoin(reliability)  # one row
    started, completed, share = (F.col(c) for c in LINEAGES.values())
    passes = {f"Pass@{k}": F.when(started >= k, pass_at_k(started, completed, k)) for k in (1, 5, 10)}
    known = {"Reliability Scope": F.lit(PARENT), **dict(zip(LINEAGES, (started, completed, share), strict=True)), "N Attempts": started, "Successful Runs": completed, "End-to-End Success Rate": share, **passes}
    blank = {c: F.lit(None).cast("double") for c in RELIABILITY if c not in known}
    return rows.withColumns(known | blank).select(*final.columns)
