"""Static findings: parsing, rollups by run and population, transitions. A run that wasn't measured has nulls, not zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.stats import rate, six_numbers
from tallyloom.functions.text import code_only, cwe_ids

# Required columns of the scanner's CSV, and call classes
REQUIRED = ["File", "Line", "Column", "DefaultLevel", "Level", "Category", "Name", "Warning", "Suggestion", "CWEs", "Fingerprint", "ToolVersion"]
UNSAFE_CALLS = ["strcpy", "strcat", "sprintf", "gets", "vsprintf"]
BOUNDED_CALLS = ["strncpy", "strncat", "snprintf", "memcpy", "memmove", "stpcpy"]
HEAP_CALLS = ["malloc", "calloc", "realloc", "free", "strdup", "reallocarray"]


def parse_findings(csv: DataFrame) -> DataFrame:
    """Typed findings of a scanner's CSV (all strings, with run_id); an error for missing columns or numbers that are none."""
    missing = [c for c in REQUIRED if c not in csv.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    number = lambda c: F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).cast("int")).otherwise(F.raise_error(F.concat(F.lit(f"{c} is no number: "), F.coalesce(F.col(c), F.lit("null")))).cast("int"))
    return csv.select(
        "run_id", F.col("File").alias("file"), number("Line").alias("line"), number("Column").alias("column"), number("DefaultLevel").alias("default_level"), number("Level").alias("level"),
        F.col("Category").alias("category"), F.col("Name").alias("name"), F.col("Warning").alias("warning"), F.col("Suggestion").alias("suggestion"), cwe_ids("CWEs").alias("cwe_ids"),
        F.col("Fingerprint").alias("fingerprint"), F.col("ToolVersion").alias("tool_version"),
    )


def run_rollup(findings: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """For each run (by, run, measured, loc): findings, per thousand lines, highest level, distinct CWEs in text order."""
    each = findings.groupBy(*by, "run").agg(F.count("*").alias("_n"), F.max("level").alias("max_level"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("cwe_ids")))).alias("_cwes"))
    out = runs.join(each, [*by, "run"], "left")
    known = F.col("measured")
    out = out.withColumn("n_findings", F.when(known, F.coalesce("_n", F.lit(0)))).withColumn("cwe_ids", F.when(known, F.coalesce("_cwes", F.array().cast("array<string>"))))
    per = F.when(F.col("loc") > 0, 1000 * F.col("n_findings") / F.col("loc"))
    return out.withColumn("max_level", F.when(known, F.col("max_level"))).withColumn("per_kloc", per).drop("_n", "_cwes")


def population_rollup(profiles: DataFrame, by: list[str]) -> DataFrame:
    """Coverage, and prevalence only where every run was measured; numbers of findings per run over measured ones."""
    hit = F.count_if(F.col("measured") & (F.col("n_findings") > 0))
    out = profiles.groupBy(*by).agg(F.count("*").alias("runs"), F.count_if("measured").alias("measured_runs"), hit.alias("_hit"), *six_numbers("n_findings", "findings_"))
    return out.withColumns({"coverage": rate("measured_runs", "runs"), "prevalence": F.when(F.col("measured_runs") == F.col("runs"), rate("_hit", "runs"))}).drop("_hit")


def level_distribution(findings: DataFrame, by: list[str]) -> DataFrame:
    """level, n findings, n runs."""
    return findings.groupBy(*by, "level").agg(F.count("*").alias("n"), F.count_distinct("run").alias("runs"))


def max_level_distribution(profiles: DataFrame, by: list[str]) -> DataFrame:
    """ord, max_level (`none` first), n over measured runs."""
    level = F.coalesce(F.col("max_level").cast("string"), F.lit("none"))
    return profiles.filter("measured").groupBy(*by, level.alias("level")).agg(F.count("*").alias("n")).withColumn("ord", F.coalesce(F.try_to_number("level", F.lit("99")).cast("int"), F.lit(-1)))


def cwe_distribution(findings: DataFrame, by: list[str]) -> DataFrame:
    """cwe, n findings, n runs."""
    return findings.select(*by, "run", F.explode("cwe_ids").alias("cwe")).groupBy(*by, "cwe").agg(F.count("*").alias("n"), F.count_distinct("run").alias("runs"))


def construct_profile(runs: DataFrame, source: str) -> DataFrame:
    """Counts of unsafe, bounded and heap calls in the source of each run, comments and literals left out."""
    calls = F.regexp_extract_all(code_only(source), F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))
    count = lambda names: F.size(F.filter(calls, lambda c: c.isin(names)))
    return runs.withColumns({"unsafe_calls": count(UNSAFE_CALLS), "bounded_calls": count(BOUNDED_CALLS), "heap_calls": count(HEAP_CALLS)})


def transitions(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Findings before and after each transition (lineage, from_run, to_run); a side without a profile makes it unavailable."""
    out = pairs
    for s in ("from", "to"):
        out = out.join(profiles.select("lineage", F.col("run").alias(f"{s}_run"), F.col("measured").alias(f"_{s}"), F.col("n_findings").alias(f"{s}_findings"), F.col("cwe_ids").alias(f"{s}_cwes")), ["lineage", f"{s}_run"], "left")
    both = F.coalesce("_from", F.lit(False)) & F.coalesce("_to", F.lit(False))
    reason = F.when(~F.coalesce("_from", F.lit(False)), "no measurement before").when(~F.coalesce("_to", F.lit(False)), "no measurement after")
    return out.select(
        "lineage", "from_run", "to_run", F.when(both, "measured").otherwise("unavailable").alias("status"), reason.alias("reason"),
        F.when(both, F.col("to_findings") - F.col("from_findings")).alias("finding_delta"),
        F.when(both, F.array_sort(F.array_except("to_cwes", "from_cwes"))).alias("newly_observed"), F.when(both, F.array_sort(F.array_except("from_cwes", "to_cwes"))).alias("no_longer_observed"),
    )


def paper_row(rollup: DataFrame, by: list[str]) -> DataFrame:
    """The columns of a report row."""
    return rollup.select(*by, "runs", "measured_runs", "coverage", "prevalence", "findings_mean", "findings_median", "findings_sample_sd", "findings_min", "findings_max")


def check_config(config: dict) -> None:
    """Raise unless the scanner's configuration is complete and well typed."""
    need = {"schema_version": int, "tool": str, "tool_version": str, "minimum_level": int, "unsafe_calls": list, "bounded_calls": list}
    for key, kind in need.items():
        value = config.get(key)
        if not isinstance(value, kind) or isinstance(value, bool):
            raise ValueError(f"{key} must be {kind.__name__}")
        if kind is list and (value != sorted(set(value)) or not all(isinstance(v, str) for v in value)):
            raise ValueError(f"{key} must be a sorted list of different names")
    if not 0 <= config["minimum_level"] <= 5:
        raise ValueError("minimum_level must be within 0 and 5")
