"""Experiments as tables: labels, baselines, population views that are written, and scanners that run over sources."""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Metrics that need a baseline, the folder of a measurement, columns of a security report, a scanner's options
BASELINE_METRICS = [
    "lines_added", "lines_deleted", "lines_edited", "files_edited", "tracked_files_edited", "untracked_files_created", "functions_edited_count",
    "functions_created_count", "functions_deleted_count", "gumtree_edit_actions", "gumtree_normalized_edit_distance",
]
MEASUREMENT = "analysis/execution_consistency"
SCANNER_OPTIONS = ["--csv", "--dataonly", "--quiet"]


def _stated(column: str | None) -> Column:
    return F.nullif(F.trim(F.col(column)), F.lit("")) if column else F.lit(None).cast("string")


def _stem(path: str) -> Column:
    """A path's last name without its extension; a leading dot is no extension."""
    name = F.element_at(F.split(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+$", ""), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def issue_label(explicit: str | None = None, issue: str = "issue", utility: str = "utility", source_path: str = "source_path") -> Column:
    """The first of the explicit label, the issue, the utility, and the source's name without new_ that isn't blank."""
    return F.coalesce(_stated(explicit), _stated(issue), _stated(utility), F.nullif(F.regexp_replace(_stem(source_path), "^new_", ""), F.lit("")))


def checkpoint_label(explicit: str | None = None, checkpoint: str = "checkpoint", issue_id: str = "issue_id", prompt: str = "prompt") -> Column:
    return F.coalesce(_stated(explicit), _stated(checkpoint), _stated(issue_id), F.nullif(_stem(prompt), F.lit("")))


def baselines(experiments: DataFrame, override: str | None = None, files: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """experiments (repository, seed_files, source_path) with baseline and origin: an override, the seed recorded for the source, or empty.

    seed_files: source:destination items with commas between; an item without a destination is its own. A relative seed lies in the repository. Of several seeds for the source the first counts;
    with files (path) the first one that is a file, and none where no file is there. by: the columns that tell experiments apart then.
    """
    if override is not None:
        return experiments.withColumns({"baseline": F.lit(override), "origin": F.lit("cli_override")})
    items = F.filter(F.split(F.coalesce("seed_files", F.lit("")), ","), lambda s: s != "")
    matching = F.filter(items, lambda s: F.regexp_replace(s, "^[^:]*:", "") == F.col("source_path"))
    root = F.regexp_replace(F.coalesce("repository", F.lit(".")), "/+$", "")
    seeds = F.transform(F.transform(matching, lambda s: F.substring_index(s, ":", 1)), lambda s: F.when(F.startswith(s, F.lit("/")), s).otherwise(F.concat_ws("/", root, s)))
    if files is None:
        rows = experiments.withColumn("baseline", F.get(seeds, F.lit(0)))
    else:
        found = experiments.select(*by, F.posexplode(seeds).alias("_nth", "path")).join(files.select("path").distinct(), "path", "left_semi")
        rows = experiments.join(found.groupBy(*by).agg(F.min_by("path", "_nth").alias("baseline")), by, "left")
    return rows.withColumn("origin", F.when(F.col("baseline").isNotNull(), "recorded_seed").otherwise("empty_from_scratch"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def guard_measurement(spark: SparkSession, view: str, label: str, allow_loss: bool = False) -> None:
    """An error if writing the view anew would delete a measurement that lies in it."""
    if not allow_loss and _exists(spark, f"{view}/{MEASUREMENT}"):
        raise FileExistsError(f"{view} holds a measurement of the {label} population, which writing it anew would delete; move it away or allow the loss")


def write_view(spark: SparkSession, runs: DataFrame, label: str, view: str, checkpoint: str | None = None, allow_loss: bool = False) -> DataFrame:
    """A population as an experiment: runs, and one row of what it is, as Parquet. Its baseline is empty, so what needs one is null and named as unsupported."""
    guard_measurement(spark, view, label, allow_loss)
    unsupported = [c for c in BASELINE_METRICS if c in runs.columns]
    out = runs.withColumns({c: F.lit(None).cast(runs.schema[c].dataType) for c in unsupported}).withColumn("population", F.lit(label))
    out.write.mode("overwrite").parquet(f"{view}/runs")
    back = spark.read.schema(out.schema).parquet(f"{view}/runs")
    about = back.agg(F.count("*").alias("n")).select(F.lit(label).alias("population"), F.lit(checkpoint).cast("string").alias("checkpoint"), "n", F.lit("empty").alias("baseline"), F.array(*map(F.lit, BASELINE_METRICS)).alias("unsupported_metrics"))
    about.coalesce(1).write.mode("overwrite").json(f"{view}/metadata")  # one row
    return back


def scanner_provenance(executable: str | None, expected_version: str, minimum_level: int = 1) -> dict:
    """Whether a scanner can be used: found, runs, and of the expected version. What isn't available says why."""
    path = executable if executable and os.path.isfile(executable) else shutil.which("flawfinder") if executable is None else None
    out = {"status": "unavailable", "reason": None, "path": path, "version": None, "expected_version": expected_version, "options": [*SCANNER_OPTIONS, f"--minlevel={minimum_level}"]}
    if path is None:
        return out | {"reason": "flawfinder_not_found"}
    try:
        told = subprocess.run([path, "--version"], capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired) as e:
        return out | {"reason": str(e)}
    if told.returncode:
        return out | {"reason": told.stderr.strip() or f"exit_status_{told.returncode}"}
    version = next((w for w in (told.stdout or told.stderr).split() if all(p.isdigit() for p in w.split("."))), None)
    if version is None:
        return out | {"reason": "unrecognized_version"}
    out["version"] = version
    return out | ({"status": "available"} if version == expected_version else {"reason": "version_mismatch"})


SCAN = "status string, reason string, findings string"


def _scan(text: str, provenance: dict, seconds: int, required: list[str]) -> tuple[str, str | None, str | None]:
    with tempfile.TemporaryDirectory() as folder:  # scratch of this one call; nothing else reads it
        with open(os.path.join(folder, "candidate.c"), "w") as f:
            f.write(text)
        try:
            done = subprocess.run([provenance["path"], *provenance["options"], "candidate.c"], cwd=folder, capture_output=True, text=True, timeout=seconds)
        except subprocess.TimeoutExpired:
            return "unavailable", "flawfinder_timeout", None
        except OSError as e:
            return "unavailable", f"flawfinder_execution_failed: {e}", None
    if done.returncode:
        return "unavailable", done.stderr.strip() or f"flawfinder_exit_status_{done.returncode}", None
    rows = list(csv.DictReader(io.StringIO(done.stdout)))
    missing = sorted(set(required) - set(rows[0] if rows else required))
    if missing:
        return "unavailable", f"malformed_flawfinder_csv: {', '.join(missing)}", None
    return "available", None, json.dumps(rows)


def scan_sources(sources: DataFrame, by: list[str], provenance: dict, source: str = "source", seconds: int = 120) -> DataFrame:
    """by, status, reason and findings (JSON) of a scanner run over each source. What couldn't be measured has no findings, not zero."""
    from tallyloom.operators.security import REQUIRED

    kept = sources.select(*by, F.col(source).alias("_source"))
    if provenance["status"] != "available":
        return kept.select(*by, F.lit("unavailable").alias("status"), F.lit(provenance["reason"]).alias("reason"), F.lit(None).cast("string").alias("findings"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [("unavailable", "no_source", None) if t is None else _scan(t, provenance, seconds, REQUIRED) for t in b.column("_source").to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in by), *columns], [*by, "status", "reason", "findings"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*by).schema)
    return kept.mapInArrow(scan, f"{schema}, {SCAN}")


def security_row(summary: DataFrame) -> DataFrame:
    """The nineteen columns of a security report. summary: issue, checkpoint, model, temperature, runs, prevalence, findings_* and per_kloc_*
    (mean, median, sample_sd, min, max), unsafe_prevalence, mean_unsafe_calls, distinct_cwes, scanner_version, coverage."""
    names = {
        "Issue": "issue", "Checkpoint": "checkpoint", "Model": "model", "Temp": "temperature", "Security Population N": "runs", "Static Finding Prevalence": "prevalence",
        "Mean Flawfinder Findings": "findings_mean", "Median Flawfinder Findings": "findings_median", "SD Flawfinder Findings": "findings_sample_sd",
        "Min Flawfinder Findings": "findings_min", "Max Flawfinder Findings": "findings_max", "Mean Flawfinder Findings per KLOC": "per_kloc_mean",
        "Median Flawfinder Findings per KLOC": "per_kloc_median", "SD Flawfinder Findings per KLOC": "per_kloc_sample_sd", "Unsafe API Prevalence": "unsafe_prevalence",
        "Mean Unsafe API Calls": "mean_unsafe_calls", "Distinct CWE Count": "distinct_cwes", "Flawfinder Version": "scanner_version", "Security Measurement Coverage": "coverage",
    }
    return summary.select(*[F.col(c).alias(n) for n, c in names.items()])
