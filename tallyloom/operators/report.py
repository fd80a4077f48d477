"""Assembling report rows and aggregates over experiments; configuration and its fingerprint; plain sinks."""

from __future__ import annotations

import gzip
import hashlib
import json
import math
import os
import tempfile
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIGNATURE_EXEMPT = ("n_lineages", "output_dir", "config_fingerprint")
RELIABILITY_COLUMNS = ("n_attempts", "successes", "end_to_end_rate", "conditional_rate", "attrition_rate")


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def config_fingerprint(config: dict) -> str:
    """SHA-256 of a configuration as canonical JSON, without its own digest, lineage number and output folder."""
    return hashlib.sha256(canonical_json({k: v for k, v in config.items() if k not in SIGNATURE_EXEMPT}).encode()).hexdigest()


def resolve_settings(given: dict, recorded: dict, defaults: dict) -> dict[str, tuple[Any, str]]:
    """value and source of each setting: given, recorded or default, the first that isn't None."""
    out = {}
    for k, v in defaults.items():
        for source, values in (("argument", given), ("metadata", recorded)):
            if values.get(k) is not None:
                out[k] = (values[k], source)
                break
        else:
            out[k] = (v, "default")
    if out.get("strategy_threshold", (None,))[0] is None and "cluster_threshold" in out:
        out["strategy_threshold"] = (out["cluster_threshold"][0], "inherited")
    return out


def mismatches(expected: dict, actual: dict) -> list[str]:
    """The fields in which a configuration isn't the confirmatory one."""
    return sorted(k for k in expected if expected[k] != actual.get(k))


def require_settings(config: dict, needed: list[str]) -> dict:
    missing = [k for k in needed if config.get(k) is None]
    if missing:
        raise ValueError(f"missing settings: {missing}")
    return config


def paper_row(*parts: DataFrame, survivors: bool = False) -> DataFrame:
    """One wide row of one-row tables; for survivors all reliability columns are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    if survivors:
        out = out.withColumns({c: F.lit(None).cast("double") for c in RELIABILITY_COLUMNS if c in out.columns})
    return out


def paper_aggregate(rows: DataFrame, schema_version: int, first_by: str = "experiment") -> DataFrame:
    """Rows of all experiments: current schema, confirmatory, the signature of the first accepted; one row an experiment and
    population, ordered by issue, checkpoint, model and temperature (numbers first)."""
    usable = rows.filter((F.col("schema_version") == schema_version) & F.col("confirmatory"))
    first = usable.agg(F.min_by("signature", first_by).alias("_s"))  # one row
    usable = usable.join(F.broadcast(first), F.col("signature") == F.col("_s")).drop("_s")
    nth = F.row_number().over(Window.partitionBy("experiment", "population").orderBy(F.desc("written_at"), "path"))
    return usable.withColumn("_n", nth).filter("_n = 1").drop("_n").orderBy("issue", "checkpoint", "model", *mixed_order("temperature"))


def flat_columns(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as dotted columns, arrays as text joined by semicolons."""
    from pyspark.sql.types import ArrayType, StructType

    def leaves(schema, path: list[str]):
        for f in schema:
            at = [*path, f.name]
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, at)
            else:
                column = F.col(".".join(f"`{p}`" for p in at))
                if isinstance(f.dataType, ArrayType):
                    simple = not isinstance(f.dataType.elementType, ArrayType | StructType)
                    column = F.array_join(F.transform(column, lambda x: x.cast("string")), ";") if simple else F.to_json(column)
                yield column.alias(separator.join(at))

    return df.select(*leaves(df.schema, []))


def json_safe(value: Any) -> Any:
    """Numbers that JSON hasn't, as None."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [json_safe(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def replace_file(path: str, text: str) -> None:
    """Write a file so that readers see the old or the new content, never a part."""
    fd, other = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".new-")
    try:
        with os.fdopen(fd, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(other, path)
    except BaseException:
        os.unlink(other)
        raise


def write_json_document(path: str, value: Any) -> None:
    replace_file(path, json.dumps(json_safe(value), indent=2, sort_keys=True) + "\n")


def write_csv_table(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header, blank nulls, the given columns only (or all, in text order)."""
    df.select(*(columns or sorted(df.columns))).write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_lines(lines: DataFrame, path: str, *order) -> None:
    """Each line and a newline, in order, as text files whose names sort in the same order."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.option("lineSep", "\n").text(path)


def fixed_gzip(data: bytes) -> bytes:
    """Gzip that depends on the data only; digests are taken of the data itself."""
    return gzip.compress(data, mtime=0)


def bundle_digest(members: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One digest over the sorted digests of all members."""
    each = members.select(F.concat_ws("\x1f", path, F.sha2(F.col(content).cast("binary"), 256)).alias("m"))
    return each.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("m")), "\n"), 256).alias("bundle_sha256"), F.count("*").alias("members"))


def markdown_report(title: str, started: int, rows: list[dict]) -> str:
    """A table with the numbers of lineages started and of those that count in each row."""
    if not rows:
        return f"# {title}\n\nStarted N = {started}. No population.\n"
    names = list(rows[0])
    body = [" | ".join("" if r[n] is None else str(r[n]) for n in names) for r in rows]
    return "\n".join([f"# {title}", "", f"Started N = {started}. Each row states its own n.", "", " | ".join(names), " | ".join("-" for _ in names), *body, ""])


def stage_record(*fields: str):
    """Fields in one record with unit separators; empty ones stay."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])


def mixed_order(column: str) -> list:
    """What to order a text column by so that numbers come first, by value, then texts; nulls last."""
    number = F.col(column).cast("string").try_cast("double")
    return [F.when(F.col(column).isNull(), 2).when(number.isNull(), 1).otherwise(0).asc(), number.asc(), F.col(column).asc()]
