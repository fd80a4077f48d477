"""Reading files: lines as bytes, suites, run directories, sources, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import bytes_to_text, records
from tallyloom.operators.contracts import flat_names

# Names of a case's fields
CASE = (
    "schema int, name string, check string, args array<string>, flags array<string>, absent_flags array<string>, tags array<string>, stdin_modes array<string>, allow_signals array<string>, "
    "stdin_b64 string, stdout_b64 string, stderr_b64 string, stderr_class string, files_b64 map<string,string>, exit_code int, timeout int, env map<string,string>"
)


def read_lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """path, line_no, line of files, each line a string of code points 0-255, one a byte; \\r and broken UTF-8 stay as they are.

    A file is read whole in one task. For text beyond that use read_text_lines.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.posexplode(records(bytes_to_text("content"), separator)).alias("line_no", "line"))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of large UTF-8 files, split over tasks; \\r stays."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of one document each; what doesn't parse comes as a null row with its path."""
    return spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("_path", F.col("_metadata.file_path"))


def read_suites(spark: SparkSession, path: str) -> DataFrame:
    """Cases of suite files (an object with cases, or a bare list; plain or gzip) with _suite and _ordinal; manifests don't count."""
    whole = spark.read.text(path, wholetext=True).withColumn("_file", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)).filter("_file <> 'MANIFEST.json'")
    listed = F.from_json(F.when(F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("["), F.concat(F.lit('{"cases":'), F.col("value"), F.lit("}"))).otherwise(F.col("value")), "struct<cases:array<" + _struct(CASE) + ">>")
    suite = F.regexp_replace("_file", r"\.json(\.gz)?$", "")
    return whole.select(suite.alias("_suite"), F.posexplode(listed["cases"]).alias("_ordinal", "_case")).select("_suite", "_ordinal", "_case.*")


def _struct(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()


def read_attempts(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """metadata.json of every attempt-* folder below root (either layout), with the attempt's name."""
    found = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").json(root)
    return found.withColumn("attempt", F.regexp_extract(F.col("_metadata.file_path"), r"/(attempt-[^/]+)/", 1)).filter("attempt <> ''")


def read_lineages(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One row for each lineage-* folder; a missing or broken record stays as controller_interrupted. An error for mixed fingerprints."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    folders = files.select(F.regexp_extract("path", r"/(lineage-[^/]+)/", 1).alias("lineage")).filter("lineage <> ''").distinct()
    text = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="lineage.json").select(F.regexp_extract(F.col("_metadata.file_path"), r"/(lineage-[^/]+)/lineage\.json$", 1).alias("lineage"), F.from_json("value", schema).alias("record"))
    rows = folders.join(text, "lineage", "left")
    rows = rows.withColumn("state", F.when(F.col("record.status").isNull(), "controller_interrupted").otherwise(F.col("record.status")))
    if "config_fingerprint" in schema:
        seen = rows.agg(F.count_distinct("record.config_fingerprint")).first()[0]
        if seen > 1:
            raise ValueError(f"{seen} different configuration fingerprints in one run")
    return rows


def read_sources(spark: SparkSession, root: str, glob: str = "*.c", excluded: list[str] = ()) -> DataFrame:
    """path, content, sha256 and flat_name (as `contracts.flat_names` has it) of source files below root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "content")
    for name in excluded:
        raw = raw.filter(~F.contains("path", F.lit(f"/{name}/")))
    return flat_names(raw).select("path", "content", F.sha2("content", 256).alias("sha256"), "flat_name")


def read_findings(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    from tallyloom.operators.security import parse_findings

    csv = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return parse_findings(csv.withColumn("run_id", F.lit(run_id)))


def read_metrics(spark: SparkSession, path: str, flags: list[str]) -> DataFrame:
    """A CSV of text columns, with the given ones as booleans: only the text True is true."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumns({f: F.coalesce(F.col(f) == "True", F.lit(False)) for f in flags})


def read_numstat(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("added string, deleted string, path string").option("sep", "\t").csv(path)


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The content of the file changed last."""
    files = spark.read.format("binaryFile").load(path)
    return files.agg(F.max_by(F.struct("path", "content"), F.struct("modificationTime", "path")).alias("f")).select("f.*")


def check_manifest(manifest: dict) -> dict:
    """A utility's manifest with its ordered checkpoints, or an error that says what is wrong."""
    if not isinstance(manifest.get("utility"), str):
        raise ValueError("utility must be a string")
    names = [c.get("id") for c in manifest.get("checkpoints", [])]
    if not names or None in names or len(set(names)) < len(names):
        raise ValueError("checkpoints must have different ids")
    for c in manifest["checkpoints"]:
        if not isinstance(c.get("flags", []), list):
            raise ValueError(f"{c['id']}: flags must be a list")
    return manifest
