"""File metadata as a DataSource, and what run directories hold by it. Content is read only where it is asked for.

Conditions on names and paths are options of the source: folders directly below the root are the partitions, and those that no path can be in aren't listed. (They aren't left to
filter pushdown: Spark keeps the filters that it pushed to a loaded Python source with the source, so two branches of one DataFrame would get each other's.)
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MANIFEST = "MANIFEST.json"
_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root.replace("file:/", "file:///") if root.startswith("file:/") and not root.startswith("file://") else root)


class Folder(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.folder = name


class ListingSource(DataSource):
    """format("tallyloom_listing"), options path, names (with line feeds between them), ends (of names) and below (the start of paths)."""

    @classmethod
    def name(cls) -> str:
        return "tallyloom_listing"

    def schema(self) -> str:
        return "path string, folder string, name string, size long, modified timestamp"

    def reader(self, schema) -> ListingReader:
        names = self.options.get("names")
        return ListingReader(self.options["path"], names.split("\n") if names is not None else None, self.options.get("ends", ""), self.options.get("below", ""))


class ListingReader(DataSourceReader):
    def __init__(self, root: str, names: list[str] | None = None, ends: str = "", below: str = ""):
        self.root, self.names, self.ends, self.below = root, names, ends, below

    def _kept(self, path: str) -> bool:
        name = posixpath.basename(path)
        return path.startswith(self.below) and name.endswith(self.ends) and (self.names is None or name in self.names)

    def partitions(self) -> list[Folder]:
        system, at = opened(self.root)
        below = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if i.type == fs.FileType.Directory)
        first, inside, _ = self.below.partition("/")
        reachable = [n for n in below if (n == first if inside else n.startswith(first))]
        return [Folder(""), *map(Folder, reachable)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        system, at = opened(self.root)
        at = at.rstrip("/")
        where = fs.FileSelector(f"{at}/{partition.folder}" if partition.folder else at, allow_not_found=True, recursive=bool(partition.folder))
        for i in system.get_file_info(where):
            path = i.path[len(at) + 1 :]
            if i.type == fs.FileType.File and self._kept(path):
                yield path, posixpath.dirname(path), posixpath.basename(path), i.size, i.mtime


def listing(spark: SparkSession, root: str, names: list[str] | None = None, ends: str = "", below: str = "") -> DataFrame:
    """path (below root), folder, name, size, modified of every file, or of those with these names, this end of the name and this start of the path."""
    spark.dataSource.register(ListingSource)
    reader = spark.read.format("tallyloom_listing").option("path", root).option("ends", ends).option("below", below)
    return (reader if names is None else reader.option("names", "\n".join(names))).load()


def contents(files: DataFrame, root: str) -> DataFrame:
    """files (path, ...) with their content (bytes)."""
    schema = files.schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = opened(root)
        for b in batches:
            for i, path in enumerate(b["path"].to_pylist()):  # one file at a time is held
                with system.open_input_file(f"{at.rstrip('/')}/{path}") as f:
                    yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, pa.array([f.readall()], pa.binary())], [*b.schema.names, "content"])

    return files.mapInArrow(read, StructType([*schema.fields]).add("content", "binary"))


def write_files(rows: DataFrame, root: str) -> int:
    """Write content (text) to each path below root, each by a name of its own that is renamed in the end, so readers see whole files; gives their number."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = opened(root)
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                whole = f"{at.rstrip('/')}/{path}"
                system.create_dir(posixpath.dirname(whole), recursive=True)
                new = f"{posixpath.dirname(whole)}/.new-{uuid.uuid4().hex}"
                with system.open_output_stream(new) as f:
                    f.write(content.encode())
                system.move(new, whole)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return rows.select("path", "content").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def sandbox_attempts(files: DataFrame) -> DataFrame:
    """folder, ord of the attempts below a root: the root itself if it has metadata.json, else its rep-* folders that have one, else those of temp-* and temp-*/rep-*."""
    p = F.col("path")
    layout = F.when(p == "metadata.json", 0).when(p.rlike("^rep-[^/]*/metadata\\.json$"), 1).when(p.rlike("^temp-[^/]*/metadata\\.json$"), 2).when(p.rlike("^temp-[^/]*/rep-[^/]*/metadata\\.json$"), 3)
    found = files.filter(F.col("name") == "metadata.json").select("folder", layout.alias("ord")).filter("ord is not null")
    first = found.agg(F.min(F.least("ord", F.lit(2))).alias("_first"))
    return found.crossJoin(first).filter(F.least("ord", F.lit(2)) == F.col("_first")).select("folder", "ord")  # one row


def suite_files(files: DataFrame) -> DataFrame:
    """folder, suite, path of the suites in every folder: .json and .json.gz files but the manifest; of both, the packed one."""
    suite = F.regexp_extract("name", r"^(.*)\.json(\.gz)?$", 1)
    found = files.filter((F.col("name") != MANIFEST) & F.col("name").rlike(r"\.json(\.gz)?$"))
    return found.groupBy("folder", suite.alias("suite")).agg(F.max("path").alias("path"))


def change_metrics(spark: SparkSession, root: str, attempts: DataFrame) -> DataFrame:
    """folder, lines_added, lines_deleted, lines_edited, files_edited, tracked_files_edited, untracked_files_created, changed_paths of each attempt (folder).

    Lines of diff-numstat.txt (added, deleted, path; what is no number counts as nothing), and of files named in untracked-files.txt all lines, where the candidate's file is there and holds no NUL.
    """
    def lines(name: str) -> DataFrame:
        texts = contents(listing(spark, root, [name]).select("path", "folder"), root)
        return texts.join(attempts.select("folder"), "folder", "left_semi").select("folder", F.explode(F.split(F.decode("content", "UTF-8"), _BREAKS)).alias("line"))

    parts = F.split("line", "\t")
    tracked = lines("diff-numstat.txt").filter(F.size(parts) >= 3).select("folder", F.get(parts, F.lit(0)).alias("a"), F.get(parts, F.lit(1)).alias("d"), F.element_at(parts, -1).alias("file"))
    number = lambda c: F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).cast("long")).otherwise(0)
    tracked = tracked.select("folder", "file", number("a").alias("added"), number("d").alias("deleted"), F.lit(True).alias("tracked"))
    named = lines("untracked-files.txt").select("folder", F.trim("line").alias("file")).filter("file <> ''")
    wanted = named.select("folder", "file", F.when(F.col("folder") == "", F.concat(F.lit("candidate/"), "file")).otherwise(F.concat("folder", F.lit("/candidate/"), "file")).alias("path"))
    text = F.decode("content", "ISO-8859-1")
    even = F.regexp_replace(text, "\r\n|\r", "\n")
    count = F.when(F.contains(text, F.lit("\0")) | (text == ""), 0).otherwise(F.size(F.split(even, "\n")) - F.when(F.endswith(even, F.lit("\n")), 1).otherwise(0))
    there = contents(wanted.select("path").distinct().join(listing(spark, root).select("path"), "path", "left_semi"), root).select("path", count.cast("long").alias("n"))
    untracked = wanted.join(there, "path", "left").select("folder", "file", F.coalesce("n", F.lit(0).cast("long")).alias("added"), F.lit(0).cast("long").alias("deleted"), F.lit(False).alias("tracked"))
    out = tracked.unionByName(untracked).groupBy("folder").agg(
        F.sum("added").alias("lines_added"), F.sum("deleted").alias("lines_deleted"), F.array_sort(F.collect_set("file")).alias("changed_paths"),
        F.count_distinct(F.when(F.col("tracked"), F.col("file"))).alias("tracked_files_edited"), F.count_distinct(F.when(~F.col("tracked"), F.col("file"))).alias("untracked_files_created"),
    )
    out = attempts.select("folder").join(out, "folder", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("lines_added", "lines_deleted", "tracked_files_edited", "untracked_files_created")})
    paths = F.coalesce("changed_paths", F.array().cast("array<string>"))
    return out.select("folder", "lines_added", "lines_deleted", (F.col("lines_added") + F.col("lines_deleted")).alias("lines_edited"), F.size(paths).alias("files_edited"), "tracked_files_edited", "untracked_files_created", paths.alias("changed_paths"))
