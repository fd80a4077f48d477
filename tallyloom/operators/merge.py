"""Merging files of lines that are sorted already, without sorting them again.

A zone map has the first line of every few megabytes of every file. A sample of these gives boundaries that all files share; each range of lines between two of them is a task, which reads the
blocks of every file that reach into it and merges them as streams. So only the zone map is shuffled, and a task holds a line of each file. A file that isn't sorted is an error, as every block is
read to its end by some task, which sees its lines in order.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import total_ordering

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.plans.shared import written
from tallyloom.sources.files import read_lines

BLOCK = 8 << 20
SAMPLE = 10_000  # first lines that boundaries are chosen from; only the balance depends on it
BATCH = 1 << 14


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """input (from 0) and path of the files named in a file of names that end with NUL; an empty name is an error."""
    rows = read_lines(spark, path, "\0").select(F.col("line_no").alias("input"), F.decode(F.encode("line", "ISO-8859-1"), "UTF-8").alias("path"))
    return rows.withColumn("path", F.when(F.col("path") != "", F.col("path")).otherwise(F.raise_error(F.concat(F.lit("empty file name at "), F.col("input").cast("string"))).cast("string")))


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path)


@total_ordering
class Falling:
    """A line that comes before smaller ones."""

    __slots__ = ("line",)

    def __init__(self, line: bytes):
        self.line = line

    def __eq__(self, other: Falling) -> bool:
        return self.line == other.line

    def __lt__(self, other: Falling) -> bool:
        return self.line > other.line

    def __hash__(self) -> int:
        return hash(self.line)


def _order(reverse: bool) -> Callable[[bytes], bytes | Falling]:
    """The key by which lines rise."""
    return Falling if reverse else (lambda line: line)


def _lines(path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin from start (where one begins) up to end; a last line may lack its newline."""
    system, at = _open(path)
    with system.open_input_file(at) as f:
        f.seek(start)
        rest, place = b"", start
        while place < end:
            data = f.read(min(1 << 20, end - place))
            if not data:
                break
            place += len(data)
            *whole, rest = (rest + data).split(b"\n")
            yield from whole
        if rest:
            yield rest


def zone_map(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """input, path, start, end, first (the first line) of the blocks of files (input, path); a block begins where a line begins."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [s.get_file_info(at).size for s, at in map(_open, b["path"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["input"], b["path"], pa.array(found, pa.int64())], ["input", "path", "size"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, at, size in zip(b["path"].to_pylist(), b["at"].to_pylist(), b["size"].to_pylist(), strict=True):
                system, name = _open(path)
                with system.open_input_file(name) as f:
                    place = at
                    if at:  # the line that holds the byte before belongs to the block before
                        f.seek(at - 1)
                        place = at - 1
                        while True:
                            data = f.read(1 << 16)
                            i = data.find(b"\n")
                            if i >= 0 or not data:
                                place = place + i + 1 if data else size
                                break
                            place += len(data)
                out.append((place, next(_lines(path, place, size), None) if place < size else None))
            yield pa.RecordBatch.from_arrays([b["input"], b["path"], b["size"], pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["input", "path", "size", "start", "first"])

    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = files.select(F.col("input").cast("int").alias("input"), "path").mapInArrow(sizes, "input int, path string, size long").filter("size > 0")
    blocks = known.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long")))).repartition(n)
    found = blocks.mapInArrow(first, "input int, path string, size long, start long, first binary").filter("first is not null").dropDuplicates(["input", "start"])
    own = Window.partitionBy("input").orderBy("start")
    return found.select("input", "path", "start", F.coalesce(F.lead("start").over(own), "size").alias("end"), "first", F.lead("first").over(own).alias("next"))


def merge_sorted(files: DataFrame, reverse: bool = False, unique: bool = False, ranges: int | None = None, block: int = BLOCK) -> DataFrame:
    """place (from 1) and line (bytes) of all lines of files (input, path) in byte order; of equal lines the earlier input first, or only the first one. Each file must be in that order."""
    spark = files.sparkSession
    key = _order(reverse)
    zones = written(zone_map(files, block), "zones")
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = sorted({key(bytes(r["first"])) for r in zones.orderBy(F.xxhash64("first"), "first").limit(SAMPLE).collect()})
    bounds = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [bisect_right(bounds, key(x)) for x in b["first"].to_pylist()]
            high = [bisect_right(bounds, key(x)) if x is not None else len(bounds) for x in b["next"].to_pylist()]
            if any(x > y for x, y in zip(low, high, strict=True)):
                raise ValueError(f"not sorted: {b['path'][next(i for i, (x, y) in enumerate(zip(low, high, strict=True)) if x > y)].as_py()}")
            lists = [list(range(x, y + 1)) for x, y in zip(low, high, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), b["input"], b["path"], b["start"], b["end"]], ["ranges", "input", "path", "start", "end"])

    def stream(blocks: list[tuple[str, int, int]], low, high) -> Iterator[tuple]:
        """The lines of one file from low up to high, with their keys. Its blocks follow each other."""
        last = None
        for line in _lines(blocks[0][0], blocks[0][1], blocks[-1][2]):
            k = key(line)
            if last is not None and k < last:
                raise ValueError(f"not sorted: {blocks[0][0]}")
            last = k
            if high is not None and k >= high:
                break
            if low is None or k >= low:
                yield k, line

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(r: int, files: dict[int, list]) -> Iterator[pa.RecordBatch]:
            low, high = bounds[r - 1] if r else None, bounds[r] if r < len(bounds) else None
            lines, at, last = [], 0, None
            for k, line in heapq.merge(*(stream(files[i], low, high) for i in sorted(files)), key=lambda x: x[0]):
                if unique and k == last:
                    continue
                last = k
                lines.append(line)
                if len(lines) == BATCH:
                    yield _batch(r, at, lines)
                    at, lines = at + BATCH, []
            if lines:
                yield _batch(r, at, lines)

        now, held = None, {}
        for b in batches:
            for r, i, path, start, end in zip(*(b[c].to_pylist() for c in ("range", "input", "path", "start", "end")), strict=True):
                if r != now and held:
                    yield from merged(now, held)
                    held = {}
                now = r
                held.setdefault(i, []).append((path, start, end))
        if held:
            yield from merged(now, held)

    def _batch(r: int, at: int, lines: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"range": pa.array([r] * len(lines), pa.int32()), "at": pa.array(range(at, at + len(lines)), pa.int64()), "line": pa.array(lines, pa.binary())})

    segments = zones.mapInArrow(reach, "ranges array<int>, input int, path string, start long, end long").withColumn("range", F.explode("ranges")).drop("ranges")
    dealt = segments.repartition(len(bounds) + 1, "range").sortWithinPartitions("range", "input", "start")
    rows = written(dealt.mapInArrow(merge, "range int, at long, line binary"), "merged")
    offsets, total = [], 0
    for r, size in sorted(rows.groupBy("range").agg(F.count("*")).collect()):  # a row for each range
        offsets.append((r, total))
        total += size
    first = spark.createDataFrame(offsets, "range int, _first long")
    return rows.join(F.broadcast(first), "range").select((F.col("_first") + F.col("at") + 1).alias("place"), "line")
