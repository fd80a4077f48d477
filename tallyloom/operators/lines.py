"""Line operators: ordering, uniqueness, order check and fixed-string search over a table of lines.

A line table has the line (binary, or text whose order is that of its bytes) and its place (source, line_no). Nothing depends on
the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import fixed_match, fold_upper, records
from tallyloom.plans.shared import ranked


def explode_lines(df: DataFrame, text: str, separator: str = "\n") -> DataFrame:
    """One row for each record of the text, with line_no (from 0) and line; the other columns stay."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(records(text, separator)).alias("line_no", "line"))


def sort_key(fold: bool) -> list[Column]:
    """Bytes, or capitals first compared and then bytes."""
    return [fold_upper("line"), F.col("line")] if fold else [F.col("line")]


def sorted_lines(lines: DataFrame, fold: bool = False, reverse: bool = False, name: str = "rank") -> DataFrame:
    """The lines with their rank in the order; the whole order turns with reverse."""
    keys = [k.desc() if reverse else k for k in sort_key(fold)]
    return ranked(lines, *keys, name=name)


def unique_lines(lines: DataFrame, fold: bool = False, keep: str = "sorted") -> DataFrame:
    """One line of each group of equal ones.

    keep: `sorted` takes the first in sorted order, whatever direction is shown; `input` the first by line_no.
    """
    key = fold_upper("line") if fold else F.col("line")
    pick = F.min("line") if keep == "sorted" else F.min_by("line", F.struct("line_no", "line"))
    return lines.groupBy(key.alias("_key")).agg(pick.alias("line")).select("line")


def order_check(lines: DataFrame, by: list[str], fold: bool = False, reverse: bool = False, strict: bool = False, last_resort: bool = False) -> DataFrame:
    """For each source: disorder_line, the first line out of order (null: none), and status 0 or 1.

    strict: equal neighbours are out of order too. last_resort: lines that only differ in case compare by bytes.
    """
    order = Window.partitionBy(*by).orderBy("line_no")
    key = F.struct(*sort_key(True)) if fold and last_resort else fold_upper("line") if fold else F.col("line")
    before = F.lag(key).over(order)
    wrong = (key > before if reverse else key < before) | (strict & (key == before) if strict else F.lit(False))
    rows = lines.withColumn("_wrong", wrong)
    first = F.min(F.when(F.col("_wrong"), F.col("line_no")))
    return rows.groupBy(*by).agg(first.alias("disorder_line")).withColumn("status", F.col("disorder_line").isNotNull().cast("int"))


def grouped_permutation(given: DataFrame, result: DataFrame, by: list[str]) -> DataFrame:
    """For each source: same_lines (the results are a permutation of the given lines) and grouped (equal ones stand together)."""
    count = lambda df, name: df.groupBy(*by, "line").agg(F.count("*").alias(name))
    both = count(given, "g").join(count(result, "r"), [*by, "line"], "full_outer")
    same = both.groupBy(*by).agg(F.bool_and(F.coalesce("g", F.lit(0)) == F.coalesce("r", F.lit(0))).alias("same_lines"))
    order = Window.partitionBy(*by).orderBy("line_no")
    starts = result.withColumn("_start", ~F.col("line").eqNullSafe(F.lag("line").over(order)) | (F.row_number().over(order) == 1))
    runs = starts.groupBy(*by).agg((F.sum(F.col("_start").cast("int")) == F.count_distinct("line")).alias("grouped"))
    return same.join(runs, by, "left").withColumn("grouped", F.coalesce("grouped", F.lit(True)))


def search(lines: DataFrame, pattern: str, ignore_case: bool = False, invert: bool = False, prefix: str | None = None) -> DataFrame:
    """The lines that hold the pattern; `out` is the line as shown, after the prefix column and a colon if one is given."""
    hit = fixed_match("line", pattern, ignore_case)
    found = lines.filter(~hit if invert else hit)
    shown = F.concat(F.col(prefix).cast("string"), F.lit(":"), F.col("line")) if prefix else F.col("line")
    return found.withColumn("out", shown)


def show_prefix(options: list[str], operands: list[str], directories: set[str], recursive: bool) -> bool:
    """Whether a search shows file names: the last of -H and -h wins, else several operands, else a folder that is walked."""
    chosen = [o for o in options if o in ("-H", "-h")]
    if chosen:
        return chosen[-1] == "-H"
    return len(operands) > 1 or recursive and any(o in directories for o in operands)


def search_operands(lines: DataFrame, operands: DataFrame, pattern: str, ignore_case: bool = False, recursive: bool = False) -> DataFrame:
    """A search over operands (ord, operand, kind) in order: lines in `out`, and diagnostics of missing files and folders.

    lines: operand, walk_ord, line_no, line. A folder is an error unless it is walked. Rows: ord, walk_ord, line_no, out, is_error.
    """
    hits = search(lines, pattern, ignore_case).join(F.broadcast(operands.select("ord", "operand", "kind")), "operand")
    readable = (F.col("kind") == "file") | (F.lit(recursive) & (F.col("kind") == "dir"))
    good = hits.filter(readable).select("ord", "walk_ord", "line_no", "out", F.lit(False).alias("is_error"))
    problem = F.when(F.col("kind").isNull(), "No such file or directory").when((F.col("kind") == "dir") & ~F.lit(recursive), "Is a directory").when(F.col("kind") == "unreadable", "Permission denied")
    bad = operands.withColumn("_p", problem).filter("_p is not null").select("ord", F.lit(0).alias("walk_ord"), F.lit(0).alias("line_no"), F.concat_ws(": ", "operand", "_p").alias("out"), F.lit(True).alias("is_error"))
    return good.unionByName(bad)


def search_status(found: DataFrame) -> DataFrame:
    """One row: status 2 after any error, else 0 with and 1 without a line."""
    return found.agg(F.when(F.coalesce(F.bool_or("is_error"), F.lit(False)), 2).when(F.count_if(~F.col("is_error")) > 0, 0).otherwise(1).alias("status"))
