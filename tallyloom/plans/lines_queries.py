"""Line operators over the lines of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import lines as L
from tallyloom.plans.registry import query
from tallyloom.plans.shared import ranked, table

LINES = """
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT * FROM (SELECT doc_id, len(p) AS n, unnest(p) AS line, unnest(range(0, len(p))) AS line_no FROM parts)
  WHERE NOT (line_no = n - 1 AND line = ''))
"""
FOLD = "translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
LOW = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.explode_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query(LINES + "SELECT row_number() OVER (ORDER BY line) AS rank, line FROM lines")
def lines_sort(spark, sf_dir):
    return L.sorted_lines(_lines(spark, sf_dir)).select("rank", "line")


@query(LINES + "SELECT row_number() OVER (ORDER BY line DESC) AS rank, line FROM lines")
def lines_sort_reverse(spark, sf_dir):
    return L.sorted_lines(_lines(spark, sf_dir), reverse=True).select("rank", "line")


@query(LINES + f"SELECT row_number() OVER (ORDER BY {FOLD}, line) AS rank, line FROM lines")
def lines_sort_fold(spark, sf_dir):
    return L.sorted_lines(_lines(spark, sf_dir), fold=True).select("rank", "line")


@query(LINES + "SELECT row_number() OVER (ORDER BY line) AS rank, line FROM (SELECT DISTINCT line FROM lines)")
def lines_unique(spark, sf_dir):
    return ranked(L.unique_lines(_lines(spark, sf_dir)), "line")


@query(LINES + f"SELECT row_number() OVER (ORDER BY {FOLD}, line) AS rank, line FROM (SELECT min(line) AS line FROM lines GROUP BY {FOLD})")
def lines_unique_fold(spark, sf_dir):
    return ranked(L.unique_lines(_lines(spark, sf_dir), fold=True), *L.sort_key(True))


@query(LINES + f"SELECT row_number() OVER (ORDER BY {FOLD} DESC, line DESC) AS rank, line FROM (SELECT min(line) AS line FROM lines GROUP BY {FOLD})")
def lines_unique_fold_reverse(spark, sf_dir):
    return ranked(L.unique_lines(_lines(spark, sf_dir), fold=True), *[k.desc() for k in L.sort_key(True)])


def _check_sql(key: str, wrong: str) -> str:
    return LINES + f""", o AS (SELECT doc_id, line_no, {key} AS k, lag({key}) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM lines)
SELECT doc_id, CAST(min(line_no) FILTER (WHERE {wrong}) AS INTEGER) AS disorder_line,
       CAST(count(*) FILTER (WHERE {wrong}) > 0 AS INTEGER) AS status FROM o GROUP BY doc_id"""


@query(_check_sql("line", "k < before"))
def lines_check(spark, sf_dir):
    return L.order_check(_lines(spark, sf_dir), ["doc_id"])


@query(_check_sql("line", "k <= before"))
def lines_check_strict(spark, sf_dir):
    return L.order_check(_lines(spark, sf_dir), ["doc_id"], strict=True)


@query(_check_sql(FOLD, "k < before"))
def lines_check_fold(spark, sf_dir):
    return L.order_check(_lines(spark, sf_dir), ["doc_id"], fold=True)


@query(_check_sql("line", "k > before"))
def lines_check_reverse(spark, sf_dir):
    return L.order_check(_lines(spark, sf_dir), ["doc_id"], reverse=True)


@query(LINES + "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line AS out FROM lines WHERE contains(line, 'the')")
def grep_fixed(spark, sf_dir):
    return L.search(_lines(spark, sf_dir), "the").select("doc_id", "line_no", "out")


@query(LINES + f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line AS out FROM lines WHERE contains({LOW}, 'token')")
def grep_ignore_case(spark, sf_dir):
    return L.search(_lines(spark, sf_dir), "ToKeN", ignore_case=True).select("doc_id", "line_no", "out")


@query(LINES + "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(doc_id AS VARCHAR) || ':' || line AS out FROM lines WHERE contains(line, 'und')")
def grep_with_filename(spark, sf_dir):
    return L.search(_lines(spark, sf_dir), "und", prefix="doc_id").select("doc_id", "line_no", "out")


@query(LINES + "SELECT source, CAST(CASE WHEN count(*) FILTER (WHERE contains(line, 'Licensed')) > 0 THEN 0 ELSE 1 END AS INTEGER) AS status FROM lines JOIN documents USING (doc_id) GROUP BY source")
def grep_status(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "text")
    lines = L.explode_lines(docs, "text")
    return lines.groupBy("source").agg(F.when(F.count_if(F.contains("line", F.lit("Licensed"))) > 0, 0).otherwise(1).alias("status"))


@query(LINES + "SELECT doc_id, true AS same_lines, count(DISTINCT line) = count(*) FILTER (WHERE before IS NULL OR line <> before) AS grouped FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM lines) GROUP BY doc_id")
def lines_grouped(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return L.grouped_permutation(lines, lines, ["doc_id"])
