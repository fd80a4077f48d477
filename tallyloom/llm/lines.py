"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A document is its sequence of lines (split at newlines). Each GRAM consecutive lines have a
64-bit hash. Of each WINDOW consecutive hashes the smallest (of equal ones the last) is selected, and the distinct
selected places are the document's fingerprints. So of any LINES = GRAM + WINDOW - 1 consecutive lines one place is
selected, the same one wherever these lines stand.

Fingerprints that occur at one place only are dropped. The others are extended: to the LINES lines that begin so many lines before
the fingerprint (0 to WINDOW - 1). Extensions are joined on a digest of their lines (128 bits of SHA-256), not on the fingerprint, and each is matched with the earliest
place of the same lines. Neighbouring matches whose sources lie equally far away form one run, the maximal one both
ways. Every line of a run that is later than its source is deleted. What is earlier goes by (doc_id, line number), and
runs are judged on the input, not on what is left of it.

With `words`, runs of fewer than LINES lines count too if they hold so many words (split at x20 and x09-x0D): each such run is
a fingerprint of its own. So the guarantee goes by content, and a long passage on a single line is found.

Defined cases: a null text has no lines and stays null; an empty text is one empty line. Without `words`, documents of fewer than LINES
lines keep all. A null doc_id sorts after all others. A run may overlap its source in one document (a line repeated many times
shrinks to one). Rows that repeat doc_id and text count as one document and get the same result each. The columns of the
input stay, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import table, written

GRAM, WINDOW = 2, 2
LINES = GRAM + WINDOW - 1
WORDS = 50  # of a run of fewer lines that is long enough to count
NO_ID = (1 << 63) - 1


def _words(line: Column) -> Column:
    """How many words a line has whose only white space are blanks; it is split only if the number of blanks doesn't say."""
    split = F.size(F.filter(F.split(line, " "), lambda w: w != ""))
    loose = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(line == "", 0).when(loose, split).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _digest(*parts: Column) -> Column:
    """SHA-256 of the parts, 16 bytes of it."""
    return F.unhex(F.left(F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256), F.lit(32)))


def _starts(n: int) -> Column:
    """Where n lines may begin."""
    return F.when(F.size("_x") >= n, F.sequence(F.lit(0), F.size("_x") - n)).otherwise(F.array().cast("array<int>"))


def fingerprints(docs: DataFrame, words: int | None = None) -> DataFrame:
    """_doc, _text, _print, _spans: the selected places of each text, and the runs (start, number of lines, digest) that they stand for."""
    text = F.when(F.col("text").rlike("[\t\x0b\f\r]"), F.translate("text", "\t\x0b\f\r", "    ")).otherwise(F.col("text"))
    n_words = F.transform(F.split(text, "\n"), _words)
    lines = F.split("text", "\n")
    hashed = docs.filter(F.size(lines) >= (LINES if words is None else 1)).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"),
        F.xxhash64("text").alias("_text"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("_x"),
        F.transform(lines, lambda x: _digest(x)).alias("_h"),
        *([] if words is None else [n_words.alias("_w")]),
    )
    of = lambda array, i, n: [F.get(F.col(array), i + j) for j in range(n)]
    hashed = hashed.withColumn("_g", F.transform(_starts(GRAM), lambda i: F.xxhash64(*of("_x", i, GRAM))))

    def select(w: Column) -> Column:
        """The place of the smallest of the hashes from w on; of equal ones the last."""
        return -F.least(*[F.struct(F.get("_g", w + j).alias("g"), (-(w + j)).alias("at")) for j in range(WINDOW)])["at"]

    chosen = F.array_distinct(F.transform(_starts(LINES), select))
    run = lambda i, n: F.struct(i.alias("i"), F.lit(n).alias("n"), _digest(*of("_h", i, n)).alias("l"))
    fits = lambda i: (i >= 0) & (i + LINES <= F.size("_x"))
    found = [F.transform(chosen, lambda p: F.struct(F.get("_g", p).alias("p"), F.array(*[F.when(fits(p - back), run(p - back, LINES)) for back in range(WINDOW)]).alias("s")))]

    def short(n: int) -> Column:
        enough = F.filter(_starts(n), lambda i: sum((F.get(F.col("_w"), i + j) for j in range(1, n)), F.get(F.col("_w"), i)) >= words)
        return F.transform(enough, lambda i: F.struct(F.xxhash64(F.lit(n), *of("_x", i, n)).alias("p"), F.array(run(i, n)).alias("s")))

    if words is not None:
        found += map(short, range(1, LINES))
    return hashed.select("_doc", "_text", F.inline(F.concat(*found) if len(found) > 1 else found[0]).alias("_print", "_spans"))


def repeated_runs(docs: DataFrame, words: int | None = None) -> DataFrame:
    """_doc, _text, start, length, source_doc, source_start: maximal runs of lines that occur earlier."""
    rows = fingerprints(docs, words)
    prints = rows.groupBy("_print").agg(F.count("*").alias("_n")).filter("_n > 1").select("_print")
    shared = rows.join(prints, "_print", "left_semi")
    spans = shared.select("_doc", "_text", F.inline(F.filter("_spans", lambda s: s.isNotNull())).alias("_i", "_span", "_lines"))
    spans = written(docs.sparkSession, spans, "lines")  # used twice, and small beside the texts
    here = F.struct("_doc", "_i")
    first = spans.groupBy("_lines").agg(F.min(here).alias("_first"), F.max(here).alias("_last")).filter("_first < _last").drop("_last")
    later = spans.join(first, "_lines").filter(here > F.col("_first"))
    order = Window.partitionBy("_doc", "_text", "_span").orderBy("_i")
    follows = (F.lag("_i").over(order) == F.col("_i") - 1) & (F.lag("_first._doc").over(order) == F.col("_first._doc")) & (F.lag("_first._i").over(order) == F.col("_first._i") - 1)
    begun = F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(order)
    later = later.dropDuplicates(["_doc", "_text", "_span", "_i"]).withColumn("_run", begun)
    return later.groupBy("_doc", "_text", "_span", "_run").agg(
        F.min("_i").alias("start"), (F.max("_i") - F.min("_i") + F.col("_span")).alias("length"),
        F.min("_first._doc").alias("source_doc"), F.min("_first._i").alias("source_start"),
    ).drop("_run", "_span")


def dedup_lines(docs: DataFrame, words: int | None = None) -> DataFrame:
    """docs with text without the lines of later runs; behind its columns _n_lines and _n_removed (with more _ before them if docs has such columns)."""
    gone = repeated_runs(docs, words).groupBy("_doc", "_text").agg(F.flatten(F.collect_list(F.sequence("start", F.expr("start + length - 1")))).alias("_gone"))
    keyed = docs.select(F.struct("*").alias("_row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"), F.xxhash64("text").alias("_text"))
    text = F.col("_row.text")
    lines = F.split(text, "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone"), lambda i: F.get(lines, i))
    joined = keyed.join(gone, ["_doc", "_text"], "left")
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.coalesce(F.size(F.array_distinct("_gone")), F.lit(0)).cast("long")
    left = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    columns = [(left if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns]
    more = [next(n for i in range(1, 99) if (n := "_" * i + name) not in docs.columns) for name in ("n_lines", "n_removed")]
    return joined.select(*columns, n_lines.alias(more[0]), n_removed.alias(more[1]))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_line_dedup with the runs of fewer lines that hold WORDS words, as the pipeline has it."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), WORDS)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


LINES_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(0, len(string_split(text, chr(10))))) AS i
  FROM {table} WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, i, line, lead(line, 1) OVER p AS line_1, lead(line, 2) OVER p AS line_2
  FROM l WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line, line_1, line_2 ORDER BY doc_id, i) AS nth
  FROM w WHERE line_2 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM r, range(0, 3) t(o) WHERE nth > 1),
k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
         string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS kept
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
"""
OP10_SQL = LINES_SQL.format(table="documents") + """
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""

PASSAGE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(0, len(string_split(text, chr(10))))) AS i
  FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n_words FROM l),
w AS (
  SELECT doc_id, i, n_words, line, lead(line, 1) OVER p AS line_1, lead(line, 2) OVER p AS line_2, lead(n_words) OVER p AS n_words_1
  FROM m WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (
  SELECT doc_id, i, 3 AS span, row_number() OVER (PARTITION BY line, line_1, line_2 ORDER BY doc_id, i) AS nth
  FROM w WHERE line_2 IS NOT NULL
  UNION ALL
  SELECT doc_id, i, 2, row_number() OVER (PARTITION BY line, line_1 ORDER BY doc_id, i) FROM w WHERE line_1 IS NOT NULL AND n_words + n_words_1 >= 50
  UNION ALL
  SELECT doc_id, i, 1, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) FROM w WHERE n_words >= 50),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM r, range(0, 3) t(o) WHERE nth > 1 AND o < span),
k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
         string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS kept
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
