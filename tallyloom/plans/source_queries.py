"""Further sort orders, option rules, source features and churn."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import orders as O
from tallyloom.operators import source_features as SF
from tallyloom.operators import telemetry as T
from tallyloom.plans.registry import query
from tallyloom.plans.shared import ranked, table

PRICES = "SELECT CAST(CAST(o_totalprice - 100000 AS DECIMAL(18, 2)) AS VARCHAR) AS line FROM orders"


def ranked_by(lines, options):
    df, keys = O.with_keys(lines, options)
    return ranked(df, *keys).select("rank", "line")


def prices(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_totalprice") - 100000).cast("decimal(18,2)").cast("string").alias("line"), F.col("o_orderkey").alias("line_no"))


@query(f"SELECT row_number() OVER (ORDER BY CAST(line AS DECIMAL(18, 2)), line) AS rank, line FROM ({PRICES})")
def order_numeric(spark, sf_dir):
    return ranked_by(prices(spark, sf_dir), O.Options("n"))


@query(f"SELECT row_number() OVER (ORDER BY CAST(line AS DECIMAL(18, 2)) DESC, line DESC) AS rank, line FROM ({PRICES})")
def order_numeric_reverse(spark, sf_dir):
    return ranked_by(prices(spark, sf_dir), O.Options("nr"))


@query("""
SELECT row_number() OVER (ORDER BY CAST(line_no % 97 AS BIGINT), line) AS rank, line FROM (SELECT o_orderstatus || ':' || (o_orderkey % 97) || ':' || o_orderpriority AS line, o_orderkey AS line_no FROM orders)""")
def order_by_field(spark, sf_dir):
    k = F.col("o_orderkey")
    lines = table(spark, sf_dir, "orders").select(F.concat_ws(":", "o_orderstatus", (k % 97).cast("string"), "o_orderpriority").alias("line"), k.alias("line_no"))
    return ranked_by(lines, O.Options("", [O.Key.parse("2n,2")], ":"))


@query("""
WITH l AS (SELECT ['Jan', 'FEB', 'mar', 'Apr', 'may', 'x', 'Dec'][1 + (o_orderkey % 7)::INTEGER] || ' ' || o_orderpriority AS line FROM orders)
SELECT row_number() OVER (ORDER BY coalesce(list_position(['JAN', 'FEB', 'MAR', 'APR', 'MAY', 'JUN', 'JUL', 'AUG', 'SEP', 'OCT', 'NOV', 'DEC'], upper(substr(line, 1, 3))), 0), line) AS rank, line FROM l""")
def order_month(spark, sf_dir):
    names = F.array(*map(F.lit, ("Jan", "FEB", "mar", "Apr", "may", "x", "Dec")))
    lines = table(spark, sf_dir, "orders").select(F.concat_ws(" ", F.get(names, (F.col("o_orderkey") % 7).cast("int")), "o_orderpriority").alias("line"), F.col("o_orderkey").alias("line_no"))
    return ranked_by(lines, O.Options("M"))


FLAGS = ["-b", "-d", "-f", "-g", "-h", "-i", "-M", "-n", "-R", "-r", "-V", "-c", "-C", "-o", "-u", "-s", "--debug"]


@query(f"""
WITH v AS (SELECT {FLAGS} AS f), c AS (SELECT o_orderkey, list_sort(list_distinct([f[o_orderkey % 17 + 1], f[o_orderkey // 17 % 17 + 1], f[o_custkey % 17 + 1]])) AS x FROM orders, v),
k AS (SELECT o_orderkey, x, len(list_intersect(x, ['-n', '-g', '-h', '-M'])) + CAST(list_has_any(x, ['-d', '-i', '-R', '-V']) AS INTEGER) AS modes, list_has_any(x, ['-c', '-C']) AS checks, list_contains(x, '-o') AS output FROM c),
r AS (SELECT o_orderkey, x, CASE WHEN modes > 1 THEN 'C1_mode_incompat' WHEN list_has_all(x, ['-c', '-C']) THEN 'C2_cC' WHEN checks AND output THEN 'C4_check_output'
  WHEN list_contains(x, '--debug') AND (checks OR output) THEN 'C5_debug_incompat' END AS rule FROM k)
SELECT o_orderkey, array_to_string(x, ' ') AS flags, CASE WHEN rule IS NULL THEN 'OK' ELSE 'CONFLICT' END AS verdict, rule, CASE WHEN rule IS NULL THEN 0 ELSE 2 END AS status FROM r""")
def option_rules(spark, sf_dir):
    """Orders as calls of up to three options."""
    k, names = F.col("o_orderkey"), F.array(*map(F.lit, FLAGS))
    picked = [F.get(names, i.cast("int")) for i in (k % 17, F.floor(k / 17) % 17, F.col("o_custkey") % 17)]
    calls = table(spark, sf_dir, "orders").select("o_orderkey", F.array_sort(F.array_distinct(F.array(*picked))).alias("flags"))
    return O.validated(calls).withColumn("flags", F.array_join("flags", " "))


@query(f"WITH v AS (SELECT 'v' || (o_orderkey % 1000) || '.' || repeat('0', CAST(o_orderkey % 3 AS INTEGER)) || (o_custkey % 17) || '.tar' AS line, o_orderkey % 1000 AS major, o_custkey % 17 AS minor FROM orders) SELECT row_number() OVER (ORDER BY major, minor, line) AS rank, line FROM v")
def order_version(spark, sf_dir):
    k, m = F.col("o_orderkey"), F.col("o_custkey")
    line = F.concat(F.lit("v"), (k % 1000).cast("string"), F.lit("."), F.repeat(F.lit("0"), (k % 3).cast("int")), (m % 17).cast("string"), F.lit(".tar"))
    return ranked_by(table(spark, sf_dir, "orders").select(line.alias("line"), k.alias("line_no")), O.Options("V"))


@query("""WITH g AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'none' WHEN o_orderkey % 11 = 1 THEN 'nan' ELSE (o_orderkey % 977) || 'e' || (o_custkey % 4) || 'x' END AS line,
  CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 11 = 1 THEN 1 ELSE 2 END AS kind, CASE WHEN o_orderkey % 11 > 1 THEN (o_orderkey % 977) * power(10, o_custkey % 4) ELSE 0 END AS value FROM orders)
SELECT row_number() OVER (ORDER BY kind, value, line) AS rank, line FROM g""")
def order_general(spark, sf_dir):
    k, m = F.col("o_orderkey"), F.col("o_custkey")
    line = F.when(k % 11 == 0, "none").when(k % 11 == 1, "nan").otherwise(F.concat((k % 977).cast("string"), F.lit("e"), (m % 4).cast("string"), F.lit("x")))
    return ranked_by(table(spark, sf_dir, "orders").select(line.alias("line"), k.alias("line_no")), O.Options("g"))


@query("""WITH h AS (SELECT (o_orderkey % 1000) || ['', 'K', 'M', 'G'][1 + CAST(o_custkey % 4 AS INTEGER)] AS line, o_orderkey % 1000 AS n, o_custkey % 4 AS s FROM orders)
SELECT row_number() OVER (ORDER BY CASE WHEN n = 0 THEN 0 ELSE 1 END, CASE WHEN n = 0 THEN 0 ELSE s END, n, line) AS rank, line FROM h""")
def order_human(spark, sf_dir):
    k, m = F.col("o_orderkey"), F.col("o_custkey")
    line = F.concat((k % 1000).cast("string"), F.get(F.array(*map(F.lit, ("", "K", "M", "G"))), (m % 4).cast("int")))
    return ranked_by(table(spark, sf_dir, "orders").select(line.alias("line"), k.alias("line_no")), O.Options("h"))


@query("""WITH l AS (SELECT '  ' || o_orderpriority || '-' || o_orderkey AS line FROM orders) SELECT row_number() OVER (ORDER BY regexp_replace(ltrim(line, ' '), '[^ A-Za-z0-9]', '', 'g'), line) AS rank, line FROM l""")
def order_dictionary(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select(F.concat(F.lit("  "), "o_orderpriority", F.lit("-"), F.col("o_orderkey").cast("string")).alias("line"), F.col("o_orderkey").alias("line_no"))
    return ranked_by(lines, O.Options("bd"))


def sources(spark, sf_dir):
    """Page scripts and texts as sources: the lexer takes any text."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("run"), F.col("html").alias("source"))


@query()
def source_features(spark, sf_dir):
    return SF.source_features(sources(spark, sf_dir))


@query("""
WITH s AS (SELECT s_suppkey, 'int f' || s_suppkey || '(int a) { return g(a, ' || s_nationkey || '); }' AS f, 'int main(void) { return f' || s_suppkey || '(1); }' AS m FROM supplier)
SELECT s_suppkey::VARCHAR AS run, 'f' || s_suppkey AS name, 0 AS start_byte, CAST(length(f) AS INTEGER) AS end_byte, sha256(f) AS sha256, 'g' AS calls FROM s
UNION ALL SELECT s_suppkey::VARCHAR, 'main', CAST(length(f) + 1 AS INTEGER), CAST(length(f) + 1 + length(m) AS INTEGER), sha256(m), 'f' || s_suppkey FROM s""")
def source_functions(spark, sf_dir):
    code = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("run"), F.format_string("int f%d(int a) { return g(a, %d); }\nint main(void) { return f%d(1); }", "s_suppkey", "s_nationkey", "s_suppkey").alias("source"))
    return SF.function_table(code).withColumn("calls", F.array_join("calls", ","))


@query()
def line_churn(spark, sf_dir):
    """Each turn but the first against the one before it."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = table(spark, sf_dir, "conversations").withColumn("before", before).filter("before is not null and text is not null")
    return T.line_churn(pairs, ["conv_id", "turn"], "before", "text")
