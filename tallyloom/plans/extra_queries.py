"""Queries of text columns, contracts, judging, syntax trees and sinks that read back what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.functions import modes as M
from tallyloom.functions import text as X
from tallyloom.operators import behavior as B
from tallyloom.operators import contracts as K
from tallyloom.operators import distance as D
from tallyloom.operators import experiments as E
from tallyloom.operators import filesystem as FS
from tallyloom.operators import judging as J
from tallyloom.operators import lineage as L
from tallyloom.operators import reliability as R
from tallyloom.operators import paper
from tallyloom.operators import report as P
from tallyloom.operators import suites as U
from tallyloom.operators import syntax as S
from tallyloom.operators import telemetry as T
from tallyloom.plans.rate_queries import rounded
from tallyloom.plans.registry import query
from tallyloom.plans.shared import ranked, shared_dir, table
from tallyloom.sources import files


def _new(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _list(values) -> F.Column:
    return F.array(*map(F.lit, values))


def _pick(values, i) -> F.Column:
    return F.get(_list(values), i.cast("int"))


# text columns


@query("SELECT doc_id, len(string_split(t, chr(0))) - CASE WHEN t LIKE '%' || chr(0) THEN 1 ELSE 0 END AS n, string_split(t, chr(0))[1] AS first FROM (SELECT doc_id, replace(text, ' ', chr(0)) AS t FROM documents WHERE text IS NOT NULL)")
def records_by_nul(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.replace("text", F.lit(" "), F.lit("\0")).alias("t"))
    return d.select("doc_id", X.records("t", "\0").alias("r")).select("doc_id", F.size("r").alias("n"), F.get("r", F.lit(0)).alias("first"))


@query("SELECT page_id, regexp_replace(url, '/+$', '') || '/' || page_id AS joined, CASE WHEN regexp_replace(url, '/+$', '') = '' AND url <> '' THEN '/' ELSE regexp_replace(url, '/+$', '') END AS normal FROM pages")
def page_paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", X.join_path("url", F.col("page_id").cast("string")).alias("joined"), X.normal_path("url").alias("normal"))


@query("""SELECT s_suppkey, trim(regexp_replace('int f' || s_suppkey || '(void)  { return "/* ' || s_name || ' */";' || chr(10) || ' }', '\\s+', ' ', 'g')) AS source FROM supplier""")
def normal_sources(spark, sf_dir):
    code = F.format_string('int f%d(void) /* gone %s */ { return "/* %s */"; // gone\n }', "s_suppkey", "s_name", "s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.normal_source(code).alias("source"))


@query("""WITH t AS (SELECT conv_id, turn, '# ' || role || chr(10) || text AS t FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, regexp_replace(t, '(?m)^(#+ )', '##\\1', 'g') AS deeper, regexp_replace(t, '(?m)^([^\\n])', '    \\1', 'g') AS indented, trim(regexp_replace(t, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ') AS collapsed, right(t, 40) AS tail FROM t""")
def prompt_blocks(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.concat(F.lit("# "), "role", F.lit("\n"), "text").alias("t"))
    return t.select("conv_id", "turn", X.demote_headings("t", 2).alias("deeper"), X.indent_block("t").alias("indented"), X.collapse("t").alias("collapsed"), X.tail("t", 40).alias("tail"))


@query("""SELECT conv_id, turn, 'Task: ' || text || '.' AS prompt FROM conversations WHERE text IS NOT NULL""")
def filled_prompts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    return c.select("conv_id", "turn", X.filled(X.without_comments(F.lit("<!-- a note -->\nTask: {{text}}.")), "text", "text").alias("prompt"))


@query("""SELECT o_orderkey, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', round(ms / 1000.0, 1)) WHEN ms < 3600000 THEN printf('%dm%02ds', ms // 60000, ms // 1000 % 60) ELSE printf('%dh%02dm', ms // 3600000, ms // 60000 % 60) END AS shown
FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 100 AS ms FROM orders)""")
def human_durations(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.human_duration(k * k * 100).alias("shown"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'cc' ELSE 'make -j' || s_suppkey || ' -o build/u' || s_suppkey END AS command, s_suppkey % 4 <> 0 AS has_output, CASE WHEN s_suppkey % 4 <> 0 THEN 'build/u' || s_suppkey END AS binary,
  CASE WHEN s_suppkey % 3 = 0 THEN 'sort' END AS utility, CASE WHEN s_suppkey % 2 = 0 THEN '-r,-u' ELSE '' END AS flags, s_suppkey % 5 = 0 AS rejected FROM supplier""")
def recorded_commands(spark, sf_dir):
    k = F.col("s_suppkey")
    command = F.when(k % 4 == 0, "cc").otherwise(F.format_string("make -j%d -o build/u%d", k, k))
    judge = F.when(k % 2 == 0, "run --implemented=-r,,-u x").otherwise("run x")
    log = F.when(k % 5 == 0, "The user rejected permission to use this tool").otherwise("all went well")
    path = F.when(k % 3 == 0, "src/new_sort.c").otherwise("src/main.c")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", command.alias("command"), judge.alias("judge"), log.alias("log"), path.alias("path"))
    return rows.select(
        "s_suppkey", "command", X.output_binary("command").isNotNull().alias("has_output"), X.output_binary("command").alias("binary"), X.utility_of("path").alias("utility"),
        F.array_join(X.flag_list("judge"), ",").alias("flags"), X.permission_rejected("log").alias("rejected"),
    )


@query("""SELECT s_suppkey, 'suite' AS kind, 'case::' || s_suppkey AS name FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT s_suppkey, 'unittest', 'test_' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 1 UNION ALL SELECT s_suppkey, 'compiler', 'a.c:' || s_suppkey || ':1' FROM supplier WHERE s_suppkey % 4 = 2""")
def test_failures(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    compiler, unit = F.concat(F.lit("a.c:"), k, F.lit(":1: fatal error: x\n")), F.concat(F.lit("ERROR: test_"), k, F.lit(" (m)\n"))
    suite = F.concat(F.lit("FAIL  case::"), k, F.lit(" stdout differs\n"))
    n = F.col("s_suppkey") % 4
    log = F.concat(F.lit("FAIL  old::1\n===== VALIDATION LOOP 1: again =====\n"), F.when(n <= 2, compiler).otherwise("OK\n"), F.when(n <= 1, unit).otherwise(""), F.when(n == 0, suite).otherwise(""))
    return T.test_failures(table(spark, sf_dir, "supplier").select("s_suppkey", log.alias("log")), ["s_suppkey"], "log").drop("ord")


# reports, sinks and sources


@query("SELECT row_number() OVER (ORDER BY line) AS rank, line FROM (SELECT o_orderpriority || '/' || o_orderkey AS line FROM orders)")
def lines_written(spark, sf_dir):
    """Lines written in order, read back as bytes and ordered again."""
    path = _new(spark, "lines")
    P.write_lines(table(spark, sf_dir, "orders").select(F.concat_ws("/", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("line")), path, "line")
    return ranked(files.read_lines(spark, f"{path}/*.txt").select("line"), "line")


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS p_brand, p_size % 2 = 0 AS even FROM part")
def metrics_written(spark, sf_dir):
    """A CSV table written and read again, with a flag column; blank cells are nulls."""
    path = _new(spark, "metrics")
    even = F.when(F.col("p_size") % 2 == 0, "True").otherwise("False")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("p_brand"), even.alias("even"))
    P.write_csv_table(rows, path)
    return files.read_metrics(spark, path, ["even"])


@query("SELECT o_orderstatus AS status, sum(o_orderkey % 50)::BIGINT AS added, sum(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_custkey % 20 END)::BIGINT AS deleted, count(*) AS files FROM orders GROUP BY 1")
def numstat_written(spark, sf_dir):
    path, k = _new(spark, "numstat"), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((k % 50).cast("string").alias("a"), F.when(k % 7 == 0, "-").otherwise((F.col("o_custkey") % 20).cast("string")).alias("d"), F.concat_ws("/", "o_orderstatus", k.cast("string")).alias("p"))
    rows.write.option("sep", "\t").csv(path)
    stat = files.read_numstat(spark, path).withColumn("status", F.substring_index("path", "/", 1))
    return T.change_metrics(stat, ["status"])


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def documents_written(spark, sf_dir):
    """One JSON document a file, read back with a schema."""
    path = _new(spark, "documents")
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("part"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).write.partitionBy("part").json(path)
    return files.read_document(spark, path, "id int, name string, region int").filter("_corrupt is null").select("id", "name", "region")


@query("""SELECT s_suppkey::VARCHAR AS file, CAST(s_suppkey % 90 + 1 AS INTEGER) AS line, CAST(s_nationkey % 6 AS INTEGER) AS level, 'CWE-' || (s_suppkey % 30 + 1) AS cwes FROM supplier""")
def findings_written(spark, sf_dir):
    from tallyloom.operators.security import REQUIRED

    path, k = _new(spark, "findings"), F.col("s_suppkey")
    values = {"File": k.cast("string"), "Line": k % 90 + 1, "Column": F.lit(1), "DefaultLevel": F.lit(1), "Level": F.col("s_nationkey") % 6, "Category": F.lit("buffer"), "Name": F.lit("strcpy"), "Warning": F.lit('a "quoted", text'), "CWEs": F.concat(F.lit("CWE-"), (k % 30 + 1).cast("string"))}
    table(spark, sf_dir, "supplier").select(*[values.get(c, F.lit("x")).cast("string").alias(c) for c in REQUIRED]).write.option("header", True).option("escape", '"').csv(path)
    found = files.read_findings(spark, path, "r").filter(F.col("warning") == 'a "quoted", text')
    return found.select("file", "line", "level", F.array_join("cwe_ids", ",").alias("cwes"))


@query("SELECT n_name AS \"nation.name\", r_name AS \"nation.region\", 'a;b;' || n_nationkey AS tags FROM nation JOIN region ON n_regionkey = r_regionkey")
def flat_report(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return P.flat_columns(n.select(F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("region")).alias("nation"), F.array(F.lit("a"), F.lit("b"), F.col("n_nationkey").cast("string")).alias("tags")))


@query("SELECT n_nationkey, n_name || chr(31) || '' || chr(31) || n_regionkey AS record FROM nation")
def stage_records(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("none", F.lit(None).cast("string"))
    return n.select("n_nationkey", P.stage_record("n_name", "none", "n_regionkey").alias("record"))


MIXED = "CASE WHEN o_orderkey % 5 = 0 THEN 'unset' WHEN o_orderkey % 5 = 1 THEN 'auto' ELSE CAST((o_orderkey % 13) / 4.0 AS VARCHAR) END"


@query(f"SELECT row_number() OVER (ORDER BY TRY_CAST(t AS DOUBLE) IS NULL, TRY_CAST(t AS DOUBLE), t) AS rank, t AS temperature FROM (SELECT {MIXED} AS t FROM orders)")
def mixed_orders(spark, sf_dir):
    k = F.col("o_orderkey")
    t = F.when(k % 5 == 0, "unset").when(k % 5 == 1, "auto").otherwise(((k % 13) / 4.0).cast("string"))
    return ranked(table(spark, sf_dir, "orders").select(t.alias("temperature")), *P.mixed_order("temperature"))


# attempts and lineages


ATTEMPTS = """WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderkey % 11 = 0 AS setup_failed, o_orderkey % 3 AS llm, CASE o_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 124 WHEN 2 THEN 1 END AS code, o_orderkey % 2 = 0 AS cand, o_orderkey % 17 = 0 AS denied, o_orderkey % 5 <> 0 AS success FROM orders),
f AS (SELECT *, setup_failed AND llm = 0 AS infra FROM a),
s AS (SELECT *, CASE WHEN infra THEN NULL WHEN denied THEN 'permission' WHEN code = 124 AND NOT cand THEN 'timeout' WHEN code NOT IN (0, 124) THEN 'opencode' END AS stage FROM f)
"""


def _attempts(spark, sf_dir):
    k = F.col("o_orderkey")
    n = F.col("o_custkey") % 4
    code = F.when(n == 0, 0).when(n == 1, 124).when(n == 2, 1)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", (k % 11 == 0).alias("setup_failed"), (k % 3).cast("int").alias("llm_invocations"), code.alias("exit_code"), (k % 2 == 0).alias("candidate_after_timeout"),
        (k % 17 == 0).alias("permission_rejected"), F.lit(None).cast("string").alias("recorded_stage"), (k % 5 != 0).alias("success"), F.lit(False).alias("infrastructure_failure"),
    )


@query(ATTEMPTS + "SELECT o_orderkey, infra AS infrastructure_failure, stage AS agent_failure_stage, stage IS NOT NULL AS agent_failure, success AND NOT infra AND stage IS NULL AS success FROM s")
def attempt_states(spark, sf_dir):
    return R.normalized_attempts(_attempts(spark, sf_dir)).select("o_orderkey", "infrastructure_failure", "agent_failure_stage", "agent_failure", "success")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 8 = 0 ELSE o_custkey % 3 = 0 AND o_custkey % 5 <> 1 END AS passed FROM orders")
def public_validation(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 4 == 0, k % 8 == 0).alias("public_validation"), (c % 3).alias("build_exit_code"), F.when(c % 5 != 1, F.lit(0)).alias("feature_exit_code"), F.lit(0).alias("regression_exit_code"))
    return rows.select("o_orderkey", R.public_success().alias("passed"))


@query("SELECT o_orderstatus, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END), 6) AS build_ratio, round(avg(CASE WHEN o_custkey % 2 = 1 THEN NULL WHEN o_custkey % 4 = 0 THEN 1 ELSE 0 END), 6) AS test_ratio FROM orders GROUP BY 1")
def exit_ratios(spark, sf_dir):
    c = F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_orderkey") % 3).alias("build"), F.when(c % 2 == 0, c % 4).alias("test"))
    return rounded(R.stage_ratios(rows, ["o_orderstatus"], ["build", "test"]))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def members_with_source(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("run"))
    sources = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("run"))
    return R.with_source(o.filter("o_orderkey % 5 <> 0"), o, sources, ["run"]).select("o_orderkey")


@query("""WITH s AS (SELECT o_custkey AS lineage, o_orderkey AS pos, row_number() OVER w AS nth, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT lineage, pos, array_to_string(list_sort(list_filter(['-a', '-b', '-r', '-u'], lambda f: CASE f WHEN '-a' THEN pos % 2 = 0 AND before % 2 <> 0 WHEN '-b' THEN pos % 3 = 0 AND before % 3 <> 0 WHEN '-r' THEN pos % 5 = 0 AND before % 5 <> 0 ELSE pos % 7 = 0 AND before % 7 <> 0 END)), ',') AS added FROM s WHERE nth > 1""")
def flags_added(spark, sf_dir):
    k = F.col("o_orderkey")
    flags = F.array_compact(F.array(F.when(k % 7 == 0, "-u"), F.when(k % 2 == 0, "-a"), F.when(k % 3 == 0, "-b"), F.when(k % 5 == 0, "-r")))
    stages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lineage"), k.alias("pos"), flags.alias("implemented_flags"))
    return L.added_flags(stages).select("lineage", "pos", F.array_join("added_flags", ",").alias("added"))


@query("""WITH f AS (SELECT event_type AS checkpoint, min((user_id, event_id)) AS f FROM events WHERE user_id IS NOT NULL GROUP BY 1) SELECT checkpoint, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS pos FROM f""")
def checkpoint_positions(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("user_id is not null")
    return L.checkpoint_order(e.select(F.col("event_type").alias("checkpoint"), F.col("user_id").alias("lineage"), F.col("event_id").alias("pos")))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS loop FROM events")
def session_ordinals(spark, sf_dir):
    return T.with_ordinal(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("event_id", "loop")


# labels, baselines and views


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'given' WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN 'u' || c_nationkey ELSE 'tool' || c_nationkey END AS issue,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'p' || c_nationkey || '.v1' END AS checkpoint FROM customer""")
def inferred_labels(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 7 == 0, " given ").otherwise(" ").alias("label"), F.when(k % 3 == 0, F.col("c_mktsegment")).alias("issue"), F.when(k % 2 == 0, F.concat(F.lit("u"), n)).alias("utility"),
        F.concat(F.lit("src\\new_tool"), n, F.lit(".c")).alias("source_path"), F.lit(None).cast("string").alias("checkpoint"), F.lit("").alias("issue_id"), F.when(k % 5 != 0, F.concat(F.lit("/prompts/p"), n, F.lit(".v1.md"))).alias("prompt"),
    )
    return rows.select("c_custkey", E.issue_label("label").alias("issue"), E.checkpoint_label().alias("checkpoint"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '/repo/seeds/a' || s_suppkey || '.c' WHEN 1 THEN '/abs/b.c' END AS baseline, CASE WHEN s_suppkey % 3 < 2 THEN 'recorded_seed' ELSE 'empty_from_scratch' END AS origin FROM supplier""")
def seed_baselines(spark, sf_dir):
    k = F.col("s_suppkey")
    seeds = F.when(k % 3 == 0, F.format_string("x.c:other.c,seeds/a%d.c:main.c", k)).when(k % 3 == 1, "/abs/b.c:main.c").otherwise("y.c")
    return E.baselines(table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("/repo/").alias("repository"), seeds.alias("seed_files"), F.lit("main.c").alias("source_path"))).select("s_suppkey", "baseline", "origin")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '/repo/seeds/a' || s_suppkey || '.c' WHEN s_suppkey % 5 = 0 THEN '/abs/b' || s_suppkey || '.c' END AS baseline,
  CASE WHEN s_suppkey % 2 = 0 OR s_suppkey % 5 = 0 THEN 'recorded_seed' ELSE 'empty_from_scratch' END AS origin FROM supplier""")
def seed_files_found(spark, sf_dir):
    """Of two recorded seeds the first that is a file, or none."""
    k, s = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    rows = s.select("s_suppkey", F.lit("/repo").alias("repository"), F.format_string("seeds/a%d.c:main.c,/abs/b%d.c:main.c", k, k).alias("seed_files"), F.lit("main.c").alias("source_path"))
    there = s.filter(k % 2 == 0).select(F.format_string("/repo/seeds/a%d.c", k).alias("path")).unionByName(s.filter(k % 5 == 0).select(F.format_string("/abs/b%d.c", k).alias("path")))
    return E.baselines(rows, files=there, by=["s_suppkey"]).select("s_suppkey", "baseline", "origin")


@query("SELECT o_orderkey AS run, o_totalprice AS score, CAST(NULL AS INTEGER) AS lines_added, 'passing' AS population FROM orders WHERE o_orderstatus = 'F'")
def population_view(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("score"), (F.col("o_orderkey") % 9).cast("int").alias("lines_added"))
    return E.write_view(spark, runs, "passing", _new(spark, "view"))


@query("""SELECT s_suppkey, 'unavailable' AS status, 'version_mismatch' AS reason, CAST(NULL AS VARCHAR) AS findings FROM supplier""")
def unavailable_scans(spark, sf_dir):
    missing = {"status": "unavailable", "reason": "version_mismatch", "path": None, "options": []}
    return E.scan_sources(table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("int main(void) {}").alias("source")), ["s_suppkey"], missing)


# judging


ARGS = ["-R", "-u", "-Ru", "-c", "-Rc", "--sort=random", "--debug", "-k2", "-ku", "-f", "--key=1", "x", "-", "--random-sort", "-n", "--check=quiet", "-to", "--unique"]
CALLS = f"WITH v AS (SELECT {ARGS} AS a), c AS (SELECT o_orderkey, a[o_orderkey % {len(ARGS)} + 1] AS a, a[o_custkey % {len(ARGS)} + 1] AS b FROM orders, v)"


@query(CALLS + """, l AS (SELECT o_orderkey, a, b, CASE WHEN a LIKE '-%' AND a NOT LIKE '--%' THEN regexp_extract(a, '^-([^kotST]*[kotST]?)', 1) ELSE '' END || CASE WHEN b LIKE '-%' AND b NOT LIKE '--%' THEN regexp_extract(b, '^-([^kotST]*[kotST]?)', 1) ELSE '' END AS l FROM c)
SELECT o_orderkey, CASE WHEN NOT (l LIKE '%R%' OR a IN ('--sort=random', '--random-sort') OR b IN ('--sort=random', '--random-sort')) THEN 'golden' WHEN l LIKE '%c%' OR a IN ('--debug', '--check=quiet') OR b IN ('--debug', '--check=quiet') THEN 'none' ELSE 'property:shuffle' END AS policy,
  l LIKE '%u%' OR a = '--unique' OR b = '--unique' AS is_unique, regexp_matches(l, '[fidbnghMVkt]') OR a = '--key=1' OR b = '--key=1' AS keyed FROM l""")
def check_policies(spark, sf_dir):
    """Orders as calls of two arguments each."""
    args = F.array(_pick(ARGS, F.col("o_orderkey") % len(ARGS)), _pick(ARGS, F.col("o_custkey") % len(ARGS)))
    return table(spark, sf_dir, "orders").select("o_orderkey", J.check_policy(args).alias("policy"), J.is_unique(args).alias("is_unique"), J.is_keyed(args).alias("keyed"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT k AS id, CASE WHEN k % 13 = 0 THEN 'candidate timed out' WHEN k % 17 = 0 THEN 'candidate crashed: SIGSEGV' WHEN k % 19 = 0 THEN 'sanitizer: ' || repeat('x', 80) WHEN c % 23 = 0 THEN NULL
  WHEN k % 3 = 2 AND c % 2 = 0 THEN NULL WHEN k % 5 <> c % 5 THEN 'exit ' || (k % 5) || ', oracle ' || (c % 5) WHEN k % 3 = 1 AND c % 7 = 0 THEN 'property: a line is missing' WHEN k % 3 = 0 AND k % 10 <> c % 10 THEN 'stdout differs' END AS reason FROM r""")
def mismatches(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    no, text = F.lit(False), F.lit(None).cast("string")
    candidate = F.struct((k % 13 == 0).alias("timed_out"), F.when(k % 17 == 0, "SIGSEGV").alias("signal"), F.when(k % 19 == 0, F.repeat(F.lit("x"), 200)).alias("sanitizer"), (k % 5).alias("exit_code"), (k % 10).cast("string").alias("stdout"))
    oracle = F.struct(no.alias("timed_out"), F.when(c % 23 == 0, "SIGABRT").alias("signal"), text.alias("sanitizer"), (c % 5).alias("exit_code"), (c % 10).cast("string").alias("stdout"))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), candidate.alias("candidate"), oracle.alias("oracle"), _pick(["golden", "property:shuffle", "none"], k % 3).alias("policy"), (c % 2 == 0).alias("loose_exit"), F.when(c % 7 == 0, "a line is missing").alias("property"))
    return rows.select("id", J.mismatch().alias("reason"))


@query()
def mutated_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    return J.mutated(rows, 7)


@query("SELECT doc_id AS id, line AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL) WHERE i = 1")
def minimized_inputs(spark, sf_dir):
    """Every half deviates that holds the first line, so that line alone is left."""
    from tallyloom.plans.shared import written

    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    cases = d.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("lines"))
    out = J.minimized(cases, lambda halves: halves.filter(F.exists("lines", lambda x: x["i"] == 0)), written)
    return out.select("id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("lines"))


@query("""SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS ord, 'case' || o_orderkey AS name, 'FAIL' AS verdict FROM orders""")
def reported_failures(spark, sf_dir):
    entry = F.array(F.concat(F.lit("case"), F.col("o_orderkey").cast("string")), F.lit("FAIL"), F.lit("a detail"))
    reports = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e")))).alias("f"))
    payload = F.to_json(F.struct(F.transform("f", lambda x: x["e"]).alias("failures")))
    return J.report_failures(reports.select("o_custkey", payload.alias("payload")), ["o_custkey"])


@query("SELECT o_custkey, count(*) + sum(o_orderkey % 4)::BIGINT AS cases FROM orders GROUP BY 1")
def reported_cases(spark, sf_dir):
    reports = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("PASS"), F.sum(F.col("o_orderkey") % 4).alias("SKIP"))
    return reports.select("o_custkey", F.to_json(F.struct(F.struct("PASS", "SKIP").alias("counts"))).alias("payload")).select("o_custkey", J.report_case_count().alias("cases"))


@query("""SELECT p_name || p_partkey AS name, 'not declared' AS problem FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0
UNION ALL SELECT p_name || p_partkey, 'separately maintained, but generated' FROM part WHERE p_partkey % 35 = 0""")
def inventory_check(spark, sf_dir):
    names = lambda n: table(spark, sf_dir, "part").filter(f"p_partkey % {n} = 0").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"))
    return J.inventory_problems(names(1), names(3), names(5), names(7))


@query("""SELECT (SELECT count(*) FROM part WHERE p_size % 3 = 0) AS semantic, (SELECT count(*) FROM part WHERE p_size % 3 <> 0) AS cosmetic, (SELECT count(*) FROM part WHERE p_partkey % 35 = 0) AS inventory, false AS reproducible""")
def suites_compared(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return J.suite_comparison(p.select((F.col("p_size") % 3 == 0).alias("semantic")), p.filter("p_partkey % 35 = 0"))


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'no oracle' ELSE 'model and oracle differ' END AS problem FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 9 = 0 OR doc_id % 4 = 0 AND text <> '')""")
def derivations(spark, sf_dir):
    k, t = F.col("doc_id"), F.col("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode(t, "UTF-8").alias("model"), F.when(k % 9 != 0, F.encode(F.when(k % 4 == 0, F.reverse(F.concat(t, F.lit("")))).otherwise(t), "UTF-8")).alias("oracle"), F.when(k % 7 == 0, "known").alias("exempt_reason"))
    return J.derivation_problems(rows.withColumn("oracle", F.when((k % 4 == 0) & (k % 9 != 0) & (F.length(F.decode("model", "UTF-8")) > 0), F.lit(bytearray(b"?"))).otherwise(F.col("oracle"))), ["doc_id"])


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'was not rejected' WHEN n_nationkey % 3 = 1 THEN '' ELSE 'wrote to stdout; no diagnostic' END AS problems FROM nation")
def probe_verdicts(spark, sf_dir):
    k = F.col("n_nationkey")
    probes = table(spark, sf_dir, "nation").select("n_nationkey", F.when(k % 3 == 0, 0).otherwise(2).alias("exit_code"), F.when(k % 3 == 2, "x").otherwise("").alias("stdout"), F.when(k % 3 == 2, "").otherwise("bad option").alias("stderr"))
    return probes.select("n_nationkey", U.probe_problems().alias("problems"))


@query("SELECT n_regionkey, bool_and(n_nationkey % 3 <> 0) AS rejected_all, CASE WHEN bool_or(n_nationkey % 3 = 0) THEN 'was not rejected' ELSE '' END AS problems FROM nation GROUP BY 1")
def boundaries(spark, sf_dir):
    k = F.col("n_nationkey")
    probes = table(spark, sf_dir, "nation").select("n_regionkey", F.when(k % 3 == 0, 0).otherwise(2).alias("exit_code"), F.lit("").alias("stdout"), F.lit("bad option").alias("stderr"))
    return U.boundary_ok(probes, ["n_regionkey"]).select("n_regionkey", "rejected_all", F.array_join("problems", ",").alias("problems"))


@query("""SELECT p_partkey, mode, CASE mode WHEN 'pipe' THEN '.p' WHEN 'redirect' THEN '.r' ELSE '' END AS suffix FROM (SELECT p_partkey, unnest(CASE p_size % 3 WHEN 0 THEN ['file', 'pipe'] WHEN 1 THEN ['redirect'] ELSE ['file'] END) AS mode FROM part)""")
def input_modes(spark, sf_dir):
    n = F.col("p_size") % 3
    modes = F.when(n == 0, _list(["file", "pipe"])).when(n == 1, _list(["redirect"])).otherwise(F.array().cast("array<string>"))
    return U.case_modes(table(spark, sf_dir, "part").select("p_partkey", modes.alias("stdin_modes"))).select("p_partkey", "mode", "suffix")


TURNED = "translate(p_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'hijklmnopqrstuvwxyzabcdefgHIJKLMNOPQRSTUVWXYZABCDEFG5678901234')"


@query(f"SELECT p_type, 'heldout-c' || p_partkey AS name, 'c' || p_partkey AS dual_of, {TURNED} AS stdin FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def heldout_cases(spark, sf_dir):
    cases = table(spark, sf_dir, "part").select("p_type", "p_partkey", F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_name").alias("stdin"))
    return U.heldout_duals(cases, ["p_type"], ["p_partkey"]).select("p_type", "name", "dual_of", "stdin")


@query("""WITH l AS (SELECT n_regionkey AS r, n_nationkey AS k, sum(CASE WHEN n_nationkey % 4 = 0 THEN 3 ELSE 1 END) OVER (ORDER BY n_nationkey) AS x FROM nation)
SELECT CAST(k AS INTEGER) AS pos, n, n > 0 AND n >= coalesce(lag(n) OVER (ORDER BY k), 0) AS ok FROM (SELECT k, (k * 7) % 10 AS n FROM l)""")
def coverage_of_checkpoints(spark, sf_dir):
    k = F.col("n_nationkey")
    return U.monotone_coverage(table(spark, sf_dir, "nation").select(k.alias("pos"), (k * 7 % 10).alias("n"))).select("pos", "n", "ok")


@query("""WITH e AS (SELECT s_nationkey AS g, 'p' || s_suppkey AS path, s_suppkey % 4 AS m FROM supplier WHERE s_suppkey % 5 <> 0), a AS (SELECT s_nationkey AS g, 'p' || s_suppkey AS path, s_suppkey % 8 AS m FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT g, path, CASE WHEN a.m IS NULL THEN 'missing' WHEN e.m IS NULL THEN 'unexpected' ELSE 'differs' END AS problem FROM e FULL JOIN a USING (g, path) WHERE e.m IS DISTINCT FROM a.m""")
def tree_differences(spark, sf_dir):
    k = F.col("s_suppkey")
    tree = lambda n, mode: table(spark, sf_dir, "supplier").filter(k % n != 0).select(F.col("s_nationkey").alias("g"), F.concat(F.lit("p"), k.cast("string")).alias("path"), F.lit("file").alias("type"), (k % mode).alias("mode"), F.lit(None).cast("string").alias("target"))
    return U.tree_diff(tree(5, 4), tree(7, 8), ["g"])


@query("SELECT 'p' || s_suppkey AS flat_name, CASE WHEN s_suppkey % 5 = 0 THEN 'A' WHEN s_suppkey % 3 = 0 THEN 'M' ELSE '=' END AS status, sha256(CAST(s_suppkey AS VARCHAR)) AS sha256 FROM supplier")
def captured_files(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), k).alias("flat_name"), F.sha2(k, 256).alias("sha256"), F.col("s_suppkey").alias("k"))
    before = s.filter("k % 5 <> 0").withColumn("sha256", F.when(F.col("k") % 3 == 0, "old").otherwise(F.col("sha256"))).drop("k")
    return K.capture_table(before, s.drop("k"))


@query("""SELECT 'c' || p_partkey AS name, 'exit 0 without a line' AS problem FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'c' || p_partkey, 'exit 1 with output' FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT 'c' || p_partkey, 'exit 2 without a diagnostic' FROM part WHERE p_partkey % 4 = 2""")
def frozen_case_problems(spark, sf_dir):
    n = F.col("p_partkey") % 4
    out = F.base64(F.encode(F.when(n.isin(0, 2), "").otherwise("x\n"), "UTF-8"))
    cases = table(spark, sf_dir, "part").select(
        F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("name"), _list(["-i", "x"]).alias("args"), _list(["-i"]).alias("flags"), F.array().cast("array<string>").alias("absent_flags"), F.lit("golden").alias("check"),
        F.when(n == 3, 0).otherwise(n).cast("int").alias("exit_code"), out.alias("stdout_b64"), F.lit("empty").alias("stderr_class"),
    )
    return K.case_problems(cases)


@query("""SELECT user_id AS run, 'repeated case ids' AS problem FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) <> count(DISTINCT event_type)""")
def repeated_cases(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("user_id is not null").select(F.lit("all").alias("space"), F.col("user_id").alias("run"), F.col("event_type").alias("case_id"))
    return B.trace_problems(e, ["space"]).drop("space")


# trees and modes


TREE = "SELECT s_suppkey AS k, '/r/d' || s_nationkey || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '/f' || s_suppkey END AS path FROM supplier"


def _tree(spark, sf_dir):
    """Links to the next supplier's file, or in a chain."""
    k = F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "symlink").otherwise("file")
    return table(spark, sf_dir, "supplier").select(F.format_string("/r/f%d", k).alias("path"), kind.alias("type"), F.lit(0o644).alias("mode"), F.when(k % 3 == 0, F.format_string("f%d", k + F.when(k % 6 == 0, 1).otherwise(3))).alias("target"))


@query("""WITH s AS (SELECT s_suppkey AS k, (SELECT max(s_suppkey) FROM supplier) AS top FROM supplier),
t AS (SELECT k, top, CASE WHEN k % 3 <> 0 THEN k WHEN k % 6 = 0 THEN k + 1 ELSE k + 4 END AS leads FROM s)
SELECT '/r/f' || k AS path, CASE WHEN k % 6 = 3 AND k + 3 > top THEN NULL WHEN leads <= top THEN '/r/f' || leads END AS resolved FROM t""")
def resolved_links(spark, sf_dir):
    return FS.resolve_links(_tree(spark, sf_dir))


@query("SELECT '/r/f' || s_suppkey AS path, 'f' || s_suppkey AS name FROM supplier")
def listed_folder(spark, sf_dir):
    extra = spark.createDataFrame([("/r", "dir", 0o755, None), ("/r/f1/below", "file", 0o644, None), ("/rx", "file", 0o644, None)], "path string, type string, mode int, target string")
    return FS.children(_tree(spark, sf_dir).unionByName(extra), "/r/").select("path", "name").filter("path <> '/r/f1/below'")


@query("SELECT '/r/f' || s_suppkey AS path, CASE WHEN s_suppkey % 3 = 0 THEN 'link' ELSE '0644' END AS mode FROM supplier")
def mode_snapshot(spark, sf_dir):
    return FS.snapshot(_tree(spark, sf_dir))


@query("""SELECT '/r/f' || s_suppkey AS path, 'missing' AS problem FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT '/r/f' || s_suppkey, 'mode changed' FROM supplier WHERE s_suppkey % 7 = 0""")
def created_folders(spark, sf_dir):
    k = F.col("s_suppkey")
    path = F.format_string("/r/f%d", k)
    s = table(spark, sf_dir, "supplier").select(k, path.alias("path"))
    before = s.select("path", F.lit("dir").alias("type"), F.lit(0o755).alias("mode"))
    after = s.select("path", F.when(k % 5 == 0, "file").otherwise("dir").alias("type"), F.when(k % 7 == 0, 0o700).otherwise(0o755).alias("mode"))
    return FS.created_problems(before, after, s.select("path"), s.select("path"))


@query("""SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'oops ' || s_suppkey ELSE 'mode of ''/x/' || s_suppkey || ''' retained as 0644 (rw-r--r--)' END AS line, CASE WHEN s_suppkey % 4 = 0 THEN 'malformed' ELSE 'unknown path' END AS problem FROM supplier WHERE s_suppkey % 4 IN (0, 1)""")
def report_lines(spark, sf_dir):
    k = F.col("s_suppkey")
    path = F.when(k % 4 == 1, F.format_string("/x/%d", k)).otherwise(F.format_string("/r/f%d", k))
    line = F.when(k % 4 == 0, F.format_string("oops %d", k)).otherwise(M.report_line(path, F.lit(0o644), F.when(k % 4 == 2, 0o600).otherwise(0o644)))
    return FS.bad_report_lines(table(spark, sf_dir, "supplier").select(line.alias("line")), _tree(spark, sf_dir))


# syntax trees, edit scripts and distances


@query("""SELECT s_suppkey, feature, value::DOUBLE AS value FROM (SELECT s_suppkey, unnest(['file.kind.TranslationUnitDecl', 'function.f.kind.FunctionDecl', 'function.f.kind.CompoundStmt', 'function.f.kind.BinaryOperator', 'function.f.operator.BinaryOperator.+']) AS feature, unnest([1.0, 1.0, 1.0, 1.0 + s_suppkey % 3, 1.0 + s_suppkey % 3]) AS value FROM supplier)""")
def syntax_features(spark, sf_dir):
    """Trees of one function with some operators, and a function of an included file that doesn't count."""
    k = F.col("s_suppkey")
    operator = '{"kind":"BinaryOperator","opcode":"+","range":{"begin":{"line":3},"end":{"line":3}}}'
    body = F.concat(F.lit('{"kind":"CompoundStmt","inner":['), F.array_join(F.array_repeat(F.lit(operator), (1 + k % 3).cast("int")), ","), F.lit("]}"))
    tree = F.concat(F.lit('{"kind":"TranslationUnitDecl","range":{"begin":{"file":"./a.c"}},"inner":[{"kind":"FunctionDecl","name":"g","range":{"begin":{"includedFrom":{},"spellingLoc":{"file":"b.h"}}},"inner":[{"kind":"CompoundStmt"}]},{"kind":"FunctionDecl","name":"f","range":{"begin":{"file":"a.c","line":2}},"inner":['), body, F.lit("]}]}"))
    trees = table(spark, sf_dir, "supplier").select("s_suppkey", tree.alias("tree"), F.lit("a.c").alias("path"), F.lit(9).alias("lines"))
    return S.ast_features(S.ast_nodes(trees, ["s_suppkey"]), ["s_suppkey"]).drop("block")


@query("""SELECT s_suppkey, CAST(s_suppkey % 4 + 1 AS BIGINT) AS actions, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE round((s_suppkey % 4 + 1) / greatest(s_nationkey, 10, 1)::DOUBLE, 6) END AS magnitude, CASE WHEN s_suppkey % 5 = 0 THEN 'exit status 1' END AS problem FROM supplier""")
def edit_magnitudes(spark, sf_dir):
    k = F.col("s_suppkey")
    output = F.concat(F.lit("noise\n  Insert-Node x\n"), F.array_join(F.array_repeat(F.lit("=== delete y"), (k % 4).cast("int")), "\n"))
    diffs = table(spark, sf_dir, "supplier").select("s_suppkey", output.alias("output"), F.when(k % 5 == 0, 1).otherwise(0).alias("exit_code"), F.col("s_nationkey").alias("nodes_before"), F.lit(10).alias("nodes_after"), F.lit(False).alias("same"))
    return rounded(S.edit_magnitude(diffs, ["s_suppkey"]))


@query("""WITH e AS (SELECT event_type, value AS a, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS b, user_id::DOUBLE AS c FROM events),
p AS (SELECT event_type, 'a' AS l, 'b' AS r, a AS x, b AS y FROM e UNION ALL SELECT event_type, 'a', 'c', a, c FROM e UNION ALL SELECT event_type, 'b', 'c', b, c FROM e UNION ALL SELECT event_type, 'a', 'a', a, a FROM e UNION ALL SELECT event_type, 'b', 'b', b, b FROM e UNION ALL SELECT event_type, 'c', 'c', c, c FROM e),
f AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL),
k AS (SELECT event_type, l, r, rank() OVER (PARTITION BY event_type, l, r ORDER BY x) + (count(*) OVER (PARTITION BY event_type, l, r, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY event_type, l, r ORDER BY y) + (count(*) OVER (PARTITION BY event_type, l, r, y) - 1) / 2.0 AS y FROM f),
h AS (SELECT event_type, l, r, count(*) AS n, CASE WHEN l = r THEN 1.0 ELSE round(corr(x, y), 6) END AS rho FROM k GROUP BY event_type, l, r)
SELECT event_type, l AS "left", r AS "right", n, rho FROM h UNION ALL SELECT event_type, r, l, n, rho FROM h WHERE l <> r""")
def spearman_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("a"), F.get_json_object("props", "$.k").cast("double").alias("b"), F.col("user_id").cast("double").alias("c"))
    return rounded(D.spearman_matrix(e, ["event_type"], ["a", "b", "c"]))


@query("""WITH s AS (SELECT label, count(*) AS n, max(vec_id) AS m FROM embeddings WHERE vec_id % 3 <> 0 GROUP BY label)
SELECT e.vec_id AS run, CASE WHEN vec_id % 3 <> 0 THEN e.label END AS family_id, CASE WHEN vec_id % 3 <> 0 THEN n END AS family_size, CASE WHEN vec_id % 3 <> 0 THEN vec_id = m END AS is_medoid FROM embeddings e JOIN s USING (label)""")
def clustered_runs(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.lit(1).alias("space"), F.col("vec_id").alias("run"), F.col("label").alias("family"))
    labels = v.filter("run % 3 <> 0")
    medoids = labels.groupBy("space", "family").agg(F.max("run").alias("medoid"))
    return D.decorated(v.select("space", "run"), labels, medoids, ["space"]).drop("space")


@query()
def linkage(spark, sf_dir):
    from tallyloom.operators.cluster import linkage_table
    from tallyloom.plans.family_queries import vectors

    return linkage_table(vectors(spark, sf_dir), ["space"]).drop("space")


# wide rows of reports: each input column is the number of orders of a status plus its place

METRICS = [*paper.RELIABILITY.values(), *paper.STRUCTURE.values()]
DESCRIBED = [*paper.DESCRIPTION.values(), *paper.MAINTENANCE.values()]


def _summary(spark, sf_dir, names):
    n = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return n.select(F.lit("sort").alias("issue"), F.col("o_orderstatus").alias("checkpoint"), F.lit("m").alias("model"), F.lit("0.5").alias("temperature"), F.col("n").alias("population_n"), *[(F.col("n") + i).cast("double").alias(c) for i, c in enumerate(names)])


ORDERS = "WITH n AS (SELECT o_orderstatus AS s, count(*)::DOUBLE AS n FROM orders GROUP BY 1) SELECT 'sort' AS \"Issue\", s AS \"Checkpoint\", 'm' AS \"Model\", '0.5' AS \"Temp\", "
STRUCTURE = """n + 13 AS "Architecture Population N", n + 14 AS "Effective Architecture Families", n + 15 AS "Dominant Architecture Family Share", n + 16 AS "Mean Pairwise Architecture Distance",
  n + 17 AS "Strategy Population N", n + 18 AS "Effective Strategy Families", n + 19 AS "Dominant Strategy Family Share", n + 20 AS "Mean Pairwise Strategy Distance", n + 21 AS "Diversity K Max" FROM n"""


@query(ORDERS + """'current_experiment' AS "Reliability Scope", n::BIGINT AS "Population N", CAST(NULL AS DOUBLE) AS "Lineages Started", CAST(NULL AS DOUBLE) AS "Lineages Completed", CAST(NULL AS DOUBLE) AS "Lineage Completion Rate",
  n AS "N Attempts", n + 1 AS "Valid Agent Trials", n + 2 AS "Infrastructure Failures", n + 3 AS "Infrastructure Attrition Rate", n + 4 AS "Successful Runs", n + 5 AS "End-to-End Success Rate", n + 6 AS "Conditional Agent Success Rate",
  n + 7 AS "Initial Public Success Rate", n + 8 AS "Final Public Success Rate", n + 9 AS "Repair Recovery Rate", n + 10 AS "Pass@1", n + 11 AS "Pass@5", n + 12 AS "Pass@10", """ + STRUCTURE)
def paper_metrics(spark, sf_dir):
    return paper.metrics_row(_summary(spark, sf_dir, METRICS))


@query(ORDERS + """'parent_lineage_experiment' AS "Reliability Scope", n::BIGINT AS "Population N", n::BIGINT AS "Lineages Started", floor(n / 2)::BIGINT AS "Lineages Completed", 0.5::DOUBLE AS "Lineage Completion Rate",
  n::BIGINT AS "N Attempts", CAST(NULL AS DOUBLE) AS "Valid Agent Trials", CAST(NULL AS DOUBLE) AS "Infrastructure Failures", CAST(NULL AS DOUBLE) AS "Infrastructure Attrition Rate", floor(n / 2)::BIGINT AS "Successful Runs", 0.5::DOUBLE AS "End-to-End Success Rate",
  CAST(NULL AS DOUBLE) AS "Conditional Agent Success Rate", CAST(NULL AS DOUBLE) AS "Initial Public Success Rate", CAST(NULL AS DOUBLE) AS "Final Public Success Rate", CAST(NULL AS DOUBLE) AS "Repair Recovery Rate",
  round(floor(n / 2) / n, 6) AS "Pass@1", round(1 - list_product(list_transform(range(5), lambda i: (n - floor(n / 2) - i) / (n - i))), 6) AS "Pass@5", round(1 - list_product(list_transform(range(10), lambda i: (n - floor(n / 2) - i) / (n - i))), 6) AS "Pass@10", """ + STRUCTURE)
def paper_parent(spark, sf_dir):
    final = paper.metrics_row(_summary(spark, sf_dir, METRICS), survivors=True)
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("Checkpoint")).agg(F.count("*").alias("lineages_started"))
    reliability = n.withColumns({"lineages_completed": F.floor(F.col("lineages_started") / 2), "lineage_completion_rate": F.lit(0.5)})
    out = paper.parent_row(final, reliability, ["Checkpoint"])
    return out.withColumns({f"Pass@{k}": F.round(f"Pass@{k}", 6) for k in (1, 5, 10)})


@query(ORDERS + """n AS "Raw Architecture Families", n + 1 AS "Architecture Family-Discovery AUC@K", n + 2 AS "Architecture Vendi Score", n + 3 AS "Raw Strategy Families", n + 4 AS "Strategy Family-Discovery AUC@K", n + 5 AS "Strategy Vendi Score",
  n + 6 AS "Exact Unique Rate", n + 7 AS "Exact Modal Share", n + 8 AS "Mean Repair Loops", n + 9 AS "Median Repair Loops", n + 10 AS "Max Repair Loops", n + 11 AS "Mean LLM Invocations", n + 12 AS "Mean Repair LLM Runtime (s)",
  n + 13 AS "Mean Total Runtime (s)", n + 14 AS "Median Total Runtime (s)", n + 15 AS "Mean Source LOC", n + 16 AS "Median Source LOC", n + 17 AS "SD Source LOC", n + 18 AS "Source LOC CV", n + 19 AS "Mean Source Bytes",
  n + 20 AS "Mean Lines Edited", n + 21 AS "Mean Files Edited", n + 22 AS "Mean Functions Edited", n + 23 AS "Mean Functions Created", n + 24 AS "Mean Functions Deleted", n + 25 AS "Mean Normalized GumTree Edit-Action Magnitude",
  'baseline_backed_experiment' AS "Maintenance Change Scope" FROM n""")
def paper_description(spark, sf_dir):
    return paper.descriptive_row(_summary(spark, sf_dir, DESCRIBED))


# further selections and sources


@query("SELECT p_partkey::VARCHAR AS name, CASE p_size % 3 WHEN 0 THEN '-r' ELSE '-u' END AS flags FROM part")
def suites_written(spark, sf_dir):
    """Suites as JSON files, one object and one bare list, read back as cases."""
    path, p = _new(spark, "suites"), table(spark, sf_dir, "part")
    case = F.struct(F.col("p_partkey").cast("string").alias("name"), F.array(F.when(F.col("p_size") % 3 == 0, "-r").otherwise("-u")).alias("flags"))
    for i, name in enumerate(("object", "list")):
        listed = p.filter(f"p_partkey % 2 = {i}").groupBy((F.col("p_partkey") % 20).alias("g")).agg(F.collect_list(case).alias("cases"))
        text = F.to_json(F.struct("cases")) if name == "object" else F.to_json("cases")
        listed.select("g", text.alias("value")).repartition("g").write.partitionBy("g").text(f"{path}/{name}")
    cases = [files.read_suites(spark, f"{path}/{name}/*/*.txt") for name in ("object", "list")]
    return cases[0].unionByName(cases[1]).select("name", F.array_join("flags", ",").alias("flags"))


@query("""WITH c AS (SELECT p_partkey AS run, CASE p_size % 4 WHEN 0 THEN 'parse_x' WHEN 1 THEN 'work' WHEN 2 THEN 'usage' ELSE 'fold' END || p_size AS name, CASE p_partkey % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'edited' ELSE 'deleted' END AS kind FROM part)
SELECT run, name, kind FROM c WHERE kind <> 'deleted' AND (NOT regexp_matches(name, '(?i)(parse|arg|opt|usage)') OR name = 'usage2')
UNION ALL SELECT run, 'main', 'baseline' FROM c""")
def strategy_functions(spark, sf_dir):
    from tallyloom.operators import source_features as SF

    n, k = F.col("p_size") % 4, F.col("p_partkey") % 3
    name = F.concat(F.when(n == 0, "parse_x").when(n == 1, "work").when(n == 2, "usage").otherwise("fold"), F.col("p_size").cast("string"))
    changes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run"), name.alias("name"), F.when(k == 0, "created").when(k == 1, "edited").otherwise("deleted").alias("kind"))
    return SF.strategy_functions(changes, spark.createDataFrame([("main",), ("get_opt",)], "name string"), forced=["usage2"])


@query("""SELECT p_partkey AS run, 'function.' || CASE WHEN p_size % 2 = 0 THEN 'helper_0' ELSE 'main' END || '.kind.if' AS feature, (2.0 + p_size)::DOUBLE AS value FROM part WHERE p_size % 3 <> 0""")
def strategy_features(spark, sf_dir):
    from tallyloom.operators import source_features as SF

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run"), F.col("p_size").alias("s"))
    own = F.when(F.col("s") % 2 == 0, "fold").otherwise("main")
    delta = p.select("run", F.concat(F.lit("function."), own, F.lit(".kind.if")).alias("feature"), F.explode(F.array(F.lit(2.0), F.col("s").cast("double"))).alias("value"))
    delta = delta.unionByName(p.select("run", F.lit("file.kind.if").alias("feature"), F.lit(9.0).alias("value"))).unionByName(p.select("run", F.lit("function.other.kind.if").alias("feature"), F.lit(9.0).alias("value")))
    canonical = p.filter("s % 2 = 0").select("run", F.lit("fold").alias("name"), F.lit("helper_0").alias("canonical"))
    allowed = p.filter("s % 3 <> 0").select("run", F.explode(_list(["helper_0", "main"])).alias("name"))
    return SF.strategy_features(delta, allowed, canonical)


LADDER = [("c0", 0, ["-n"]), ("c1", 1, ["-r", "-u"]), ("c2", 2, ["-i"])]


@query("""WITH c AS (SELECT 'k' || p_partkey AS name, CASE p_size % 3 WHEN 0 THEN '-r' WHEN 1 THEN '-n' ELSE '-x' END AS flag, p_partkey % 5 = 0 AS again FROM part)
SELECT name, 'repeated name' AS problem FROM c WHERE again UNION ALL SELECT name, 'flag outside of the ladder: -x' FROM c WHERE flag = '-x' UNION ALL SELECT name, 'flag outside of the ladder: -x' FROM c WHERE flag = '-x' AND again""")
def corpus_contract(spark, sf_dir):
    n = F.col("p_size") % 3
    cases = table(spark, sf_dir, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("name"), F.array(F.when(n == 0, "-r").when(n == 1, "-n").otherwise("-x")).alias("flags"), (F.col("p_partkey") % 5 == 0).alias("again"))
    ladder = U.availability(spark.createDataFrame(LADDER, "checkpoint string, pos int, flags array<string>"))
    return K.corpus_problems(cases.drop("again").unionByName(cases.filter("again").drop("again")), ladder.select("checkpoint", "pos", "allowed"))


@query("""WITH l AS (SELECT unnest(['c0', 'c1', 'c2']) AS checkpoint, unnest([['-n'], ['-n', '-r', '-u'], ['-i', '-n', '-r', '-u']]) AS allowed),
c AS (SELECT 'k' || p_partkey AS name, CASE p_size % 3 WHEN 0 THEN ['-r'] WHEN 1 THEN ['-i'] ELSE [] END AS absent, p_partkey % 2 = 0 AS live FROM part)
SELECT name, checkpoint, live, NOT list_has_any(absent, allowed) AS expected FROM c, l WHERE len(absent) > 0 AND live <> NOT list_has_any(absent, allowed)""")
def premature_cases(spark, sf_dir):
    n = F.col("p_size") % 3
    absent = F.when(n == 0, _list(["-r"])).when(n == 1, _list(["-i"])).otherwise(F.array().cast("array<string>"))
    cases = table(spark, sf_dir, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("name"), absent.alias("absent_flags"), (F.col("p_partkey") % 2 == 0).alias("live"))
    return U.premature_cases(cases, spark.createDataFrame(LADDER, "checkpoint string, pos int, flags array<string>"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS ord, CAST(line_no AS INTEGER) AS line_no, line AS out, false AS is_error FROM l WHERE doc_id % 5 > 1 AND NOT (line_no = n - 1 AND line = '') AND contains(line, 'the')
UNION ALL SELECT doc_id, 0, 'd' || doc_id || CASE doc_id % 5 WHEN 0 THEN ': Is a directory' ELSE ': No such file or directory' END, true FROM documents WHERE doc_id % 5 < 2""")
def searched_operands(spark, sf_dir):
    """Each document as an operand; every fifth is a folder, and every fifth isn't there."""
    from tallyloom.operators import lines as N

    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("operand"))
    kind = F.when(F.col("doc_id") % 5 == 0, "dir").when(F.col("doc_id") % 5 > 1, "file")
    lines = N.explode_lines(d.select("operand", "text"), "text").withColumn("walk_ord", F.lit(0))
    return N.search_operands(lines, d.select(F.col("doc_id").alias("ord"), "operand", kind.alias("kind")), "the").drop("walk_ord")


@query("""SELECT CAST(CASE WHEN bool_or(doc_id % 5 < 2) THEN 2 WHEN bool_or(contains(text, 'the')) THEN 0 ELSE 1 END AS INTEGER) AS status FROM documents""")
def searched_status(spark, sf_dir):
    from tallyloom.operators import lines as N

    return N.search_status(searched_operands(spark, sf_dir))


@query("SELECT row_number() OVER (ORDER BY line, input) AS rank, line, input FROM (SELECT o_orderpriority || (o_orderkey % 50) AS line, 0 AS input FROM orders UNION ALL SELECT p_name, 1 FROM part UNION ALL SELECT '1-URGENT' || (s_suppkey % 50), 2 FROM supplier)")
def merged_lines(spark, sf_dir):
    from tallyloom.operators import orders as O

    a = table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", (F.col("o_orderkey") % 50).cast("string")).alias("line"))
    b = table(spark, sf_dir, "part").select(F.col("p_name").alias("line"))
    c = table(spark, sf_dir, "supplier").select(F.concat(F.lit("1-URGENT"), (F.col("s_suppkey") % 50).cast("string")).alias("line"))
    return ranked(O.merged([a, b, c]), "line", "input")


@query("""WITH c AS (SELECT o_orderkey, ['', 'ab', NULL][o_orderkey % 3 + 1] AS t, ['0', '4', NULL][o_custkey % 3 + 1] AS p, ['1q', '50%', '10', NULL][(o_orderkey + o_custkey) % 4 + 1] AS s FROM orders)
SELECT o_orderkey, CASE WHEN t = '' THEN 'C6_empty_tab' WHEN t = 'ab' THEN 'C7_multichar_tab' WHEN p = '0' THEN 'C13_parallel_zero' WHEN s = '1q' THEN 'C14_bad_size' END AS rule FROM c""")
def valued_options(spark, sf_dir):
    """Orders as calls of up to three options with a value each."""
    from tallyloom.operators.orders import validated

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    given = [F.struct(F.lit(o).alias("o"), _pick(v, i % len(v)).alias("v")) for o, v, i in (("-t", ["", "ab", None], k), ("--parallel", ["0", "4", None], c), ("-S", ["1q", "50%", "10", None], k + c))]
    some = F.filter(F.array(*given), lambda x: x["v"].isNotNull())
    calls = table(spark, sf_dir, "orders").select("o_orderkey", F.transform(some, lambda x: x["o"]).alias("flags"), F.map_from_entries(F.transform(some, lambda x: F.struct(x["o"].alias("key"), F.array(x["v"]).alias("value")))).alias("values"))
    return validated(calls, values="values").select("o_orderkey", "rule")


@query()
def random_options(spark, sf_dir):
    """A drawn call for each customer, with the rule that it breaks."""
    flags = ["-b", "-d", "-f", "-g", "-i", "-M", "-n", "-R", "-r", "-u", "-s"]
    return U.drawn_combinations(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", flags, 11).withColumn("flags", F.array_join("flags", " "))


@query()
def validated_pairs(spark, sf_dir):
    """The four distances of all pairs of twenty-five small sources."""
    k = F.col("n_nationkey")
    code = F.concat(F.lit("int main(void) { int x = "), k.cast("string"), F.lit("; "), F.repeat(F.lit("x = g(x); "), (k % 4).cast("int")), F.lit("return x; }"))
    n = table(spark, sf_dir, "nation").select(F.lit("all").alias("space"), k.cast("long").alias("run"), code.alias("s"), F.split(code, " ").alias("t"), F.when(k % 4 > 0, _list(["g"])).otherwise(F.array().cast("array<string>")).alias("c"))
    pairs = D.pairs_of(n.select("space", "run"), ["space"])
    for side in ("left", "right"):
        pairs = pairs.join(n.select(F.col("run").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in "stc"]), side)
    out = D.validation_distances(pairs, "s_left", "s_right", "t_left", "t_right", "c_left", "c_right")
    return rounded(out.select("left", "right", "lexical", "winnowing", "tree_distance", "call_set"))


@query("""WITH c AS (SELECT p_partkey AS k, p_size % 4 AS f, p_brand AS t, p_size % 3 AS c, p_partkey % 5 AS e FROM part),
u AS (SELECT unnest(['chmod', 'grep', 'mkdir', 'sort']) AS utility)
SELECT utility, min(k) AS k FROM u, c WHERE (utility = 'mkdir' OR e <> 0) GROUP BY utility, f, t, CASE WHEN utility IN ('sort', 'mkdir') THEN c END""")
def heldout_families(spark, sf_dir):
    """The cases with a dual, for each of four utilities; the lists come in both orders."""
    k, n = F.col("p_partkey"), F.col("p_size") % 4
    flags = F.array(F.lit("-a"), F.concat(F.lit("-"), n.cast("string")))
    gone = k % 5 == 0
    cases = table(spark, sf_dir, "part").select(
        k.alias("k"), F.when(k % 2 == 0, F.reverse(flags)).otherwise(flags).alias("flags"), F.array("p_brand").alias("tags"), (F.col("p_size") % 3).cast("string").alias("check"),
        F.when(gone, "").otherwise("eA==").alias("stdin_b64"), F.when(gone, "model").alias("model_only_reason"), F.when(gone, _list(["-x"])).otherwise(F.array().cast("array<string>")).alias("absent_flags"),
    )
    out = None
    for utility in sorted(U.FAMILIES):
        part = U.heldout_selection(cases, utility, ["k"]).select(F.lit(utility).alias("utility"), "k")
        out = part if out is None else out.unionByName(part)
    return out
