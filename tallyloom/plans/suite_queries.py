"""Case selection, verdicts, telemetry, logs, modes, trees and leaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import modes as M
from tallyloom.functions import text as X
from tallyloom.operators import filesystem as FS
from tallyloom.operators import leak as K
from tallyloom.operators import suites as U
from tallyloom.operators import telemetry as T
from tallyloom.plans.rate_queries import rounded
from tallyloom.plans.registry import query
from tallyloom.plans.shared import table

CASES = """
WITH c AS (SELECT p_partkey AS ord, p_name AS name, p_brand AS suite,
  list_filter(['-r', CASE WHEN p_size % 2 = 0 THEN '-f' END, CASE WHEN p_size % 5 = 0 THEN '-u' END], lambda x: x IS NOT NULL) AS flags,
  CASE WHEN p_size % 7 = 0 THEN ['-c'] WHEN p_size % 11 = 0 THEN ['-u'] ELSE [] END AS absent, CASE WHEN p_size % 13 = 0 THEN 'locale' ELSE 'plain' END AS tag FROM part)
"""


def cases(spark, sf_dir):
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    flags = F.array_compact(F.array(F.lit("-r"), F.when(size % 2 == 0, "-f"), F.when(size % 5 == 0, "-u")))
    absent = F.when(size % 7 == 0, F.array(F.lit("-c"))).when(size % 11 == 0, F.array(F.lit("-u"))).otherwise(F.array().cast("array<string>"))
    tag = F.when(size % 13 == 0, "locale").otherwise("plain")
    return p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_brand").alias("suite"), flags.alias("flags"), absent.alias("absent_flags"), F.array(tag).alias("tags"), F.array().cast("array<string>").alias("args"), size.alias("p_size"))


@query(CASES + """SELECT ord, CASE WHEN list_contains(flags, '-u') THEN 'flag not implemented' WHEN list_contains(absent, '-r') OR list_contains(absent, '-f') THEN 'needs a flag''s absence' WHEN tag = 'locale' THEN 'excluded tag' END AS reason FROM c""")
def case_select(spark, sf_dir):
    return U.select_cases(cases(spark, sf_dir), implemented=["-r", "-f"], excluded_tags=["locale"]).select("ord", "reason")


@query(CASES + "SELECT ord, CASE WHEN list_contains(flags, '-u') THEN 'flag not implemented' WHEN len(absent) > 0 THEN 'needs a flag''s absence' END AS reason FROM c")
def bundle_select(spark, sf_dir):
    return U.select_cases(cases(spark, sf_dir), implemented=["-r", "-f"], never_absent=True).select("ord", "reason")


@query(CASES + "SELECT printf('%s::%06d::%s', suite, ord, name) AS id FROM c")
def case_ids(spark, sf_dir):
    return cases(spark, sf_dir).select(U.case_id("suite", "ord", "name").alias("id"))


@query("""WITH l AS (SELECT DISTINCT n_regionkey AS pos, left(n_name, 1) AS flag FROM nation), f AS (SELECT flag, min(pos) AS first FROM l GROUP BY flag)
SELECT 'c' || pos AS checkpoint, (SELECT coalesce(string_agg('-' || flag, ',' ORDER BY flag), '') FROM f WHERE first <= pos) AS allowed, (SELECT coalesce(string_agg('-' || flag, ',' ORDER BY flag), '') FROM f WHERE first > pos) AS forbidden FROM (SELECT DISTINCT pos FROM l)""")
def boundary_matrix(spark, sf_dir):
    """Regions as checkpoints that introduce the first letters of their nations."""
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("pos")).agg(F.collect_set(F.concat(F.lit("-"), F.left("n_name", F.lit(1)))).alias("flags"))
    ladder = n.select(F.concat(F.lit("c"), F.col("pos").cast("string")).alias("checkpoint"), "pos", "flags")
    return U.availability(ladder).select("checkpoint", F.array_join("allowed", ",").alias("allowed"), F.array_join("forbidden", ",").alias("forbidden"))


VERDICTS = """
WITH v AS (SELECT event_id, user_id % 10 AS suite, CASE event_type WHEN 'error' THEN 'CRASH' WHEN 'click' THEN 'FAIL' WHEN 'purchase' THEN 'TIMEOUT' WHEN 'signup' THEN 'SKIP' ELSE 'PASS' END AS verdict FROM events)
"""


def results(spark, sf_dir):
    kind = F.col("event_type")
    verdict = F.when(kind == "error", "CRASH").when(kind == "click", "FAIL").when(kind == "purchase", "TIMEOUT").when(kind == "signup", "SKIP").otherwise("PASS")
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("suite"), verdict.alias("verdict"))


@query(VERDICTS + """, b AS (SELECT *, CASE verdict WHEN 'FAIL' THEN 1 WHEN 'TIMEOUT' THEN 2 ELSE 4 END AS severity FROM v WHERE verdict NOT IN ('PASS', 'SKIP')),
r AS (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY severity DESC, event_id) AS nth, greatest(count(*) OVER (PARTITION BY suite) - 5, 0) AS more FROM b)
SELECT suite, event_id, verdict, severity, CAST(nth AS INTEGER) AS nth, more FROM r WHERE nth <= 5""")
def severity_failures(spark, sf_dir):
    return U.top_failures(results(spark, sf_dir), ["suite"], 5, ["event_id"]).select("suite", "event_id", "verdict", "severity", "nth", "more")


@query(VERDICTS + """SELECT suite, count(*) FILTER (WHERE verdict = 'PASS') AS passed, count(*) FILTER (WHERE verdict <> 'SKIP') AS total,
  CASE WHEN count(*) FILTER (WHERE verdict NOT IN ('PASS', 'SKIP')) = 0 THEN 'CLEAN' ELSE count(*) FILTER (WHERE verdict NOT IN ('PASS', 'SKIP')) || ' problems' END AS verdict FROM v GROUP BY suite""")
def suite_summary(spark, sf_dir):
    return U.suite_summary(results(spark, sf_dir), ["suite"])


@query("""
SELECT event_id, CASE WHEN event_id % 29 = 0 THEN 'SKIP' WHEN event_id % 23 = 0 THEN 'TIMEOUT' WHEN event_id % 19 = 0 THEN 'SANITIZER' WHEN event_id % 17 = 0 THEN 'CRASH'
  WHEN event_id % 3 <> 0 OR value > 90 THEN CASE WHEN event_id % 5 = 0 THEN 'XFAIL' ELSE 'FAIL' END ELSE 'PASS' END AS verdict,
  array_to_string(list_filter([CASE WHEN event_id % 3 <> 0 THEN 'exit ' || (event_id % 3) || ' instead of 0' END, CASE WHEN value > 90 THEN 'stdout differs' END], lambda x: x IS NOT NULL), '; ') AS problems FROM events""")
def run_verdicts(spark, sf_dir):
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").withColumns({
        "needs_root_skip": i % 29 == 0, "timed_out": i % 23 == 0, "sanitizer": i % 19 == 0, "signal": F.when(i % 17 == 0, "SIGSEGV"), "allow_signals": F.array(F.lit("SIGPIPE")),
        "expected_exit": F.lit(0), "exit_code": (i % 3).cast("int"), "expected_stdout": F.lit("x"), "stdout": F.when(F.col("value") > 90, "y").otherwise("x"),
        "stderr": F.lit(""), "stderr_exact": F.lit(None).cast("string"), "stderr_b64": F.lit(None).cast("string"), "stderr_regex": F.lit(None).cast("string"), "stderr_class": F.lit("empty"), "expected_failure": i % 5 == 0,
    })
    verdict, problems = U.verdict()
    return rows.select("event_id", verdict.alias("verdict"), problems.alias("problems"))


@query("""
SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS steps, count(*) FILTER (WHERE role = 'user') AS user_messages,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS input_tokens, coalesce(sum(turn) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS output_tokens,
  coalesce(sum(greatest(0, length(text) - 100)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS duration_ms FROM conversations GROUP BY conv_id""")
def token_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = F.length("text")
    data = F.to_json(F.struct("role", F.struct(n.alias("input"), F.col("turn").alias("output")).alias("tokens"), F.struct(F.lit(100).alias("created"), n.alias("completed")).alias("time")))
    out = T.message_rollup(c.select("conv_id", data.alias("data")), ["conv_id"])
    return out.select("conv_id", "steps", "user_messages", "input_tokens", "output_tokens", "duration_ms")


@query("""
SELECT event_type AS tool, count(*) AS n, count(*) FILTER (WHERE event_id % 9 = 0) AS errors, sum(CASE WHEN event_id % 4 < 2 THEN event_id % 100 ELSE 0 END)::BIGINT AS ms FROM events GROUP BY event_type""")
def tool_rollup(spark, sf_dir):
    i = F.col("event_id")
    span = F.struct(F.lit(1000).alias("start"), F.when(i % 4 < 2, i % 100 + 1000).otherwise(F.lit(5)).alias("end"))
    data = F.to_json(F.struct(F.lit("tool").alias("type"), F.col("event_type").alias("tool"), F.struct(F.when(i % 9 == 0, "error").otherwise("completed").alias("status"), span.alias("time")).alias("state")))
    parts = table(spark, sf_dir, "events").select("user_id", data.alias("data"))
    return T.tool_totals(T.part_rollup(parts, ["user_id"]))


@query("""
SELECT conv_id, sum(greatest(10 * turn, length(text)))::BIGINT AS input_tokens, sum(turn)::BIGINT AS output_tokens, sum(greatest(10 * turn, length(text)) + turn)::BIGINT AS total_tokens FROM conversations GROUP BY conv_id""")
def log_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    entry = F.format_string('===== LLM INVOCATION %d =====\n{"prompt_tokens": %d, "completionTokens": %d}\ninput_tokens=%d\n', "turn", F.col("turn") * 10, "turn", F.length("text"))
    logs = c.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("log"))
    return T.log_tokens(logs, ["conv_id"], "log")


@query("""
SELECT event_id, 10 + event_id % 7 AS tests_run, CASE WHEN event_id % 3 = 0 THEN event_id % 5 ELSE 0 END AS failures, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS errors, event_id % 3 <> 0 AS ok,
  greatest(0, 10 + event_id % 7 - CASE WHEN event_id % 3 = 0 THEN event_id % 5 + 2 ELSE 0 END) AS passed FROM events""")
def test_log(spark, sf_dir):
    i = F.col("event_id")
    tail = F.when(i % 3 == 0, F.format_string("FAILED (failures=%d, errors=2)", i % 5)).otherwise("OK")
    log = F.format_string("===== VALIDATION LOOP 0: x =====\nRan 99 tests\nOK\n===== VALIDATION LOOP 1: y =====\nRan %d tests in 1s\n\n%s\n", 10 + i % 7, tail)
    return T.test_log(table(spark, sf_dir, "events").select("event_id", log.alias("log")), "log").drop("log")


@query("SELECT l_orderkey, coalesce(sum(CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS BIGINT) END), 0)::BIGINT AS added, sum(l_linenumber)::BIGINT AS deleted, count(*) AS files FROM lineitem GROUP BY l_orderkey")
def change_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    added = F.when(F.col("l_linenumber") == 3, "-").otherwise(F.col("l_quantity").cast("long").cast("string"))
    return T.change_metrics(li.select("l_orderkey", added.alias("added"), F.col("l_linenumber").cast("string").alias("deleted"), F.lit("f.c").alias("path")), ["l_orderkey"])


BITS = "(l_orderkey * 7 + l_linenumber * 131) % 4096"


@query(f"""
SELECT l_orderkey, l_linenumber, lpad(printf('%o', {BITS}), 4, '0') AS octal,
  array_to_string(list_transform([[6, 2048, 115], [3, 1024, 115], [0, 512, 116]], lambda s:
    CASE WHEN ({BITS} >> s[1]) & 4 > 0 THEN 'r' ELSE '-' END || CASE WHEN ({BITS} >> s[1]) & 2 > 0 THEN 'w' ELSE '-' END ||
    CASE WHEN {BITS} & s[2] > 0 THEN CASE WHEN ({BITS} >> s[1]) & 1 > 0 THEN chr(s[3]::INTEGER) ELSE upper(chr(s[3]::INTEGER)) END WHEN ({BITS} >> s[1]) & 1 > 0 THEN 'x' ELSE '-' END), '') AS symbolic
FROM lineitem""")
def mode_render(spark, sf_dir):
    mode = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % 4096).cast("int")
    return table(spark, sf_dir, "lineitem").withColumn("m", mode).select("l_orderkey", "l_linenumber", M.octal("m").alias("octal"), M.symbolic("m").alias("symbolic"))


@query(f"""
WITH m AS (SELECT l_orderkey, l_linenumber, CAST({BITS} AS INTEGER) AS m, l_linenumber % 2 = 0 AS d FROM lineitem),
a AS (SELECT *, (m & ~7) AS m1 FROM m), b AS (SELECT *, m1 | CASE WHEN d OR m1 & 73 > 0 THEN 146 + 73 ELSE 146 END AS m2 FROM a)
SELECT l_orderkey, l_linenumber, CAST(m2 & ~16 AS INTEGER) AS mode FROM b""")
def mode_apply(spark, sf_dir):
    mode = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % 4096).cast("int")
    rows = table(spark, sf_dir, "lineitem").withColumns({"m": mode, "d": F.col("l_linenumber") % 2 == 0})
    return rows.select("l_orderkey", "l_linenumber", M.changed("m", "o=,a+wX,g-w", "d").alias("mode"))


def url_tree(spark, sf_dir):
    """Paths of urls, with every folder above them, as a tree."""
    path = F.regexp_replace("url", r"^https?://|[?#].*$", "")
    clean = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", ""))
    parts = F.split(clean, "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = table(spark, sf_dir, "pages").select(F.explode(above).alias("path")).distinct()
    return rows.select("path", F.lit("dir").alias("type"), F.lit(0o755).alias("mode"), F.lit(None).cast("string").alias("target"))


URL_TREE = r"""
WITH c AS (SELECT '/' || regexp_replace(regexp_replace(regexp_replace(url, '^https?://|[?#].*$', '', 'g'), '/+', '/', 'g'), '/$', '') AS p FROM pages),
s AS (SELECT string_split(p, '/') AS s FROM c),
t AS (SELECT DISTINCT unnest(list_transform(range(2, len(s) + 1), lambda i: array_to_string(s[1:i], '/'))) AS path FROM s)
"""


@query(URL_TREE + "SELECT path, 'dir' AS type FROM t")
def fs_walk(spark, sf_dir):
    return FS.walk(url_tree(spark, sf_dir), "/").select("path", "type")


@query(URL_TREE + "SELECT path, '0755' AS mode FROM t")
def fs_snapshot(spark, sf_dir):
    return FS.snapshot(url_tree(spark, sf_dir))


@query("""
WITH n AS (SELECT item_id, text AS v FROM benchmark WHERE length(text) >= 12) SELECT doc_id, item_id FROM documents d JOIN n ON contains(d.text, n.v)""")
def leak_scan(spark, sf_dir):
    return K.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@query("""
WITH t AS (SELECT unnest(['d', 'd/a', 'd/b']) AS path, unnest([493, 420, 384]) AS mode)
SELECT n_nationkey::BIGINT AS id, path, CASE WHEN n_nationkey % 2 = 0 THEN mode ELSE 488 END AS mode, 0 AS status, '' AS diagnostics,
  CASE WHEN n_nationkey % 2 = 0 THEN 'mode of ''d'' retained as 0755 (rwxr-xr-x); mode of ''d/a'' retained as 0644 (rw-r--r--); mode of ''d/b'' retained as 0600 (rw-------)'
  ELSE 'mode of ''d'' changed from 0755 (rwxr-xr-x) to 0750 (rwxr-x---); mode of ''d/a'' changed from 0644 (rw-r--r--) to 0750 (rwxr-x---); mode of ''d/b'' changed from 0600 (rw-------) to 0750 (rwxr-x---)' END AS reports
FROM nation, t""")
def chmod_runs(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    trees = n.select("id", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(k).alias("type"), F.lit(m).alias("mode"), F.lit(None).cast("string").alias("target")) for p, k, m in (("d", "dir", 0o755), ("d/a", "file", 0o644), ("d/b", "file", 0o600))])).alias("x")).select("id", "x.*")
    calls = n.select("id", F.array(F.lit("-Rv"), F.when(F.col("id") % 2 == 0, "u=rwX,go-w").otherwise("0750"), F.lit("d")).alias("argv"))
    out = FS.chmod_invocations(trees, calls)
    return out.select("id", "path", "mode", F.array_join("reports", "; ").alias("reports"), F.array_join("diagnostics", "; ").alias("diagnostics"), "status")


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g') AS t FROM documents)
SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) - CASE WHEN t LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS INTEGER) AS lines FROM d""")
def physical_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.physical_lines("text").alias("lines"))


@query(r"""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey::DOUBLE WHEN o_orderkey % 4 = 1 THEN o_orderkey * 60.0 WHEN o_orderkey % 4 = 2 THEN o_orderkey * 3600.0 END AS seconds FROM orders""")
def durations(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(k.cast("string"), F.when(k % 4 == 0, "s").when(k % 4 == 1, "m").when(k % 4 == 2, "h").otherwise("x"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.duration_seconds(text).alias("seconds"))


@query("SELECT sha256(string_agg(r_name || chr(31) || sha256(r_name), chr(10) ORDER BY r_name || chr(31) || sha256(r_name))) AS bundle_sha256, count(*) AS members FROM region")
def bundle_fingerprint(spark, sf_dir):
    from tallyloom.operators.report import bundle_digest

    return bundle_digest(table(spark, sf_dir, "region"), "r_name", "r_name")


@query("""
WITH r AS (SELECT s_suppkey % 5 AS experiment, CASE WHEN s_suppkey % 2 = 0 THEN 'all' ELSE 'final' END AS population, s_suppkey AS written_at, s_name AS path FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 3 AND s_nationkey % 2 = (SELECT arg_min(s_nationkey % 2, (s_suppkey % 5, s_suppkey)) FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 3))
SELECT experiment, population, arg_max(path, written_at) AS path FROM r GROUP BY ALL""")
def paper_aggregate(spark, sf_dir):
    from tallyloom.operators.report import paper_aggregate

    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        F.when(k % 3 == 0, 6).otherwise(7).alias("schema_version"), (k % 4 != 3).alias("confirmatory"), (F.col("s_nationkey") % 2).alias("signature"), F.struct((k % 5).alias("e"), k).alias("experiment_key"),
        (k % 5).alias("experiment"), F.when(k % 2 == 0, "all").otherwise("final").alias("population"), k.alias("written_at"), F.col("s_name").alias("path"),
        F.lit("i").alias("issue"), F.lit("c").alias("checkpoint"), F.lit("m").alias("model"), (k % 3).cast("string").alias("temperature"),
    )
    return paper_aggregate(rows, 7, first_by="experiment_key").select("experiment", "population", "path")


@query("""
WITH a AS (SELECT count(*) AS n_attempts, count(*) FILTER (WHERE quality = 1) AS successes FROM documents LEFT JOIN labels USING (doc_id)), s AS (SELECT source, count(*) AS size FROM documents GROUP BY source)
SELECT n_attempts, successes, round(successes::DOUBLE / n_attempts, 6) AS end_to_end_rate, (SELECT count(*) FROM s) AS families, (SELECT round(exp(-sum(size / n_attempts * ln(size / n_attempts))), 6) FROM s) AS effective FROM a""")
def paper_row(spark, sf_dir):
    from tallyloom.operators import families as A
    from tallyloom.operators import reliability as R
    from tallyloom.operators.report import paper_row
    from tallyloom.plans.rate_queries import attempts

    rates = R.success_rates(attempts(spark, sf_dir), []).select("n_attempts", "successes", F.col("end_to_end_rate"))
    stats = A.family_stats(table(spark, sf_dir, "documents").select("source"), [], "source").select(F.col("raw_count").alias("families"), F.col("effective_count").alias("effective"))
    return rounded(paper_row(rates, stats))


def record_events(spark, sf_dir):
    """Conversations as lineage records: turns are stages (every fifth runs twice), every third one is finished."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("lineage"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("checkpoint"), (F.length("text") > 60).alias("success"), F.col("role").alias("reason"), (F.col("turn") * 10 + 1).alias("ts"))
    stages = c.withColumn("kind", F.lit("stage"))
    again = stages.filter("ts % 50 = 1").withColumns({"success": F.lit(True), "ts": F.col("ts") + 1})
    ids = c.select("lineage").distinct()
    none = [F.lit(None).cast("string").alias("checkpoint"), F.lit(None).cast("boolean").alias("success"), F.lit(None).cast("string").alias("reason")]
    init = ids.select("lineage", *none, F.lit(0).cast("long").alias("ts"), F.lit("init").alias("kind"))
    done = ids.filter("lineage % 3 = 0").select("lineage", none[0], F.lit(True).alias("success"), none[2], F.lit(1000).cast("long").alias("ts"), F.lit("finish").alias("kind"))
    return stages.unionByName(again).unionByName(init).unionByName(done)


@query("""
WITH s AS (SELECT conv_id AS lineage, turn, length(text) > 60 AS ok, role FROM conversations),
e AS (SELECT lineage, turn, ok, role, turn * 10 + 1 AS ts FROM s UNION ALL SELECT lineage, turn, true, role, turn * 10 + 2 FROM s WHERE (turn * 10 + 1) % 50 = 1),
l AS (SELECT lineage, turn, arg_max(ok, ts) AS ok FROM e GROUP BY lineage, turn),
p AS (SELECT lineage, count(*) FILTER (WHERE ok) AS passed FROM l GROUP BY lineage),
f AS (SELECT lineage, arg_max('c' || turn, ts) AS stage, arg_max(role, ts) AS reason FROM e WHERE NOT ok GROUP BY lineage)
SELECT p.lineage, CASE WHEN p.lineage % 3 = 0 THEN 'completed' WHEN stage IS NOT NULL THEN 'stopped' ELSE 'running' END AS state, passed AS checkpoints_completed,
  CASE WHEN p.lineage % 3 <> 0 THEN stage END AS failure_stage, CASE WHEN p.lineage % 3 <> 0 THEN reason END AS failure_reason FROM p LEFT JOIN f ON f.lineage = p.lineage""")
def record_states(spark, sf_dir):
    from tallyloom.operators.records import record_state

    order = spark.createDataFrame([(f"c{i}", i) for i in range(12)], "checkpoint string, pos int")
    return record_state(record_events(spark, sf_dir), order).select("lineage", "state", "checkpoints_completed", "failure_stage", "failure_reason")


@query("""
WITH a AS (SELECT r_regionkey, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_regionkey, 'n' || n_nationkey AS path, CASE WHEN n_nationkey % 5 = 0 THEN 'deleted' WHEN n_nationkey % 5 = 1 THEN 'modified' ELSE 'added' END AS change FROM a WHERE n_nationkey % 5 < 3""")
def changed_files(spark, sf_dir):
    from tallyloom.operators.contracts import changed_files

    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"), F.col("n_nationkey").alias("k"), F.sha2("n_name", 256).alias("sha256"))
    copies = n.filter("k % 5 <> 0").withColumn("sha256", F.when(F.col("k") % 5 == 1, "x").otherwise(F.col("sha256")))
    return changed_files(n.filter("k % 5 <> 2").drop("k"), copies.drop("k"), ["r_regionkey"])
