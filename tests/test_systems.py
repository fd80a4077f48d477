"""Modes, trees, suites, lineages, telemetry, sources and reports."""

import gzip
import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import modes as M
from tallyloom.operators import behavior as B
from tallyloom.operators import bundles
from tallyloom.operators import distance as D
from tallyloom.operators import filesystem as FS
from tallyloom.operators import leak as K
from tallyloom.operators import lineage as L
from tallyloom.operators import orders as O
from tallyloom.operators import report as P
from tallyloom.operators import security as S
from tallyloom.operators import suites as U
from tallyloom.operators import telemetry as T
from tallyloom.sources import files, sqlite


def test_mode_columns_equal_the_fold(spark):
    random.seed(2)
    changes = ["0750", "7", "u=rwX,go-w", "a+X", "o=", "+x", "u-x,a+X", "g=rX", "ug+rw,o-rwx"]
    rows = [(random.randrange(4096), bool(random.randrange(2))) for _ in range(60)]
    df = spark.createDataFrame(rows, "m int, d boolean")
    for change in changes:
        got = [r[0] for r in df.select(M.changed("m", change, "d")).collect()]
        assert got == [M.apply_change(m, M.parse_change(change), d) for m, d in rows], change
    assert M.parse_change("01234") is None and M.parse_change("u++w") is None and M.parse_change("+s") is None


def test_mode_rendering(spark):
    row = spark.range(1).select(M.symbolic(F.lit(0o4755)).alias("a"), M.symbolic(F.lit(0o1644)).alias("b"), M.octal(F.lit(0o44)).alias("c"), M.parse_octal(F.lit("0755")).alias("d"), M.parse_octal(F.lit("98")).alias("e"), M.report_line(F.lit("p"), F.lit(0o644), F.lit(0o600)).alias("f")).first()
    assert list(row) == ["rwsr-xr-x", "rw-r--r-T", "0044", 0o755, None, "mode of 'p' changed from 0644 (rw-r--r--) to 0600 (rw-------)"]
    assert M.mkdir_mode(None, 0o22) == 0o755 and M.mkdir_mode("u-w,g=s") == 0o2507 and M.mkdir_mode("u++w") == 0o777 and M.mkdir_mode("+t") == 0o1777 and M.mkdir_mode("x") is None


def test_chmod_and_mkdir():
    tree = {"d": {"type": "dir", "mode": 0o755, "target": None}, "d/a": {"type": "file", "mode": 0o644, "target": None}, "l": {"type": "symlink", "mode": 0o777, "target": "d/a"}}
    out, errors, status = FS.chmod_run(tree, ["-v", "600", "l", "no"])
    assert out == ["mode of 'd/a' changed from 0644 (rw-r--r--) to 0600 (rw-------)"] and status == 1 and len(errors) == 1
    assert FS.chmod_run(tree, ["-f", "600", "no"])[1:] == ([], 0)
    assert FS.chmod_run(tree, ["-R", "a-r", "d"])[2] == 1 and tree["d/a"]["mode"] == 0o600
    assert FS.chmod_run(tree, ["9z", "d"])[2] == 1
    tree = {"d": {"type": "dir", "mode": 0o755, "target": None}, "f": {"type": "file", "mode": 0o644, "target": None}}
    errors, status = FS.mkdir_run(tree, ["d", "x/y", "f/z", "n"])
    assert status == 1 and len(errors) == 3 and tree["n"]["mode"] == 0o755
    assert FS.mkdir_run(tree, ["p/q"], parents=True, mode="700") == ([], 0) and tree["p"]["mode"] == 0o755 and tree["p/q"]["mode"] == 0o700


def test_walk_and_links(spark):
    rows = [("d", "dir", 0o755, None), ("d/a", "dir", 0o000, None), ("d/a/x", "file", 0o644, None), ("d/a.txt", "file", 0o644, None), ("d/l", "symlink", 0o777, "a.txt"), ("d/m", "symlink", 0o777, "l"), ("d/loop", "symlink", 0o777, "loop")]
    tree = spark.createDataFrame(rows, "path string, type string, mode int, target string")
    assert [r.path for r in FS.walk(tree, "d").collect()] == ["d", "d/a", "d/a.txt"]
    open_tree = tree.withColumn("mode", F.lit(0o755))
    assert [r.path for r in FS.walk(open_tree, "d").collect()] == ["d", "d/a", "d/a/x", "d/a.txt"]
    assert [r.name for r in FS.children(tree, "d").collect()] == ["a", "a.txt", "l", "loop", "m"]
    got = {r.path: r.resolved for r in FS.resolve_links(tree).collect()}
    assert got["d/m"] == "d/a.txt" and got["d/loop"] is None and got["d"] == "d"


def test_suites(spark):
    assert {tuple(r.flags): r.rule for r in U.combination_frame(spark, ["-n", "-M", "-r"], 2).collect()} == {("-M", "-n"): "C1_mode_incompat", ("-M", "-r"): None, ("-n", "-r"): None}
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "name string, code int, text string")
    other = spark.createDataFrame([("b", 3, "y"), ("c", 1, "z")], "name string, code int, text string")
    assert sorted((r.name, r.kind, r.field) for r in U.case_diff(rows, other, ["name"], {"code": True, "text": False}).collect()) == [("a", "only_fresh", None), ("b", "differs", "code"), ("c", "only_committed", None)]
    modes = spark.createDataFrame([("a", ["file", "pipe"]), ("b", [])], "name string, stdin_modes array<string>")
    assert sorted(r.suffix for r in U.case_modes(modes).collect()) == ["", "", ".p"]
    probes = spark.createDataFrame([(0, 2, "", "bad option"), (0, 0, "x", "")], "c int, exit_code int, stdout string, stderr string")
    row = U.boundary_ok(probes, ["c"]).first()
    assert row.rejected_all is False and len(row.problems) == 1
    duals = spark.createDataFrame([("n", "f", 0, "abz 19"), ("m", "f", 1, "q")], "name string, family string, ord int, stdin string")
    assert [(r.name, r.stdin) for r in U.heldout_duals(duals, ["family"], ["ord"]).collect()] == [("heldout-n", "hig 64")]


def test_lineage_edges(spark):
    s = spark.createDataFrame([(1, 0, "a", True), (1, 1, "b", False), (1, 2, "c", True), (2, 0, "a", True), (2, 1, "b", True)], "lineage int, pos int, checkpoint string, success boolean")
    assert [(r.lineage, r.to_checkpoint) for r in L.transitions(s, []).collect()] == [(2, "b")]
    with pytest.raises(Exception, match="disagrees"):
        L.agreed(s, ["lineage"], "checkpoint").collect()
    states = spark.createDataFrame([("completed", None), ("running", None), (None, "x"), (None, None)], "status string, stop_reason string")
    assert [r[0] for r in states.select(L.classify()).collect()] == ["completed", "controller_interrupted", "stopped", "controller_interrupted"]


def test_security_without_measurement(spark):
    runs = spark.createDataFrame([("p", 1, True, 100), ("p", 2, False, 100)], "g string, run int, measured boolean, loc int")
    findings = spark.createDataFrame([("p", 1, 3, ["CWE-9", "CWE-20"])], "g string, run int, level int, cwe_ids array<string>")
    rollup = S.run_rollup(findings, runs, ["g"])
    got = {r.run: r for r in rollup.collect()}
    assert got[1]["n_findings"] == 1 and got[1]["per_kloc"] == 10.0 and got[1]["cwe_ids"] == ["CWE-20", "CWE-9"] and got[2]["n_findings"] is None
    assert S.population_rollup(rollup, ["g"]).first()["prevalence"] is None
    with pytest.raises(ValueError):
        S.check_config({"schema_version": True})


def test_traces(spark):
    a = spark.createDataFrame([("s", "r", "x", "PASS"), ("s", "r", "y", "FAIL")], "g string, run string, case_id string, verdict string")
    b = a.orderBy(F.desc("case_id"))
    get = lambda df, **k: B.trace_fingerprints(df, ["g"], **k).first()["fingerprint"]
    assert get(a) == get(b) and get(a) != get(a, domain="other") and get(a) != get(a, corpus=F.lit("c2"))
    two = a.unionByName(spark.createDataFrame([("s", "q", "x", "PASS")], a.schema))
    assert B.disagreement(two, ["g"]).first()["distance"] is None
    assert B.trace_problems(a.unionByName(a), ["g"]).count() == 1


def test_winnowing(spark):
    def brute(t, k, w=4):
        import hashlib

        g = [hashlib.sha256("\x1f".join(t[i : i + k]).encode()).hexdigest()[:16] for i in range(len(t) - k + 1)]
        return {min(g[i : i + w]) for i in range(max(1, len(g) - w + 1))}

    random.seed(4)
    rows = [([random.choice("abc") for _ in range(random.randint(1, 30))], [random.choice("abc") for _ in range(random.randint(1, 30))]) for _ in range(40)]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select(D.winnowing_distance("a", "b")).collect()]
    for (a, b), d in zip(rows, got, strict=True):
        k = max(1, min(5, len(a), len(b)))
        x, y = brute(a, k), brute(b, k)
        assert d == pytest.approx(1 - len(x & y) / len(x | y))


def test_leaks_in_both_ways(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some hidden needle text here"), (2, "nothing"), (3, None)], "d int, text string")
    needles = spark.createDataFrame([("n", "hidden needle"), ("short", "nothing")], "n string, v string")
    get = lambda: [tuple(r) for r in K.leaks(docs, needles, "d", "text", "n", "v").collect()]
    assert get() == [(1, "n")]
    monkeypatch.setattr(K, "ahocorasick", None)
    assert get() == [(1, "n")]
    monkeypatch.setattr(K, "BROADCAST_BYTES", -1)
    assert get() == [(1, "n")]
    assert K.searchable_forms(gzip.compress(b"abc"))[1] == b"abc"
    assert K.scannable_values(json.dumps({"a": ["c29tZSBsb25nIHRleHQgaGVyZQ==", 5]})) == ["c29tZSBsb25nIHRleHQgaGVyZQ==", "some long text here"]


def test_sources(spark, tmp_path):
    suite = {"cases": [{"name": "a", "flags": ["-r"], "args": ["-r"]}, {"name": "b"}]}
    (tmp_path / "s").mkdir()
    (tmp_path / "s/one.json").write_text(json.dumps(suite))
    with gzip.open(tmp_path / "s/two.json.gz", "wt") as f:
        json.dump([{"name": "c"}], f)
    (tmp_path / "s/MANIFEST.json").write_text("{}")
    got = sorted((r._suite, r._ordinal, r["name"]) for r in files.read_suites(spark, str(tmp_path / "s")).collect())
    assert got == [("one", 0, "a"), ("one", 1, "b"), ("two", 0, "c")]
    for i, body in enumerate(['{"status": "completed"}', "{broken"]):
        (tmp_path / f"run/lineage-{i}").mkdir(parents=True)
        (tmp_path / f"run/lineage-{i}/lineage.json").write_text(body)
    (tmp_path / "run/lineage-2").mkdir()
    (tmp_path / "run/lineage-2/other.txt").write_text("x")
    got = sorted((r.lineage, r.state) for r in files.read_lineages(spark, str(tmp_path / "run"), "status string").collect())
    assert got == [("lineage-0", "completed"), ("lineage-1", "controller_interrupted"), ("lineage-2", "controller_interrupted")]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as db:
        db.execute("create table session (id text, directory text, time_created integer, cost real)")
        db.executemany("insert into session values (?, ?, ?, ?)", [(f"s{i}", "w" if i % 2 else "v", i, i / 2) for i in range(25)])
    got = sorted(r.id for r in sqlite.sessions(spark, path, "w", 10).collect())
    assert got == sorted(f"s{i}" for i in range(11, 25, 2))


def test_logs(spark):
    log = "===== VALIDATION LOOP 0: a =====\nFAIL x::1\n===== VALIDATION LOOP 1: b =====\nFAIL: test_q (m)\nRan 3 tests\nFAILED (failures=1, errors=3)\n"
    df = spark.createDataFrame([(1, log)], "run int, log string")
    row = T.test_log(df, "log").first()
    assert (row.tests_run, row.failures, row.errors, row.passed, row.ok) == (3, 1, 3, 0, False)
    assert [(r.kind, r.name) for r in T.test_failures(df, ["run"], "log").collect()] == [("unittest", "test_q")]
    pairs = spark.createDataFrame([(1, "a\nb\n", "a\nc\nd\n")], "run int, x string, y string")
    assert tuple(T.line_churn(pairs, ["run"], "x", "y").first()) == (1, 2, 1)


def test_report_parts(spark, tmp_path):
    assert P.config_fingerprint({"a": 1, "n_lineages": 3}) == P.config_fingerprint({"n_lineages": 9, "a": 1}) != P.config_fingerprint({"a": 2})
    assert P.resolve_settings({"k": None}, {"k": 2}, {"k": 1, "j": 5}) == {"k": (2, "metadata"), "j": (5, "default")}
    P.write_json_document(str(tmp_path / "x.json"), {"b": float("nan"), "a": [1]})
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": [1], "b": None}
    assert P.fixed_gzip(b"x") == P.fixed_gzip(b"x")
    nested = spark.createDataFrame([((1, [1, 2]),)], "s struct<a:int,b:array<int>>")
    flat = P.flat_columns(nested)
    assert flat.columns == ["s.a", "s.b"] and list(flat.first()) == [1, "1;2"]
    assert "Started N = 3" in P.markdown_report("t", 3, [{"n": 2, "rate": None}])


def test_option_rules(spark):
    cases = [
        (["-n", "-M"], {}, 0, "C1_mode_incompat", 2), (["-r", "-s"], {}, 1, None, 0), (["-d", "-i", "-V"], {}, 0, None, 0), (["-n", "--sort"], {"--sort": ["month"]}, 0, "C1_mode_incompat", 2),
        (["-k"], {"-k": ["1n,1M"]}, 0, "C1_mode_incompat", 2), (["-k"], {"-k": ["1.2b,3.0"]}, 0, None, 0), (["-k"], {"-k": ["0"]}, 0, "C15_bad_key", 2), (["-k"], {"-k": ["1.0"]}, 0, "C15_bad_key", 2), (["-k"], {"-k": ["1,2,3"]}, 0, "C15_bad_key", 2),
        (["-c", "-C", "-o"], {}, 0, "C2_cC", 2), (["-c"], {}, 2, "C3_check_multifile", 2), (["--check", "-o"], {"--check": ["quiet"]}, 1, "C4_check_output", 2), (["--debug", "-o"], {}, 0, "C5_debug_incompat", 2),
        (["-t"], {"-t": ["a", "b"]}, 0, "C8_incompat_tabs", 2), (["-t"], {"-t": ["", ""]}, 0, "C6_empty_tab", 2), (["-t"], {"-t": ["ab"]}, 0, "C7_multichar_tab", 2), (["-t"], {"-t": ["é"]}, 0, "C7_multichar_tab", 2), (["-t"], {"-t": ["\\0"]}, 0, None, 0),
        (["-o"], {"-o": ["x", "y"]}, 0, "C9_multi_output", 2), (["-o"], {"-o": ["x", "x"]}, 0, None, 0), (["--compress-program"], {"--compress-program": ["x", "y"]}, 0, "C10_multi_compress", 2), (["--random-source"], {"--random-source": ["x", "y"]}, 0, "C10_multi_randsrc", 2),
        (["--batch-size"], {"--batch-size": ["1"]}, 0, "C11_batch_small", 2), (["--batch-size"], {"--batch-size": ["9999"]}, 0, "C12_batch_large", 2), (["--batch-size"], {"--batch-size": ["16"]}, 0, None, 0), (["--parallel"], {"--parallel": ["x"]}, 0, "C13_parallel_zero", 2),
        (["-S"], {"-S": ["1q"]}, 0, "C14_bad_size", 2), (["-S"], {"-S": ["50%"]}, 0, None, 0), (["--files0-from"], {"--files0-from": ["l"]}, 1, "C16_files0_operand", 2), (["--sort"], {"--sort": ["x"]}, 0, "C18_bad_sort_word", 1), (["--check"], {"--check": ["x"]}, 0, "C18_bad_check_word", 1), (["-q"], {}, 0, "unknown_flag", 2),
    ]
    calls = spark.createDataFrame([(f, v, n, 1000) for f, v, n, _, _ in cases], "flags array<string>, given map<string,array<string>>, files int, open int")
    got = O.validated(calls, values="given", files="files", open_files="open").collect()
    assert [(r.flags, r.rule, r.status) for r in got] == [(f, rule, status) for f, _, _, rule, status in cases]
    assert len({rule for *_, rule, _ in cases}) == 21  # every rule, and none
    assert [r.verdict for r in O.validated(calls.select("flags")).collect()][:2] == ["CONFLICT", "OK"]
    with pytest.raises(ValueError):
        O.Key.parse("1,0")


def test_general_and_version_orders_of_odd_lines(spark, tmp_path):
    import subprocess

    numbers = ["5abc", "3", "1e1x", "", "abc", "-2", "+7", " 4", "1e", "0x1A", "-0x2", "inf", "-inf", "nan", "NaN", ".5", "5.", "-.", "1e-3", "--1", "-0", "0", "1e5z", "infinity", "00012"]
    versions = ["", ".", "..", ".a", ".a1", "a", "a1", "a01", "a0", "a10", "a9", "a.b", "a.tar.gz", "a1.tar", "a.1", "a~", "a~1", "a-1", "a_1", "A", "1", "01", "10", "9", "1.2.10", "1.2.9", "1.2~", "1.2", "x" + "9" * 46, "x" + "1" * 41, "x2.c", "x10.c", "é1", "é", "a b", "b~.c"]
    for lines, letter in ((numbers, "g"), (versions, "V")):
        path = tmp_path / letter
        path.write_text("".join(x + "\n" for x in lines))
        theirs = subprocess.run(["sort", f"-{letter}", str(path)], capture_output=True, env={"LC_ALL": "C", "PATH": "/usr/bin:/bin"}).stdout.decode().split("\n")[:-1]
        df, keys = O.with_keys(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "line string, line_no int"), O.Options(letter))
        assert [r.line for r in df.orderBy(*keys).collect()] == theirs


def test_sort_orders(spark, tmp_path):
    import subprocess

    from tallyloom.sources.corpora import corpora

    for name, options, flags in (
        ("numbers", O.Options("n"), ["-n"]), ("months", O.Options("M"), ["-M"]), ("sizes", O.Options("h"), ["-h"]), ("fields", O.Options(keys=[O.Key.parse("2n"), O.Key.parse("1")], tab="\t"), ["-t", "\t", "-k2n", "-k1"]),
        ("fields", O.Options("r", [O.Key.parse("1.3,1.3")], "\t"), ["-r", "-t", "\t", "-k1.3,1.3"]), ("generic", O.Options("f"), ["-f"]), ("generic", O.Options("f", stable=True), ["-f", "-s"]), ("generic", O.Options("d"), ["-d"]),
    ):
        path = tmp_path / name
        path.write_bytes(corpora()[name])
        df = files.read_lines(spark, str(path))
        ours = [r.line for r in df.orderBy(*O.order(options)).collect()]
        theirs = subprocess.run(["sort", *flags, str(path)], capture_output=True, env={"LC_ALL": "C", "PATH": "/usr/bin:/bin"}).stdout.decode("latin-1").split("\n")[:-1]
        assert ours == theirs, (name, flags)
    versions = spark.createDataFrame([(x,) for x in ("a1.10", "a1.9", "b", "a")], "line string")
    assert [r.line for r in versions.orderBy(O.version_key(F.col("line"))).collect()] == ["a", "a1.9", "a1.10", "b"]


SOURCE = """#include <stdio.h>
/* a comment { */
static int add(int a, int b) { return a + b; }
int main(void) { char buf[10]; buf[0] = 'x'; printf("%d {", add(1, 2)); return 0; }
"""


def test_c_sources(spark):
    from tallyloom.functions import csource
    from tallyloom.operators import source_features as SF

    found = csource.functions(SOURCE)
    assert [(f.name, f.calls) for f in found] == [("add", []), ("main", ["add", "printf"])]
    assert csource.descriptors(SOURCE) == {"fixed_arrays": 1, "subscripts": 1}
    assert csource.abstract_stream("int x = 5; // no") == ["int", "ID", "=", "NUM", ";"]
    assert csource.tree_distance(SOURCE, SOURCE) == 0 and 0 < csource.tree_distance(SOURCE, "int main() {}") <= 1
    assert csource.tree_edit_distance(("a", [("b", []), ("c", [])]), ("a", [("c", [])])) == 1
    assert csource.tree_distance(SOURCE, SOURCE, max_nodes=3) is None
    df = spark.createDataFrame([("r", SOURCE), ("n", None)], "run string, source string")
    got = {r.feature: r.value for r in SF.source_features(df).collect()}
    assert got["function.main.call.printf"] == 1 and got["function.main.call.add"] == 1 and got["function.add.kind.+"] == 1
    assert SF.function_table(df).count() == 2 and SF.with_streams(df).filter("stream is null").count() == 1
    pair = spark.createDataFrame([(SOURCE, "int f() {}")], "a string, b string")
    assert SF.tree_distances(pair, "a", "b").first()["tree_distance"] == csource.tree_distance(SOURCE, "int f() {}")


def test_streams(spark, tmp_path):
    from tallyloom.streaming import rollups

    events = spark.read.parquet(f"{__import__('tests.conftest', fromlist=['DATA']).DATA}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = rollups.event_rates(stream, late="3650 days").writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = rollups.event_rates(events)
    key = lambda rows: sorted((r.start, r.n, r.failures) for r in rows)
    assert key(spark.table("rates").collect()) == key(batch.collect())
    assert rollups.user_sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_records(spark):
    from tallyloom.operators.records import record_state

    events = spark.createDataFrame(
        [(1, "init", None, None, None, 0), (1, "stage", "a", True, None, 1), (1, "stage", "b", False, "tests", 2), (1, "stage", "b", True, None, 3), (2, "init", None, None, None, 0), (3, "init", None, None, None, 0), (3, "stage", "a", True, None, 1), (3, "finish", None, True, None, 5)],
        "lineage int, kind string, checkpoint string, success boolean, reason string, ts int",
    )
    order = spark.createDataFrame([("a", 0), ("b", 1)], "checkpoint string, pos int")
    got = {r.lineage: r for r in record_state(events, order).collect()}
    assert got[1].state == "stopped" and got[1].completed_ids == ["a", "b"] and got[1].failure_reason == "tests"
    assert got[2].state == "running" and got[2].checkpoints_completed == 0
    assert got[3].state == "completed" and got[3].failure_stage is None and got[3].finished_at == 5


def test_contracts(spark):
    from tallyloom.operators import contracts as K2

    assert K2.search_arguments(["-ih", "p", "f", "-H", "--", "-x"]) == {"pattern": "p", "operands": ["f", "-x"], "ignore_case": True, "recursive": False, "filename": "with_filename"}
    for bad in (["-r"], ["-q", "p"], []):
        with pytest.raises(ValueError):
            K2.search_arguments(bad, {"ignore_case"})
    case = "name string, args array<string>, flags array<string>, absent_flags array<string>, `check` string, exit_code int, stdout_b64 string, stderr_class string"
    rows = [("ok", ["-r", "x"], ["-r"], [], "golden", 0, "YQo=", "empty"), ("bad", ["x"], ["-r"], [], "golden", 1, "YQ==", "nonempty")]
    problems = [(r["name"], r.problem) for r in K2.case_problems(spark.createDataFrame(rows, case)).collect()]
    assert {n for n, _ in problems} == {"bad"} and len(problems) == 4
    ladder = spark.createDataFrame([("0", 0, ["-f"]), ("1", 1, ["-f", "-r"])], "checkpoint string, pos int, allowed array<string>")
    assert sorted((r["name"], r.problem) for r in K2.corpus_problems(spark.createDataFrame([*rows, ("ok", ["-z"], ["-z"], [], "golden", 0, "YQo=", "empty")], case), ladder).collect()) == [("0", "selects no case"), ("ok", "flag outside of the ladder: -z"), ("ok", "repeated name")]
    files_of = lambda rows: spark.createDataFrame(rows, "d string, path string, sha256 string")
    assert sorted((r.path, r.change) for r in K2.changed_files(files_of([("t", "a", "1"), ("t", "b", "1"), ("t", "c", "1")]), files_of([("t", "a", "2"), ("t", "b", "1"), ("t", "e", "1")]), ["d"]).collect()) == [("a", "modified"), ("c", "deleted"), ("e", "added")]
    refs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "name string, uses string")
    assert sorted(r["name"] for r in bundles.closure(spark.createDataFrame([("a",)], "name string"), refs).collect()) == ["a", "b", "c"]
    assert K2.signal_number("KILL") == K2.signal_number("sigkill") == K2.signal_number("9") == 9


def test_reports(spark, tmp_path):
    from tallyloom.plans import reports

    attempts = spark.createDataFrame([(f"r{i}", i % 4 != 0, i % 3 != 0, i == 7, f"h{i % 2}") for i in range(12)], "run string, complete boolean, success boolean, infrastructure_failure boolean, source_sha256 string")
    features = spark.createDataFrame([(f"r{i}", "b", f"f{j}", float(i % 2 + j)) for i in range(12) for j in range(3)], "run string, block string, feature string, value double")
    out = reports.population_report(attempts, features, 0.3, replicates=20, k_max=2)
    for name, df in out.items():
        assert df is None or df.count() > 0, name
    assert {r.population for r in out["bootstrap"].collect()} == {"passing_complete"}
    results = spark.createDataFrame([("s", f"r{i}", f"c{j}", "PASS" if (i + j) % 3 else "FAIL") for i in range(4) for j in range(5)], "space string, run string, case_id string, verdict string")
    labels = spark.createDataFrame([("s", f"r{i}", i % 2) for i in range(4)], "space string, run string, family int")
    assert reports.behavior_report(results, labels)["convergence"].first()["distinct_hashes"] == 3
    assert reports.suite_report(results.withColumnRenamed("space", "suite"))["failures"].count() > 0
    sessions = spark.createDataFrame([("a", "w", 5), ("b", "w", 3)], "id string, directory string, time_created long")
    messages = spark.createDataFrame([("a", '{"role": "assistant", "tokens": {"input": 4}, "cost": 0.5}')], "session_id string, data string")
    parts = spark.createDataFrame([("a", '{"type": "tool", "tool": "x", "state": {"status": "error", "time": {"start": 5, "end": 1}}}')], "session_id string, data string")
    got = reports.telemetry_report(sessions, messages, parts)
    assert {r.id: r.loop for r in got["sessions"].collect()} == {"b": 0, "a": 1} and got["total"].first()["input_tokens"] == 4
    assert tuple(got["tools"].first()) == ("x", 1, 1, 0)
    stages = spark.createDataFrame([(1, 0, "a", True, 5, 0), (1, 1, "b", True, 8, 1)], "lineage int, pos int, checkpoint string, success boolean, lines int, loops int")
    lineages = spark.createDataFrame([(1, "completed", None)], "lineage int, state string, failed_checkpoint string")
    checkpoints = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "checkpoint string, pos int")
    for name, df in reports.lineage_report(stages, lineages, checkpoints, spark.createDataFrame([(1,), (2,)], "lineage int")).items():
        assert df.count() > 0, name
