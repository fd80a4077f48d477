"""Judging, syntax trees, views and scanners on small cases."""

import json
import stat

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import experiments as E
from tallyloom.operators import judging as J
from tallyloom.operators import paper
from tallyloom.operators import report as P
from tallyloom.operators import syntax as S
from tallyloom.plans.shared import written


def test_mutations(spark):
    texts = [b"", b"one", b"a\nb\nc\n", bytes(range(256))] * 30
    rows = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "id long, data binary")
    first, again, other = (J.mutated(rows, s).orderBy("id").collect() for s in (1, 1, 2))
    assert first == again != other
    seen = set()
    for r in first:
        old, new = texts[r.id], bytes(r.data)
        a, b = old.split(b"\n"), new.split(b"\n")
        seen.add(r.mutation)
        if r.mutation == "number" or r.mutation == "drop" and len(a) == 1 or r.mutation == "flip" and not old:
            assert b[:-1] == a and abs(int(b[-1])) <= 10**9
        elif r.mutation == "drop":
            assert len(b) == len(a) - 1
        elif r.mutation == "repeat":
            assert b[:-1] == a and b[-1] in a
        elif r.mutation == "flip":
            assert sum(bin(x ^ y).count("1") for x, y in zip(old, new, strict=True)) == 1
        elif r.mutation == "nul":
            assert len(new) == len(old) + 1 and any(new[:i] + new[i + 1 :] == old and new[i] == 0 for i in range(len(new)))
        else:
            assert r.mutation == "shuffle" and sorted(a) == sorted(b)
    assert seen == set(J.MUTATIONS)


def test_minimized_keeps_what_deviates(spark):
    cases = spark.createDataFrame([(1, list("abcdXefgh")), (2, ["X"]), (3, list("XabX")), (4, list("ab"))], "id int, lines array<string>")
    out = J.minimized(cases, lambda h: h.filter(F.array_contains("lines", "X")), written)
    assert {r.id: r.lines for r in out.collect()} == {1: ["X"], 2: ["X"], 3: ["X"], 4: ["a", "b"]}
    assert J.minimized(cases.limit(0), lambda h: h, written).count() == 0


def test_reports(spark):
    good = spark.createDataFrame([(1, json.dumps({"failures": [["a", "FAIL", "x"], ["b", "CRASH"]], "counts": {"PASS": 3, "SKIP": 2}})), (2, "{}")], "run int, payload string")
    assert [(r.run, r["name"], r.verdict) for r in J.report_failures(good, ["run"]).collect()] == [(1, "a", "FAIL"), (1, "b", "CRASH")]
    assert [r[0] for r in good.select(J.report_case_count()).collect()] == [5, 0]
    bad = spark.createDataFrame([(1, json.dumps({"failures": [["a"]]}))], good.schema)
    with pytest.raises(Exception, match="malformed"):
        J.report_failures(bad, ["run"]).collect()


def test_environment(spark):
    now = J.environment(spark)
    J.require_environment(spark, {"spark": [now["spark"], "0"], "python": now["python"]})
    with pytest.raises(J.IncompatibleEnvironment, match="spark is") as e:
        J.require_environment(spark, {"spark": "0.1"})
    assert e.value.status == 3


def test_trees(spark):
    deep = {"kind": "Leaf"}
    for _ in range(400):
        deep = {"kind": "Paren", "inner": [deep]}
    inside = {"begin": {"line": 1}, "end": {"expansionLoc": {"line": 2}}}
    tree = {"kind": "Unit", "inner": [{"kind": "FunctionDecl", "name": "f", "isThisDeclarationADefinition": True, "range": inside, "inner": [deep, {"kind": "UnaryOperator", "opcode": "-"}]}, {"kind": "Out", "range": {"begin": {"line": 99}}}, None, 5]}
    rows = spark.createDataFrame([(1, json.dumps(tree), "x.c", 10), (2, "{broken", "x.c", 10), (3, None, None, None)], "run int, tree string, path string, lines int")
    nodes = S.ast_nodes(rows, ["run"])
    got = {r.feature: r.value for r in S.ast_features(nodes.filter("run = 1"), ["run"]).collect()}
    assert got == {"function.f.kind.FunctionDecl": 1, "function.f.kind.Paren": 400, "function.f.kind.Leaf": 1, "function.f.kind.UnaryOperator": 1, "function.f.operator.UnaryOperator.-": 1}
    assert {r.run for r in nodes.filter("error is not null").collect()} == {2, 3}
    bundle = S.source_bundle(rows.select("run"), ["run"], clang=S.ast_features(nodes, ["run"]))
    assert {r.run: (r.clang_nodes, r.clang_missing) for r in bundle.collect()} == {1: (404.0, False), 2: (None, True), 3: (None, True)}
    diffs = spark.createDataFrame([(1, "move-tree\nupdate-node", 0, 4, 2, False), (2, "", 0, 4, 2, False), (3, "", 0, None, 2, True)], "run int, output string, exit_code int, nodes_before int, nodes_after int, same boolean")
    assert sorted(map(tuple, S.edit_magnitude(diffs, ["run"]).collect())) == [(1, 2, 0.5, None), (2, 0, 0.0, "no edit action was found"), (3, 0, None, None)]


def test_views_and_their_guard(spark, tmp_path):
    runs, view = spark.createDataFrame([(1, 5, 2.0)], "run int, lines_added int, score double"), str(tmp_path / "v")
    out = E.write_view(spark, runs, "final", view)
    assert out.first().asDict() == {"run": 1, "lines_added": None, "score": 2.0, "population": "final"}
    about = spark.read.json(f"{view}/metadata").first()
    assert about.n == 1 and "gumtree_edit_actions" in about.unsupported_metrics
    (tmp_path / "v" / E.MEASUREMENT).mkdir(parents=True)
    with pytest.raises(FileExistsError):
        E.write_view(spark, runs, "final", view)
    assert E.write_view(spark, runs, "final", view, allow_loss=True).count() == 1


SCANNER = """#!/bin/sh
if [ "$1" = --version ]; then echo "scanner 2.0.20"; exit 0; fi
for last; do :; done
if grep -q fail "$last"; then echo broken >&2; exit 3; fi
if grep -q odd "$last"; then echo "File,Line"; echo "a,1"; exit 0; fi
echo "File,Line,Column,DefaultLevel,Level,Category,Name,Warning,Suggestion,CWEs,Fingerprint,ToolVersion"
if grep -q strcpy "$last"; then echo "candidate.c,1,2,4,4,buffer,strcpy,w,s,CWE-120,f,2.0.20"; fi
"""


def test_scanners(spark, tmp_path):
    path = tmp_path / "scanner"
    path.write_text(SCANNER)
    path.chmod(path.stat().st_mode | stat.S_IXUSR)
    usable = E.scanner_provenance(str(path), "2.0.20")
    assert usable["status"] == "available" and usable["options"][-1] == "--minlevel=1"
    assert E.scanner_provenance(str(path), "9.9")["reason"] == "version_mismatch" and E.scanner_provenance(str(tmp_path / "none"), "1")["reason"] == "flawfinder_not_found"
    sources = spark.createDataFrame([(1, "strcpy(a, b);"), (2, "clean"), (3, "fail"), (4, "odd"), (5, None)], "run int, source string")
    got = {r.run: (r.status, r.reason, r.findings) for r in E.scan_sources(sources, ["run"], usable).collect()}
    assert json.loads(got[1][2])[0]["CWEs"] == "CWE-120" and got[2] == ("available", None, "[]") and got[3] == ("unavailable", "broken", None)
    assert got[4][1].startswith("malformed") and got[5] == ("unavailable", "no_source", None)


def test_wide_rows(spark):
    summary = spark.createDataFrame([("sort", 3, 0.5, 9.0)], "issue string, population_n int, end_to_end_rate double, lines_edited_mean double")
    row, view = paper.metrics_row(summary), paper.metrics_row(summary, survivors=True)
    assert len(row.columns) == len(set(row.columns)) == len(paper.descriptive_row(summary).columns) == 31
    assert row.first()["End-to-End Success Rate"] == 0.5 and view.first()["End-to-End Success Rate"] is None
    assert paper.descriptive_row(summary).first()["Mean Lines Edited"] == 9.0 and paper.descriptive_row(summary, survivors=True).first()["Mean Lines Edited"] is None
    parent = paper.parent_row(view, spark.createDataFrame([(10, 7, 0.7)], "lineages_started int, lineages_completed int, lineage_completion_rate double")).first()
    assert parent["N Attempts"] == 10 and parent["Pass@1"] == pytest.approx(0.7) and parent["Pass@10"] == 1.0 and parent["Population N"] == 3
    mixed = spark.createDataFrame([("10",), ("9.5",), ("auto",), (None,), ("1e1",)], "t string")
    assert [r.t for r in mixed.orderBy(*P.mixed_order("t")).collect()] == ["9.5", "10", "1e1", "auto", None]


def test_change_bundle(spark):
    from tallyloom.operators import distance as D

    pairs = spark.createDataFrame([(1,), (2,)], "run int")
    before = spark.createDataFrame([(1, "f", "a"), (1, "g", "b")], "run int, name string, sha256 string")
    after = spark.createDataFrame([(1, "f", "a2"), (1, "h", "c")], "run int, name string, sha256 string")
    churn = spark.createDataFrame([(1, 3, 1), (2, 0, 0)], "run int, added int, deleted int")
    nodes = spark.createDataFrame([(1, "if", 2), (1, "for", -1)], "run int, feature string, delta int")
    diffs = spark.createDataFrame([(1, "insert-node", 0, 4, 2, False), (2, "", 0, 1, 1, True)], "run int, output string, exit_code int, nodes_before int, nodes_after int, same boolean")
    out = D.change_bundle(pairs, ["run"], churn, D.function_changes(before, after, ["run"]), nodes, S.edit_magnitude(diffs, ["run"]))
    got = {r.run: r for r in out.collect()}
    assert got[1].node_delta == {"if": 2, "for": -1} and got[1].nodes_changed == 3 and got[1].n_edited == 1 and got[1].created_names == ["h"] and got[1].magnitude == 0.25
    assert got[2].nodes_changed == 0 and got[2].node_delta is None and got[2].actions == 0
