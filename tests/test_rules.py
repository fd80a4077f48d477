"""Rule sets of frozen cases: each rule on its own, stages, counts of the same pass."""

import base64

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import rules as R

CHMOD = "name string, args array<string>, flags array<string>, absent_flags array<string>, tags array<string>, `check` string, exit_code int, stdout_b64 string, stderr_class string, fixture array<struct<path:string,type:string>>, expected_tree map<string,string>"
LINE = "mode of 'd/f' changed from 0644 (rw-r--r--) to 0755 (rwxr-xr-x)\n"


def case(**changes):
    good = {"name": "c", "args": ["-v", "755", "d/f"], "flags": ["-v"], "absent_flags": None, "tags": [], "check": "golden", "exit_code": 0, "stdout_b64": LINE, "stderr_class": "empty", "fixture": [("d/f", "file"), ("l", "symlink")], "expected_tree": {"d/f": "0755", "l": "link"}}
    good |= changes
    if good["stdout_b64"] is not None:
        good["stdout_b64"] = base64.b64encode(good["stdout_b64"].encode()).decode()
    return tuple(good.values())


CASES = {
    "good": ({}, []),
    "kept": ({"stdout_b64": "mode of 'd/f' retained as 4755 (rwsr-xr-x)\n"}, []),
    "long": ({"args": ["--verbose", "-R", "--", "-f", "x"], "flags": ["-R", "-v"]}, []),
    "missing": ({"args": None, "tags": None, "exit_code": 9}, ["a required field is missing: args", "a required field is missing: tags"]),
    "no output": ({"stdout_b64": None, "exit_code": 9}, ["a golden case without output"]),
    "property": ({"stdout_b64": None, "check": "property:x"}, []),
    "status": ({"exit_code": 2}, ["exit status outside 0, 1"]),
    "silent": ({"exit_code": 1}, ["exit 1 without a diagnostic"]),
    "loud": ({"stderr_class": "nonempty"}, ["a diagnostic with exit 0"]),
    "cut": ({"stdout_b64": LINE[:-1]}, ["output without a final newline"]),
    "talks": ({"args": ["755", "-v"], "flags": []}, ["output without -c or -v"]),
    "tree": ({"expected_tree": {"d/f": "755", "l": "0777", "z": "0644"}}, ["a link has a mode: l", "a malformed mode: d/f 755", "the tree names a path that isn't in the fixture: z"]),
    "no mode": ({"expected_tree": {"l": "link"}}, ["no mode is expected for d/f"]),
    "line": ({"stdout_b64": "hello\n" + LINE.replace("rwxr-xr-x", "rwxr-xr--").replace("d/f", "e")}, ["0755 isn't shown as rwxr-xr--", "a report line names a path that isn't in the fixture: e", "no report line: hello"]),
    "twice": ({"stdout_b64": LINE.replace("0755 (rwxr-xr-x)", "0644 (rw-r--r--)")}, ["a changed line has one mode twice"]),
    "flags": ({"flags": ["-v", "-R"]}, ["flags that differ from the options used"]),
    "both": ({"absent_flags": ["-v"], "exit_code": 1, "stderr_class": "nonempty"}, ["a flag both required and absent"]),
    "absent": ({"args": ["-vR", "755", "d/f"], "absent_flags": ["-R"]}, ["an absent flag that isn't rejected"]),
}


def test_chmod_rules(spark):
    rows = spark.createDataFrame([case(name=n, **c) for n, (c, _) in CASES.items()], CHMOD)
    found, seen = R.audited(rows, R.chmod_rules(), "chmod")
    got = {r["name"]: sorted(p["text"] for p in r.problems) for r in found.collect()}
    assert got == {n: sorted(want) for n, (_, want) in CASES.items()}
    counts = seen.get  # of the same pass
    assert (counts["cases"], counts["wrong"]) == (len(CASES), sum(bool(w) for _, w in CASES.values()))
    assert sum(v for k, v in counts.items() if k not in ("cases", "wrong")) == sum(len(w) for _, w in CASES.values())
    assert counts["required field"] == 2 and counts["report line"] == 4


def test_heldout_rules(spark):
    rows = [("heldout-a", ["x"], [], 0, "a"), (None, None, None, None, None), ("", [], [], 0, "b"), ("other", [], [], 0, "b"), ("heldout-b", None, [], None, "")]
    cases = spark.createDataFrame(rows, "name string, args array<string>, flags array<string>, exit_code int, dual_of string")
    got = sorted((r["name"] or "", r.problem) for r in R.violations(cases, R.heldout_rules()).collect())
    assert got == [("", "a case without a name")] * 2 + [("heldout-b", "a required field is missing: args"), ("heldout-b", "a required field is missing: exit_code"), ("heldout-b", "no visible case that it mirrors"), ("other", "a name that doesn't begin with heldout-")]


@pytest.mark.parametrize("args, want", [([], []), (["755"], []), (["-Rv", "755", "-c"], ["-R", "-v"]), (["--quiet", "-f", "x"], ["-f"]), (["-", "-R"], []), (["--", "-R"], []), (["-w", "-R"], ["-R"]), (["--unknown", "-c"], ["-c"])])
def test_used_options(spark, args, want):
    assert spark.range(1).select(F.array(*map(F.lit, args)).cast("array<string>").alias("args")).select(R.used_options()).first()[0] == want
