"""Line operators against plain Python, and byte exactness."""

import random
import subprocess

from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import lines as L
from tallyloom.plans.shared import ranked
from tallyloom.sources import files


def frame(spark, lines):
    return spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "source int, line_no int, line string")


def upper(x):
    return "".join(c.upper() if "a" <= c <= "z" else c for c in x)


def test_sorting(spark):
    random.seed(3)
    lines = ["".join(random.choice("aAbB_[ é") for _ in range(random.randint(0, 4))) for _ in range(200)]
    key = lambda x: x.encode()
    fold = lambda x: (upper(x).encode(), x.encode())
    get = lambda **k: [r.line for r in L.sorted_lines(frame(spark, lines), **k).orderBy("rank").collect()]
    assert get() == sorted(lines, key=key)
    assert get(reverse=True) == sorted(lines, key=key, reverse=True)
    assert get(fold=True) == sorted(lines, key=fold)
    best = {}
    for x in lines:
        best[upper(x)] = min(best.get(upper(x), x), x, key=key)
    assert sorted(r.line for r in L.unique_lines(frame(spark, lines), fold=True).collect()) == sorted(best.values())


def test_unique_representative(spark):
    df = frame(spark, ["apple", "Apple", "APPLE"])
    assert L.unique_lines(df, fold=True).first()["line"] == "APPLE"
    assert L.unique_lines(df, fold=True, keep="input").first()["line"] == "apple"


def test_order_check(spark):
    get = lambda lines, **k: L.order_check(frame(spark, lines), ["source"], **k).first()["disorder_line"]
    assert get(["a", "b", "a"]) == 2 and get(["a", "a"]) is None and get(["a", "a"], strict=True) == 1
    assert get(["abc", "ABC"], fold=True) is None and get(["abc", "ABC"], fold=True, last_resort=True) == 1
    assert get(["b", "a"], reverse=True) is None and get(["a", "b"], reverse=True) == 1


def test_bytes_survive(spark, tmp_path):
    raw = bytes(range(256)) + b"\nx\r\n\n\xff\xfe"
    (tmp_path / "f").write_bytes(raw)
    rows = files.read_lines(spark, str(tmp_path / "f")).orderBy("line_no").collect()
    expected = raw.split(b"\n")
    assert [r.line.encode("latin-1") for r in rows] == expected
    (tmp_path / "e").write_bytes(b"")
    assert files.read_lines(spark, str(tmp_path / "e")).count() == 0
    (tmp_path / "z").write_bytes(b"a\0b\nc\0")
    assert [r.line for r in files.read_lines(spark, str(tmp_path / "z"), "\0").orderBy("line_no").collect()] == ["a", "b\nc"]


def test_against_system_tools(spark, tmp_path):
    random.seed(11)
    lines = ["".join(random.choice("abAB .-z") for _ in range(random.randint(0, 6))) for _ in range(300)]
    path = tmp_path / "in"
    path.write_text("\n".join(lines) + "\n")
    run = lambda *a: subprocess.run(a, capture_output=True, text=True, env={"LC_ALL": "C", "PATH": "/usr/bin:/bin"}).stdout
    df = files.read_lines(spark, str(path))
    assert "".join(r.line + "\n" for r in ranked(df, "line").orderBy("rank").collect()) == run("sort", str(path))
    for pattern in ("a", ".", "", "b-"):
        assert "".join(r.out + "\n" for r in L.search(df, pattern).orderBy("line_no").collect()) == run("grep", "-F", "--", pattern, str(path))
    assert "".join(r.out + "\n" for r in L.search(df, "Ab", ignore_case=True).orderBy("line_no").collect()) == run("grep", "-F", "-i", "Ab", str(path))


def test_search_operands(spark):
    lines = spark.createDataFrame([("f", 0, 0, "abc"), ("f", 0, 1, "x"), ("d", 0, 0, "abc")], "operand string, walk_ord int, line_no int, line string")
    operands = spark.createDataFrame([(0, "f", "file"), (1, "nope", None), (2, "d", "dir")], "ord int, operand string, kind string")
    got = sorted((r.ord, r.out, r.is_error) for r in L.search_operands(lines, operands, "b").collect())
    assert got == [(0, "abc", False), (1, "nope: No such file or directory", True), (2, "d: Is a directory", True)]
    assert L.search_status(L.search_operands(lines, operands, "b")).first()["status"] == 2
    only = operands.filter("ord = 0")
    assert L.search_status(L.search_operands(lines, only, "b")).first()["status"] == 0
    assert L.search_status(L.search_operands(lines, only, "q")).first()["status"] == 1
    assert L.show_prefix(["-H", "-h"], ["a", "b"], set(), False) is False and L.show_prefix([], ["d"], {"d"}, True) is True


def test_text_functions(spark):
    row = spark.range(1).select(
        X.normal_path(F.lit("/")).alias("a"), X.normal_path(F.lit("a/b//")).alias("b"), X.join_path(F.lit("a/"), F.lit("b")).alias("c"),
        X.cwe_ids(F.lit("x CWE-20, CWE-9! CWE-20")).alias("d"), X.normal_source(F.lit('int a; /* x */ char *s = "/*no*/"; // y\n b')).alias("e"),
        X.lexical_distance(F.lit(""), F.lit("")).alias("f"), X.duration_seconds(F.lit("5m")).alias("g"), X.duration_seconds(F.lit("5w")).alias("h"),
        X.physical_lines(F.lit("a\r\nb\x0bc d\n")).alias("i"), X.fold_lower(F.lit("ÉA")).alias("j"), X.tail(F.lit("abcdef"), 2).alias("k"), X.human_duration(F.lit(245000)).alias("l"),
    ).first()
    assert list(row) == ["/", "a/b", "a/b", ["CWE-9", "CWE-20"], 'int a; char *s = "/*no*/"; b', 0.0, 300.0, None, 4, "Éa", "ef", "4m05s"]
