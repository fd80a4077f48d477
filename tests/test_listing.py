"""The listing source: filters and partitions, layouts, suites, untracked files."""

from pyspark.sql import functions as F

from tallyloom.sources import listing


def tree(folder, files):
    for path, content in files.items():
        at = folder / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)


def test_filters_and_partitions(spark, tmp_path):
    tree(tmp_path, {"top.json": b"1", "a/x.json": b"22", "a/deep/y.txt": b"333", "b/x.json": b"", "ab/x.json": b"4"})
    every = listing.listing(spark, str(tmp_path))
    assert {(r.path, r.folder, r.name, r.size) for r in every.collect()} == {("top.json", "", "top.json", 1), ("a/x.json", "a", "x.json", 2), ("a/deep/y.txt", "a/deep", "y.txt", 3), ("b/x.json", "b", "x.json", 0), ("ab/x.json", "ab", "x.json", 1)}
    paths = lambda **options: sorted(r.path for r in listing.listing(spark, str(tmp_path), **options).collect())
    assert paths(names=["x.json"]) == ["a/x.json", "ab/x.json", "b/x.json"] and paths(names=["y.txt", "top.json"]) == ["a/deep/y.txt", "top.json"] and paths(names=[]) == []
    assert paths(below="a/") == ["a/deep/y.txt", "a/x.json"] and paths(below="a") == ["a/deep/y.txt", "a/x.json", "ab/x.json"] and paths(below="top") == ["top.json"]
    assert paths(ends=".txt") == ["a/deep/y.txt"] and paths(ends=".json", below="a/") == ["a/x.json"]
    both = listing.listing(spark, str(tmp_path), ends=".txt").unionByName(listing.listing(spark, str(tmp_path), ["top.json"]))
    assert sorted(r.path for r in both.filter("size > 0").collect()) == ["a/deep/y.txt", "top.json"]
    folders = lambda below: [p.folder for p in listing.ListingReader(str(tmp_path), below=below).partitions()]
    assert folders("") == ["", "a", "ab", "b"] and folders("a/deep") == ["", "a"] and folders("a") == ["", "a", "ab"]
    assert listing.listing(spark, str(tmp_path / "nothing")).count() == 0


def test_layouts(spark, tmp_path):
    whole = {"metadata.json": b"", "rep-1/metadata.json": b"", "rep-2/notes": b"", "temp-0/metadata.json": b"", "temp-0/rep-1/metadata.json": b"", "other/metadata.json": b""}
    for i, (drop, want) in enumerate([([], [""]), (["metadata.json"], ["rep-1"]), (["metadata.json", "rep-1/metadata.json"], ["temp-0", "temp-0/rep-1"])]):
        tree(tmp_path / str(i), {k: v for k, v in whole.items() if k not in drop})
        assert [r.folder for r in listing.sandbox_attempts(listing.listing(spark, str(tmp_path / str(i)))).orderBy("ord", "folder").collect()] == want


def test_suites(spark, tmp_path):
    tree(tmp_path, {"s/a.json": b"", "s/a.json.gz": b"", "s/b.json": b"", "s/MANIFEST.json": b"", "s/c.json.bak": b"", "d.json.gz": b""})
    assert {(r.folder, r.suite, r.path) for r in listing.suite_files(listing.listing(spark, str(tmp_path))).collect()} == {("s", "a", "s/a.json.gz"), ("s", "b", "s/b.json"), ("", "d", "d.json.gz")}


def test_changes(spark, tmp_path):
    tree(tmp_path, {
        "run/metadata.json": b"{}", "run/diff-numstat.txt": "3\t1\tä.c\r\n-\t-\tbin\nbad line\n5\t2\tsub\tb.c\n".encode(), "run/untracked-files.txt": b" new.c \n\nbin.dat\ngone.c\n\xc3\xa4.c\n",
        "run/candidate/new.c": b"a\r\nb\rc\n\nd", "run/candidate/bin.dat": b"x\n\0", "run/candidate/ä.c": b"",
        "empty/metadata.json": b"{}", "other/diff-numstat.txt": b"9\t9\tz\n",
    })
    attempts = spark.createDataFrame([("run",), ("empty",)], "folder string")
    got = {r.folder: r for r in listing.change_metrics(spark, str(tmp_path), attempts).collect()}
    r = got["run"]
    assert (r.lines_added, r.lines_deleted, r.lines_edited) == (8 + 5, 3, 16)
    assert r.changed_paths == ["b.c", "bin", "bin.dat", "gone.c", "new.c", "ä.c"] and (r.files_edited, r.tracked_files_edited, r.untracked_files_created) == (6, 3, 4)
    assert (got["empty"].lines_edited, got["empty"].files_edited, got["empty"].changed_paths) == (0, 0, []) and len(got) == 2


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/b/c.txt", "ü\n"), ("d.txt", "")], "path string, content string")
    assert listing.write_files(rows, str(tmp_path)) == 2 and listing.write_files(rows.limit(0), str(tmp_path)) == 0
    assert sorted((r.path, r.size) for r in listing.listing(spark, f"file://{tmp_path}").collect()) == [("a/b/c.txt", 3), ("d.txt", 0)]
    assert {bytes(r.content).decode() for r in listing.contents(listing.listing(spark, str(tmp_path)), str(tmp_path)).collect()} == {"ü\n", ""}
