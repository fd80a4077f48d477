"""Merging sorted files by zone maps against a plain sort."""

import random

import pytest

from tallyloom.operators import merge


def write(folder, name, lines, end=b"\n"):
    path = folder / name
    path.write_bytes(b"\n".join(lines) + (end if lines else b""))
    return str(path)


@pytest.mark.parametrize("block, ranges", [(1 << 20, 4), (40, 5), (1, 3)])
def test_merge(spark, tmp_path, block, ranges):
    rng = random.Random(3)
    files = []
    for i in range(6):
        lines = sorted(bytes(rng.choice([0, 9, 65, 66, 200, 255]) for _ in range(rng.choice([0, 1, 3, 90]))) for _ in range(rng.choice([0, 1, 60])))
        files.append(lines)
    files[2] = [b"same"] * 80
    files.append([b"x" * 500, b"y"])
    paths = [write(tmp_path, f"f{i}", lines, b"" if i == 6 else b"\n") for i, lines in enumerate(files)]
    (tmp_path / "list").write_bytes(b"".join(p.encode() + b"\0" for p in paths))
    listed = merge.read_file_list(spark, str(tmp_path / "list"))
    want = sorted(x for f in files for x in f)
    got = [bytes(r.line) for r in merge.merge_sorted(listed, ranges=ranges, block=block).orderBy("place").collect()]
    assert got == want
    got = merge.merge_sorted(listed, ranges=ranges, block=block, unique=True).orderBy("place").collect()
    assert [bytes(r.line) for r in got] == sorted(set(want)) and [r.place for r in got] == list(range(1, len(got) + 1))
    down = [write(tmp_path, f"d{i}", lines[::-1]) for i, lines in enumerate(files)]
    falling = spark.createDataFrame(list(enumerate(down)), "input int, path string")
    assert [bytes(r.line) for r in merge.merge_sorted(falling, reverse=True, ranges=ranges, block=block).orderBy("place").collect()] == want[::-1]


def test_nothing_is_sorted_or_shuffled_but_the_zone_map(spark, tmp_path):
    paths = [write(tmp_path, f"f{i}", [b"%06d" % k for k in range(i, 3000, 3)]) for i in range(3)]
    files = spark.createDataFrame(list(enumerate(paths)), "input int, path string")
    zones = merge.zone_map(files, 1000)
    assert zones.count() < 3 * 9 and sum(r.end - r.start for r in zones.collect()) == 3 * 7000
    out = merge.merge_sorted(files, ranges=4, block=1000)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort" not in plan


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_files_out_of_order_are_an_error(spark, tmp_path, block):
    bad = [b"%04d" % k for k in range(50)]
    bad[17], bad[30] = bad[30], bad[17]
    files = spark.createDataFrame([(0, write(tmp_path, "good", [b"0001", b"0100"])), (1, write(tmp_path, "bad", bad))], "input int, path string")
    with pytest.raises(Exception, match="not sorted"):
        merge.merge_sorted(files, ranges=3, block=block).collect()


def test_an_empty_name_is_an_error(spark, tmp_path):
    (tmp_path / "list").write_bytes(b"a\0\0b\0")
    with pytest.raises(Exception, match="empty file name at 1"):
        merge.read_file_list(spark, str(tmp_path / "list")).collect()
