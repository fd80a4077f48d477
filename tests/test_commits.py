"""Replacing tables and documents in one step."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import commits


def test_documents(spark, tmp_path):
    path = f"file://{tmp_path}/a b.json"
    assert commits.read_document(spark, path) is None
    for data in (b"one", b"", "zwei\n".encode()):
        commits.replace_document(spark, path, data)
        assert commits.read_document(spark, path) == data
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["a b.json"]


def test_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    guard = commits.no_loss(["k"], "v")
    rows = lambda: sorted(tuple(r) for r in commits.read_table(spark, path).collect())
    make = lambda *r: spark.createDataFrame(list(r), "k int, v int")
    folders = lambda: [p.name for p in (tmp_path / "t").iterdir() if p.is_dir()]
    assert commits.read_table(spark, path) is None
    commits.replace_table(make((1, 1), (2, None)), path, guard)
    commits.replace_table(make((1, 5), (3, 3)), path, guard)  # 2 had no value
    assert rows() == [(1, 5), (3, 3)] and len(folders()) == 1
    with pytest.raises(commits.Refused, match=r'v would be lost: \{"k":3\}'):
        commits.replace_table(make((1, 6), (3, None)), path, guard)
    assert rows() == [(1, 5), (3, 3)] and len(folders()) == 1
    with pytest.raises(Exception, match="broken"):
        commits.replace_table(make((1, 6)).withColumn("v", F.raise_error(F.lit("broken")).cast("int")), path)
    assert rows() == [(1, 5), (3, 3)] and len(folders()) == 1
    before = commits.read_table(spark, path)
    got = commits.replace_table(before.withColumn("v", F.col("v") + 1), path, guard)  # of itself
    assert sorted(tuple(r) for r in got.collect()) == rows() == [(1, 6), (3, 4)]
    commits.replace_table(make(), path)
    assert rows() == []
