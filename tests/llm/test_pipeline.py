"""The corpus pipeline: names, columns, and each stage's effect on its own input."""

import random

import pytest
from tests.conftest import DATA
from tests.llm.test_operators import BIG, brute_components, shingles, split

import corpus_pipeline as pipeline
from tallyloom.llm.pieces import Codec, Vocabulary


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert after.columns == columns
        sizes.append((docs.count(), after.count()))
        before, docs = docs, after
    assert docs.columns == ["doc_id", "n_ids", "ids"]
    assert sizes[0][1] >= 0.99 * sizes[0][0] and sizes[1][0] == sizes[1][1] and sizes[2][1] < sizes[2][0] and sizes[4][0] == sizes[4][1]
    codec = Codec(Vocabulary.load())
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in docs.limit(50).collect():
        assert codec.decode(r.ids) == texts[r.doc_id] and r.n_ids == len(r.ids)


def test_run(spark):
    assert len(pipeline.STAGES) == 5 and pipeline.run(spark, DATA).count() > 0


@pytest.mark.parametrize("index", range(5))
def test_stages_on_hard_and_empty_tables(spark, index, hard_texts):
    rows = [(i if i != 3 else None, t, "en" if i % 3 else None, None, None) for i, t in enumerate(hard_texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = pipeline.STAGES[index][1]
    assert stage(spark, docs, DATA).count() <= len(rows)
    assert stage(spark, docs.limit(0), DATA).count() == 0


def brute_passages(rows):
    """Texts without the lines of runs that occur earlier: of three lines, or of fewer that hold fifty words."""
    seen, gone = {}, {}
    for d, x in sorted(rows, key=lambda r: BIG if r[0] is None else r[0]):
        parts = [] if x is None else x.split("\n")
        for i in range(len(parts)):
            for n in (1, 2, 3):
                run = tuple(parts[i : i + n])
                if len(run) == n and (n == 3 or sum(len(split(p)) for p in run) >= 50) and seen.setdefault(run, (d, i)) != (d, i):
                    gone.setdefault(d, set()).update(range(i, i + n))
    return [(d, None if x is None else "\n".join(p for i, p in enumerate(x.split("\n")) if i not in gone.get(d, ()))) for d, x in rows]


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(41)
    line = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    item = line(12)
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    pool = [line(rng.choice((6, 20, 55))) for _ in range(12)]
    base = line(48)
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.5 else line(9) for _ in range(rng.randint(1, 6))) for _ in range(30)]
    texts += [base + " " + line(k) for k in (1, 2, 3, 30)] + [line(8) + " " + item + " " + line(8), item.replace(item.split()[0], "other"), "", None]
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)]
    frame = lambda r: spark.createDataFrame([(d, t, "x", "s", None if t is None else len(t)) for d, t in r], "doc_id long, text string, lang string, source string, n_chars long")
    got = lambda i, r: sorted(((x.doc_id, x.text) for x in pipeline.STAGES[i][1](spark, frame(r), f"file://{tmp_path}").collect()), key=str)

    cut = brute_passages(rows)
    assert got(1, rows) == sorted(cut, key=str) != sorted(rows, key=str)
    linked = {(BIG if d is None else d): c for d, _, c in brute_components([(BIG if d is None else d, t) for d, t in cut])}
    kept = [(d, t) for d, t in cut if linked[BIG if d is None else d] == (BIG if d is None else d)]
    assert got(2, cut) == sorted(kept, key=str) and len(kept) < len(cut)
    s = shingles(item)
    clean = [(d, t) for d, t in kept if 100 * len(s & shingles(t)) < 80 * len(s)]
    assert got(3, kept) == sorted(clean, key=str) and len(clean) < len(kept)
    codec = Codec(Vocabulary.load())
    assert {(r.doc_id, None if r.ids is None else codec.decode(r.ids)) for r in pipeline.STAGES[4][1](spark, frame(clean), f"file://{tmp_path}").collect()} == set(clean)


def test_scratch_is_removed(spark):
    from tallyloom.llm import common

    with common.scratch(spark):
        inner = common.written(spark, spark.range(3), "x")
        path = inner.inputFiles()[0].rsplit("/", 1)[0]
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        assert inner.count() == 3
    assert not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
