"""The operators of the subpackage against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA, same_rows

from tallyloom.llm import decontaminate, exchange, hamming, jaccard, langid, lines, pieces, quality, queries, sharding, substrings, warc, words

BIG = (1 << 63) - 1


def split(t):
    return (t or "").encode().split()


def brute_substrings(rows, length=13):
    """(doc_id, n_words, n_removed, sha) by the definition."""
    first = {}
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            first[key] = min(first.get(key, BIG + 1), BIG if d is None else d)
    out = []
    for d, t in rows:
        w, gone = split(t), set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (BIG if d is None else d):
                gone |= set(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("automaton_words, salt_bytes, batch_bytes", [(100_000, 16 << 20, 4 << 20), (30, 500, 300)])
def test_substrings(spark, documents, hard_texts, monkeypatch, automaton_words, salt_bytes, batch_bytes):
    monkeypatch.setattr(substrings, "SALT_BYTES", salt_bytes)
    monkeypatch.setattr(exchange, "BATCH_BYTES", batch_bytes)
    got = sorted((tuple(r) for r in substrings.dedup_substrings(spark, documents, with_text=False).collect()), key=str)
    assert got == brute_substrings([(i if i != 3 else None, t) for i, t in enumerate(hard_texts)])


def short_hashes(bits):
    def layout(*args, **kwargs):
        out = exchange.Layout(*args, **kwargs)
        out.hash_bits, out.bucket_bits = bits, 2
        return out

    return layout


@pytest.mark.parametrize("bits", [4, 9, 12])
def test_substrings_with_colliding_hashes(spark, documents, hard_texts, monkeypatch, bits):
    monkeypatch.setattr(substrings, "Layout", short_hashes(bits))
    monkeypatch.setattr(exchange, "BATCH_BYTES", 2000)
    monkeypatch.setattr(substrings, "SALT_BYTES", 3000)
    got = sorted((tuple(r) for r in substrings.dedup_substrings(spark, documents, with_text=False).collect()), key=str)
    assert got == brute_substrings([(i if i != 3 else None, t) for i, t in enumerate(hard_texts)])


def test_jaccard_with_colliding_hashes(spark, documents, hard_texts, monkeypatch):
    monkeypatch.setattr(jaccard, "Layout", short_hashes(7))
    got = sorted(((BIG if r.doc_id is None else r.doc_id, r.n_shingles, BIG if r.component_id is None else r.component_id) for r in jaccard.jaccard_components(spark, documents).collect()), key=str)
    assert got == brute_components([(i if i != 3 else BIG, t) for i, t in enumerate(hard_texts)])


def test_substrings_text_and_empty(spark, documents, no_documents, hard_texts):
    assert substrings.dedup_substrings(spark, no_documents).count() == 0
    for r in substrings.dedup_substrings(spark, documents).filter("n_removed > 0").collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 and len(r.kept.split()) == r.n_words - r.n_removed


def test_several_automata():
    rng = random.Random(1)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 60))] for _ in range(30)]
    known = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - 3):
            known.setdefault(tuple(t[i : i + 4]), d)
    automaton = substrings.SuffixAutomaton()
    for d, t in enumerate(texts):
        automaton.add(t, d)
    for _ in range(50):
        q = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]
        assert dict(automaton.statistics(q, 4)) == {i + 3: known[tuple(q[i : i + 4])] for i in range(len(q) - 3) if tuple(q[i : i + 4]) in known}


def shingles(t, k=5):
    w = split(t.translate({c: c + 32 for c in range(65, 91)}) if t else t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(d), find(e)))
                root[y] = x
    return sorted(((d, len(s), find(d)) for d, s in sets), key=str)


@pytest.mark.parametrize("stars", [1, 3])
def test_jaccard(spark, documents, hard_texts, monkeypatch, stars):
    monkeypatch.setattr(jaccard, "STARS", stars)
    got = sorted(((BIG if r.doc_id is None else r.doc_id, r.n_shingles, BIG if r.component_id is None else r.component_id) for r in jaccard.jaccard_components(spark, documents).collect()), key=str)
    assert got == brute_components([(i if i != 3 else BIG, t) for i, t in enumerate(hard_texts)])


def test_jaccard_random_near_copies(spark):
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = [str(rng.randrange(60)) for _ in range(rng.randint(6, 70))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = str(rng.randrange(60))
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.jaccard_components(spark, docs).collect()), key=str) == brute_components(rows)
    kept = {r.doc_id for r in jaccard.one_of_each(spark, docs).collect()}
    assert kept == {c for _, _, c in brute_components(rows)}


def test_jaccard_of_ids_with_several_texts(spark):
    rng = random.Random(12)
    bases = [[str(rng.randrange(50)) for _ in range(30)] for _ in range(6)]
    rows = []
    for _ in range(40):
        w = list(rng.choice(bases))
        w[rng.randrange(30)] = str(rng.randrange(50))
        rows.append((rng.randrange(15), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.jaccard_components(spark, docs).collect()), key=str) == brute_components(rows)


SPARSE = {
    "one": [(5, " ".join(f"w{i}" for i in range(40)))],
    "three": [(i, " ".join(f"{i}w{j}" for j in range(30))) for i in range(3)],
    "distinct": [(i, " ".join(f"{i}-{j}" for j in range(20 + i % 7))) for i in range(100)],
    "nulls": [(None, None), (1, None), (None, ""), (2, " ")],
    "null ids": [(None, "same text of seven words in all"), (None, "same text of seven words in all"), (None, "another one that stands all alone here"), (4, "x")],
}


@pytest.mark.parametrize("rows", SPARSE.values(), ids=SPARSE)
def test_tables_that_share_little(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (4 << 20, 200):
        monkeypatch.setattr(exchange, "BATCH_BYTES", size)
        got = sorted((tuple(r) for r in substrings.dedup_substrings(spark, docs, with_text=False).collect()), key=str)
        assert got == brute_substrings(rows)
        big = lambda x: BIG if x is None else x
        got = sorted(((big(r.doc_id), r.n_shingles, big(r.component_id)) for r in jaccard.jaccard_components(spark, docs).collect()), key=str)
        assert got == brute_components([(big(i), t) for i, t in rows])
    assert {(r.doc_id, r.text) for r in jaccard.one_of_each(spark, docs).collect()} == set(rows)


def test_words_that_polynomial_hashes_confuse(spark):
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"p q {one} r s"), (2, f"p q {two} r s"), (3, f"p q {one} r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jaccard.jaccard_components(spark, docs).collect()} == {(1, 1, 1), (2, 1, 2), (3, 1, 1)}
    items = spark.createDataFrame([(7, rows[0][1])], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contained_items(spark, docs, items).collect()} == {1, 3}


def test_shared_shingles():
    rng = random.Random(14)
    for n in (0, 1, 4, 5, 30, 40_000):
        a, b = ([rng.choice(["a", "b", "C"]) for _ in range(rng.randint(n // 2, n))] for _ in "ab")
        b += a[: n // 2]
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        assert words.shared_shingles(words.lower_words(" ".join(a)), words.lower_words(" ".join(b))) == (len(x & y), len(x), len(y))
    assert words.lower_words(None) == [] and words.lower_words("Éa B\tc") == ["Éa".encode(), b"b", b"c"]


def test_jaccard_empty(spark, no_documents):
    assert jaccard.jaccard_components(spark, no_documents).count() == 0
    assert jaccard.one_of_each(spark, no_documents).columns == no_documents.columns


def test_components_of_a_chain(spark):
    rng = random.Random(2)
    nodes = rng.sample(range(1000), 60)
    links = spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)) + [(5000, 5001)], "u long, v long")
    got = {r.node: r.component for r in jaccard.components(spark, links).collect()}
    assert {got[n] for n in nodes} == {min(nodes)} and got[5001] == 5000


def test_decontamination(spark, documents, no_documents, hard_texts, monkeypatch):
    items = [hard_texts[8], "two words", "x y " * 40, " ".join(hard_texts[8].split()[:30]) + " other words here", None, "", "never seen before at all today"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, hard_texts[8])], "item_id long, text string")
    expected = []
    for d, t in enumerate(hard_texts):
        own = shingles(t)
        for i, x in [*enumerate(items), (None, hard_texts[8])]:
            s = shingles(x)
            if s and 100 * len(s & own) >= 80 * len(s):
                expected.append((d if d != 3 else None, i, len(s & own), len(s)))
    for size in (8 << 20, 50):
        monkeypatch.setattr(decontaminate, "ITEM_BLOCK_BYTES", size)
        got = sorted((tuple(r) for r in decontaminate.contained_items(spark, documents, table).collect()), key=str)
        assert got == sorted(expected, key=str)
    clean = decontaminate.decontaminated(spark, documents, table)
    assert clean.columns == documents.columns and clean.count() == len(hard_texts) - len({e[0] for e in expected})
    assert decontaminate.contained_items(spark, no_documents, table).count() == 0
    assert decontaminate.contained_items(spark, documents, table.limit(0)).count() == 0


def test_decontamination_by_row(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(None, item), (None, "clean text of its own"), (None, None), (7, "before " + item), (7, "another clean text"), (8, "third")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = decontaminate.decontaminated(spark, docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(tuple, clean.collect()), key=str) == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)


def test_one_of_each_by_row(spark):
    text = lambda a: " ".join(f"{a}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b") + " end"), (1, text("a")), (2, text("c")), (None, None), (None, "")]
    for more in ([], [(2, text("d")), (3, text("c") + " end"), (1, text("a"))]):
        out = jaccard.one_of_each(spark, spark.createDataFrame(rows + more, "doc_id long, text string")).collect()
        b = [r.text for r in out if r.text and r.text.startswith("b0")]
        assert len(b) == 1 and [r.doc_id for r in out if r.text and r.text.startswith("a0")] == [1]
        left = {tuple(r) for r in out if r.text not in b and r.doc_id != 1}
        assert left == {(2, text("c")), (None, None), (None, "")} | ({(2, text("d"))} if more else set())


def brute_lines(rows, t=lines.LINES):
    seen, gone = {}, {}
    positions = sorted(((BIG if d is None else d, i, tuple(x.split("\n")[i : i + t]), x) for d, x in rows if x is not None for i in range(x.count("\n") + 2 - t)), key=lambda p: p[:2])
    for d, i, run, x in positions:
        first = seen.setdefault(run, (d, i))
        if first < (d, i):
            gone.setdefault((d, x), set()).update(range(i, i + t))
    out = []
    for d, x in rows:
        cut = gone.get((BIG if d is None else d, x), set())
        parts = [] if x is None else x.split("\n")
        out.append((d, len(parts), len(cut), None if x is None else "\n".join(p for i, p in enumerate(parts) if i not in cut)))
    return sorted(out, key=str)


def test_lines(spark):
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, "a\nb\nc\nd"), (3, "x\na\nb\nc\nd\n"), (3, "x\na\nb\nc\nd\n"), (None, "a\nb\nc"), (4, "z\nz\nz\nz\nz\nz"), (5, "a\nb"), (9, "\n".join(map(str, range(3000)))), (10, "q\n" + "\n".join(map(str, range(100, 2000))))]
    rows += [(20 + i, "\n".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))) for i in range(30)]
    docs = spark.createDataFrame([(d, x, 1, 2) for d, x in rows], "doc_id long, text string, start int, length int")
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_removed"]
    assert sorted(((r.doc_id, r._n_lines, r._n_removed, r.text) for r in out.collect()), key=str) == brute_lines(rows)
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    run = lines.repeated_runs(docs.filter("doc_id in (2, 3)")).collect()
    assert {(r._doc, r.start, r.length, r.source_doc, r.source_start) for r in run} == {(3, 1, 4, 2, 0)}


def test_lines_are_winnowed(spark):
    rng = random.Random(31)
    rows = [(i, "\n".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 40)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chosen, spans = {}, {}
    for r in lines.fingerprints(docs).collect():
        starts = [(s.i, s.n) for s in r._spans if s is not None]
        spans.setdefault(r._doc, set()).update(starts)
        chosen[r._doc] = chosen.get(r._doc, 0) + 1
    for d, t in rows:
        n = t.count("\n") + 1
        windows = max(0, n - lines.LINES + 1)
        assert {s for s, _ in spans.get(d, ())} == set(range(windows))  # each run of LINES lines holds a fingerprint
        assert chosen.get(d, 0) <= windows + 1
    assert sum(chosen.values()) < 0.8 * sum(t.count("\n") for _, t in rows)  # 2 of 3 places at random
    clash = docs.select("*", F.lit(1).alias("_text"), F.lit(2).alias("_doc"), F.lit(3).alias("_gone"), F.lit(4).alias("_n_lines"), F.lit(5).alias("_row"))
    out = lines.dedup_lines(clash)
    assert out.columns == [*clash.columns, "__n_lines", "_n_removed"]
    assert {(r._text, r._doc, r._gone, r._n_lines, r._row) for r in out.collect()} == {(1, 2, 3, 4, 5)}


def test_long_passages_on_few_lines(spark):
    rng = random.Random(21)
    line = lambda n: " ".join(str(rng.randrange(1000)) for _ in range(n))
    pool = [line(n) for n in (49, 50, 51, 30, 20, 24, 3, 1)] + ["\t ".join("q" * 50), ""]
    rows = [(0, pool[1]), (1, pool[1]), (2, pool[0]), (3, pool[0]), (4, f"{pool[3]}\n{pool[4]}"), (5, f"x\n{pool[3]}\n{pool[4]}\ny"), (None, pool[2]), (6, pool[2])]
    rows += [(20 + i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 5)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, gone = {}, {}
    for d, x in sorted(rows, key=lambda r: BIG if r[0] is None else r[0]):
        parts = x.split("\n")
        for i in range(len(parts)):
            for n in (1, 2, 3):
                run = tuple(parts[i : i + n])
                if len(run) == n and (n == 3 or sum(len(split(p)) for p in run) >= lines.WORDS):
                    if seen.setdefault(run, (d, i)) != (d, i):
                        gone.setdefault(d, set()).update(range(i, i + n))
    expected = {d: (len(gone.get(d, ())), "\n".join(p for i, p in enumerate(x.split("\n")) if i not in gone.get(d, ()))) for d, x in rows}
    out = lines.dedup_lines(docs, lines.WORDS).collect()
    assert {r.doc_id: (r._n_removed, r.text) for r in out} == expected
    assert expected[1] == (1, "") and expected[3] == (0, pool[0]) and expected[5] == (2, "x\ny") and expected[None] == (1, "")


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [rng.normal(size=40).tolist() for _ in range(150)]
    vectors += [vectors[0]] * 30 + [None, [], [float("nan")] * 40]
    rows = [(i, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    codes = {i: (np.nan_to_num(np.array(v, np.float32)) > 0) for i, v in rows if v}
    for blocks in (32768, 40):
        got = {}
        for r in hamming.exact_top_k(spark, df, df.filter("vec_id % 7 = 0"), 12, block_rows=blocks, block_queries=9).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.distance, r.neighbor_id)
        assert set(got) == {i for i in codes if i % 7 == 0}
        for q, found in got.items():
            assert [found[k] for k in sorted(found)] == sorted((int((codes[q] != c).sum()), i) for i, c in codes.items())[:12]
    assert hamming.exact_top_k(spark, df.limit(0), df, 3).count() == 0
    few = hamming.exact_top_k(spark, df.filter("vec_id < 3"), df.filter("vec_id = 0"), 10)
    assert few.count() == 3
    twice = spark.createDataFrame([(1, [1.0, -1.0]), (1, [-1.0, -1.0]), (2, [-1.0, -1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.neighbor_id, r.distance) for r in hamming.exact_top_k(spark, twice, twice.filter("vec_id = 1"), 3).collect())
    assert got == [(1, 0), (1, 1), (2, 0)]  # the vector that is first in order is the query


def test_warc(spark, tmp_path):
    html = ["<p>é</p>", "", None, "<p>é</p>", "big" * 1000, "<p>é</p>", "x\r\n\r\ny"]
    rows = [(i, f"http://h/{i} ü" if i != 4 else None, h) for i, h in enumerate(html)] + [(5, "http://h/5", "<p>é</p>"), (None, "u", "<p>é</p>"), (None, "v", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for least, frame in ((0, 1 << 18), (5, 1)):
        uri = f"file://{tmp_path}/w{least}"
        index = spark.createDataFrame(warc.write_bundles(pages, uri, min_bytes=least, frame_bytes=frame, bundle_bytes=700).collect(), warc.INDEX)
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in warc.read_bundles(index, uri).collect()), key=str)
        expected = []
        for p, _, h in rows:
            raw = (h or "").encode()
            same = [q for q, _, g in rows if (g or "") == (h or "") and q is not None]
            top = max(same, default=None) if len(raw) >= least else None
            revisit = top is not None and p != top
            expected.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None, None if revisit else raw))
        assert got == sorted(expected, key=str)
        one = index.filter("page_id = 4")
        assert warc.read_bundles(one, uri).first()["payload"] == b"big" * 1000
    assert warc.write_bundles(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_index_rows_of_another_attempt_go_to_the_same_partition(spark):
    where = []
    for attempt in (3, 90):
        index = spark.createDataFrame([(i, warc.record_id(i, "x"), f"bundle-000000-{attempt}-{(i * attempt) % 7}", i % attempt, 0, 9) for i in range(200)], warc.INDEX)
        where.append({r.record_id: r.p for r in warc.dealt(index.coalesce(1)).select("record_id", F.spark_partition_id().alias("p")).collect()})
    assert where[0] == where[1] and len(set(where[0].values())) > 1


def test_sharding(spark, documents, no_documents, hard_texts):
    for n in (2, 5):
        rows = sharding.shard_documents(spark, documents, n).collect()
        assert len(rows) == len(hard_texts)
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r)
        assert set(by) <= set(range(n))
        for own in by.values():
            assert sorted(r.slot for r in own) == list(range(len(own)))
        texts = {i if i != 3 else None: t for i, t in enumerate(hard_texts)}
        for r in rows:
            raw = (texts[r.doc_id] or "").encode()
            assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    assert sharding.shard_documents(spark, no_documents, 4).count() == 0


def test_sharding_balance_and_groups(spark):
    rng = random.Random(5)
    texts = ["w" * rng.randint(1, 400) for _ in range(3000)] + ["hot text"] * 1500 + ["warm"] * 60
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sharding.shard_documents(spark, docs, 40).collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    mean = sum(load.values()) / 40
    assert max(load.values()) < 1.02 * mean and min(load.values()) > 0.98 * mean
    assert len({r.shard for r in rows if texts[r.doc_id] == "warm"}) == 1  # a group that fits stays whole
    assert len({r.shard for r in rows if texts[r.doc_id] == "hot text"}) > 10


def test_sharding_balances_all_dimensions(spark):
    rng = random.Random(15)
    texts = [f"{i} " + " ".join("w" * rng.choice((1, 2, 30)) for _ in range(rng.choice((1, 3, 60)))) for i in range(4000)] + ["a group that fits"] * 40
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sums = np.zeros((8, 3))
    for r in sharding.shard_documents(spark, docs, 8).collect():
        sums[r.shard] += (r.size, len(texts[r.doc_id].split()), 1)
    spread = np.ptp(sums, axis=0) / sums.mean(axis=0)
    assert spread[0] < 0.02 and spread[1] < 0.04 and spread[2] < 0.04


def test_packing_goes_by_the_dot_product():
    vectors = np.array([[8, 1, 1], [1, 8, 1], [1, 1, 8], [5, 1, 1], [1, 5, 1], [1, 1, 5]], float)
    got = sharding.pack(vectors, list("abcdef"), 3)
    load = np.stack([np.bincount(got, weights=x, minlength=3) for x in vectors.T])
    assert len(set(got[:3])) == 3 or load.max() <= 9
    before = np.zeros(3, np.int64)
    after = sharding.even_out(np.ones((3, 3)) / 3, before.copy(), 3)
    assert sorted(after) == [0, 1, 2]


def test_sharding_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a")] * 7 + [(None, None)] * 3, "doc_id long, text string")
    rows = sharding.shard_documents(spark, docs, 3).collect()
    assert len(rows) == 10 and len({(r.shard, r.slot) for r in rows}) == 10


def test_language_model_sums_to_one():
    model = langid.Model.of({"a": ["the cat sat on the mat", "a rat"], "b": ["der hund und die katze"]})
    symbols = sorted({int(k) for k in model.grams[1][0]})
    for context in ("the", " xq", "und"):
        base = sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context))
        keys = np.array([base | s for s in symbols], np.uint64)
        p = np.exp(model.log_probabilities(keys).astype(float)).sum(axis=0)
        left = np.exp(model.log_probabilities(np.array([base | 0x3B1], np.uint64)).astype(float))[0]
        assert p + left == pytest.approx([1, 1], abs=1e-4)


def test_kneser_ney_by_the_definition():
    rng = random.Random(16)
    text = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(80))
    model = langid.Model.of({"x": [text]})
    padded = "   " + text
    grams = {4: Counter(padded[i : i + 4] for i in range(len(text)))}
    for k in (3, 2, 1):  # continuation counts
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    symbols = len({g[-1] for g in grams[4]}) + 1

    def probability(g, k):
        if k == 0:
            return 1 / symbols
        own, counts = g[4 - k :], grams[k]
        once, twice = (sum(n == m for n in counts.values()) for m in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        after = [n for h, n in counts.items() if h[:-1] == own[:-1]]
        lower = probability(g, k - 1)
        return max(counts[own] - discount, 0) / sum(after) + discount * len(after) / sum(after) * lower if after else lower

    asked = [padded[i : i + 4] for i in range(60)] + ["".join(rng.choice("abcde ") for _ in range(4)) for _ in range(200)]
    keys = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g)) for g in asked], np.uint64)
    assert np.exp(model.log_probabilities(keys).astype(float))[:, 0] == pytest.approx([probability(g, 4) for g in asked], rel=1e-4)


def test_rejection_of_a_language_left_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("lang is not null and n_chars > 100").select("doc_id", "text", "lang")
    langs = sorted(r.lang for r in docs.select("lang").distinct().collect())
    for out in langs:
        model = langid.train(docs.filter((F.col("lang") != out) & ~langid.held_out()))
        found = langid.identify(docs.filter(langid.held_out()), model).groupBy((F.col("lang") == out).alias("foreign")).agg(F.avg(F.col("_rejected").cast("double")).alias("rejected")).collect()
        rejected = {r.foreign: r.rejected for r in found}
        assert rejected[True] > 0.8 and rejected[False] < 0.01


def test_language_id_keeps_columns_of_any_name(spark):
    rows = [(i, "the cat sat on the mat and ran" if i % 2 else "der hund und die katze sind da", "en" if i % 2 else "de", 1, True) for i in range(30)]
    docs = spark.createDataFrame([*rows, (None, None, None, 2, None)], "doc_id long, text string, lang string, _score int, _rejected boolean")
    kept = langid.keep_identified(spark, docs)
    assert kept.columns == docs.columns and kept.count() == 30
    assert langid.identify(docs, langid.train(docs)).columns == [*docs.columns, "_lang_pred", "__score", "__rejected", "_cross_entropy"]


def test_language_id(spark, documents, no_documents):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = {r.doc_id: r for r in queries.QUERIES["op2_language_id"](spark, DATA).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(found[d].held_out for d in held) and sum(r.held_out for r in found.values()) == len(held)
    assert np.mean([found[d].lang_pred == truth[d] for d in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())
    model = langid.train(docs.filter(~langid.held_out()))
    odd = model.predict(pa.array([None, "", "123 !!", "Ωμέγα και άλφα στην αρχή του κόσμου", "𐐀𐐁𐐂", "a" * 600_000])).to_pylist()
    assert [r["lang_pred"] for r in odd[:3]] == ["und"] * 3 and all(r["rejected"] for r in odd[:4])
    assert langid.train(no_documents).predict(pa.array(["text"])).to_pylist()[0]["lang_pred"] == "und"
    assert langid.identify(no_documents, model).count() == 0
    assert langid.keep_identified(spark, docs).count() >= 0.99 * docs.count()


@pytest.mark.parametrize("n", [1, 3, 9])
def test_rare_languages_reject_too(spark, n):
    rng = random.Random(11)
    common, rare = (["".join(rng.choice(a) for _ in range(rng.randint(2, 4))) for _ in range(40)] for a in ("abcdeilmnorst", "αβγδεικλμνορστ"))
    text = lambda v: " ".join(rng.choice(v) for _ in range(120))
    rows = [(i, text(common), "c") for i in range(60)] + [(100 + i, text(rare), "r") for i in range(n)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["c", "r"] and np.isfinite(model.limit).all()
    found = model.predict(pa.array([text(rare), text(common), "".join(rng.choice("αβγ яжщюбдфц") for _ in range(500))])).to_pylist()
    assert [r["rejected"] for r in found] == [False, False, True]
    short = langid.train(spark.createDataFrame([*rows, (900, "x", "s")], "doc_id long, text string, lang string"))
    assert short.langs == ["c", "r", "s"] and np.isfinite(short.limit).all()


def test_long_text_scores_like_its_pieces():
    model = langid.Model.of({"a": ["the cat sat on the mat " * 5], "b": ["der hund und die katze " * 5]})
    text = "the cat und die mat " * 60_000
    whole, n, _ = model.entropies(pa.array([text]))
    chars, at = langid.letters(*words.text_column(pa.array([text])))
    direct = -model.log_probabilities(langid.gram_keys(chars, at)).astype(float).sum(axis=0) / len(chars)
    assert n[0] == len(chars) and whole[0] == pytest.approx(direct, rel=1e-5)


def test_quality(spark, documents, no_documents):
    rows = {r.doc_id: r for r in queries.QUERIES["op3_quality"](spark, DATA).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    held = [(d, q) for d, q in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(rows[d].held_out for d, _ in held)
    assert np.mean([rows[d].predicted == q for d, q in held]) > 0.9
    good, bad = [rows[d].score for d, q in held if q], [rows[d].score for d, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(documents, labels)
    assert quality.scored(documents, model).filter("score is null or not score between 0 and 1").count() == 0
    assert quality.train(documents, labels.limit(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert quality.scored(no_documents, model).count() == 0


def test_discriminant_by_the_definition():
    rng = np.random.default_rng(17)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + y[:, None] * np.array([1.0, -0.5, 0.2, 0.0])
    model = quality.Discriminant(x, y)
    z = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-3)
    share = np.array([(y == c).mean() for c in (0, 1)])
    pooled = sum(share[c] * np.cov(z[y == c], rowvar=False) for c in (0, 1))
    logs = []
    for c in (0, 1):
        s = (1 - model.pool) * np.cov(z[y == c], rowvar=False) + model.pool * pooled
        s = (1 - model.ridge) * s + model.ridge * np.trace(s) / 4 * np.eye(4)
        d = z - z[y == c].mean(axis=0)
        logs.append(np.log(share[c]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert model.margin(x) == pytest.approx(logs[1] - logs[0])
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(-(model.slope * (logs[1] - logs[0]) + model.shift))))


def test_quality_statistics_do_not_depend_on_neighbours(hard_texts):
    together = quality.statistics(pa.array(hard_texts))
    for i, t in enumerate(hard_texts[:40]):
        assert quality.statistics(pa.array([t], pa.string())) == pytest.approx(together[i : i + 1])
    assert np.isfinite(together).all()


def brute_pieces(v, text):
    s = pieces.BLANK + text.replace(" ", pieces.BLANK)
    best = [(0.0, None, None)] + [None] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - v.longest), e):
            p = v.table.get(s[b:e])
            if p and p[0] >= 0:
                x, ids = best[b][0] + p[1], [p[0]]
            elif e == b + 1:
                x, ids = best[b][0] + v.fallback, v.spelled(s[b])
            else:
                continue
            if best[e] is None or x > best[e][0]:
                best[e] = (x, b, ids)
    out, at = [], len(s)
    while at:
        out[:0] = best[at][2]
        at = best[at][1]
    return out


def vocabularies():
    rng = random.Random(6)
    real = pieces.Vocabulary.load()
    units = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 5))) for _ in range(40)} | {"a", "b", "▁"})
    crossing = pieces.Vocabulary([("<unk>", 0.0)] + [(u, -rng.random() * 5) for u in units] + [(f"<0x{b:02X}>", 0.0) for b in range(256)], {b: len(units) + 1 + b for b in range(256)})
    return [real, crossing]


@pytest.mark.parametrize("v", vocabularies(), ids=["words", "crossing"])
def test_pieces(v):
    rng = random.Random(8)
    codec = pieces.Codec(v)
    texts = ["", " ", "  ", "a", "ab ba", " a  b ", "\n", "a\n\nb", "é", "日本", "▁", "a▁ b", "😀 x\0y", "ab" * 700]
    texts += ["".join(rng.choice("ab  \n\té") for _ in range(rng.randint(0, 80))) for _ in range(150)]
    for t in texts:
        ids = list(codec.encode(t))
        assert codec.decode(ids) == t
        if t and pieces.BLANK not in t:
            assert ids == brute_pieces(v, t)
            marked = pieces.BLANK + t.replace(" ", pieces.BLANK)
            assert [i for part in pieces.stream(v, marked, check=8) for i in part] == ids


@pytest.mark.parametrize("v", vocabularies(), ids=["words", "crossing"])
def test_pieces_side_by_side(v):
    """Windows that are walked side by side have the ids of stream(), and no window of a learned batch is left to be streamed alone."""
    rng = random.Random(5)
    windows = ["".join(rng.choice("abéß日😀 \t.Ting▁") for _ in range(rng.randint(1, 24))).replace(" ", pieces.BLANK) for _ in range(400)] + [pieces.BLANK + w for w in ("the", "wonderful" * 6, "a")]
    for w, ids in zip(windows, pieces.side_by_side(v, v.arrays(), windows), strict=True):
        want = [i for part in pieces.stream(v, w) for i in part]
        assert list(ids) == want if ids is not None else any(c not in v.table for c in w)
    if v.cut_at_blanks and "\n" in v.alone:
        texts = [None, "", *(" ".join("".join(rng.choice("tingaeo") for _ in range(rng.randint(1, 9))) + "\n" * (rng.random() < 0.2) for _ in range(200)) for _ in range(3))]
        codec, plain = pieces.Codec(v), pieces.Codec(v)
        codec.learn(texts)
        known = len(codec.led) + len(codec.bare)
        assert known > 300 and all(codec.encode(t) == plain.encode(t) for t in texts if t is not None)
        assert len(codec.led) + len(codec.bare) <= known + 3  # the line feed, and what few windows after one there are


def test_pieces_leave_as_they_become_certain():
    v = vocabularies()[0]
    portions = list(pieces.stream(v, pieces.BLANK + ("wonderful" * 300), check=64))
    assert len(portions) > 20


def test_pieces_against_a_unigram_model():
    from tokenizers import Tokenizer, models

    rng = random.Random(10)
    units = {"a": -3.1, "b": -2.7, "c": -3.3, "▁": -2.9} | {"".join(rng.choice("abc") for _ in range(n)): -rng.random() * 6 - 1 for n in (2, 3, 4, 5) for _ in range(9)}
    vocabulary = [("<unk>", -20.0), *units.items()]
    other = Tokenizer(models.Unigram(vocabulary, unk_id=0))
    v = pieces.Vocabulary(vocabulary, {})
    for _ in range(100):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        score = lambda ids: sum(vocabulary[i][1] for i in ids)
        ours = [i for part in pieces.stream(v, s, check=8) for i in part]
        assert score(ours) == pytest.approx(score(other.encode(s).ids))


def test_pieces_of_whole_texts_against_a_unigram_model(spark):
    import sentencepiece
    from tokenizers import Tokenizer, models

    model, v = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Vocabulary.load()
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    low = min(map(model.get_score, own))
    scores = {i: model.get_score(i) for i in own}
    other = Tokenizer(models.Unigram([(model.id_to_piece(i), scores.get(i, low)) for i in range(model.get_piece_size())], unk_id=0, byte_fallback=True))
    codec = pieces.Codec(v)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text and pieces.BLANK not in r.text]
    assert len(texts) > 150
    for t in texts:
        assert list(codec.encode(t)) == other.encode(pieces.BLANK + t.replace(" ", pieces.BLANK), add_special_tokens=False).ids


def test_pieces_in_spark(spark, documents, no_documents, hard_texts):
    v = pieces.Vocabulary.load()
    rows = pieces.encoded(documents, v, digests=True).collect()
    assert len(rows) == len(hard_texts) and all(r.same in (True, None) for r in rows)
    assert sum(r.ids is None for r in rows) == sum(t is None for t in hard_texts)
    assert pieces.encoded(no_documents, v).count() == 0


def test_exchange_round_trips():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        x = np.sort(rng.integers(0, 1 << 62, n).astype(np.uint64))
        assert (exchange.unpack(exchange.pack(x, True), True) == x).all()
        y = rng.integers(0, 300, n)
        assert (exchange.unpack(exchange.pack(y)) == y).all()


def test_words(hard_texts, monkeypatch):
    for piece in (1 << 20, 7):
        monkeypatch.setattr(words, "PIECE", piece)
        data, offsets = words.text_column(pa.array(hard_texts))
        h, at, first, end = words.word_hashes(data, offsets, spans=True)
        expected = [w for t in hard_texts for w in split(t)]
        assert [bytes(data[a:b]) for a, b in zip(first, end, strict=True)] == expected
        assert np.diff(at).tolist() == [len(split(t)) for t in hard_texts]
        seen = {}
        assert all(seen.setdefault(w, x) == x for w, x in zip(expected, h, strict=True)) and len(set(seen.values())) == len(seen)
        sets, places = words.shingle_sets(pa.array(hard_texts))
        assert np.diff(places).tolist() == [len(shingles(t)) for t in hard_texts]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, DATA), queries.SQL[name])
