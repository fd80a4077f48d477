"""Exact small cases of rates, families and clustering."""

import difflib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA, same_rows

from tallyloom.functions.stats import pass_at_k, register, wilson
from tallyloom.operators import cluster as C
from tallyloom.operators import distance as D
from tallyloom.operators import families as A
from tallyloom.operators import reliability as R
from tallyloom.plans import catalog


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_wilson(spark):
    w = one(spark, wilson(F.lit(7), F.lit(10)).alias("w"))["w"]
    assert round(w["lower"], 3) == 0.397 and round(w["upper"], 3) == 0.892 and w["estimate"] == 0.7
    none = one(spark, wilson(F.lit(0), F.lit(0)).alias("w"))["w"]
    assert none["estimate"] is None and none["lower"] is None and none["upper"] is None
    zero = one(spark, wilson(F.lit(0), F.lit(10)).alias("w"))["w"]
    assert zero["lower"] == 0 and round(zero["upper"], 2) == 0.28
    with pytest.raises(Exception, match="successes"):
        one(spark, wilson(F.lit(11), F.lit(10)).alias("w"))


def test_pass_at_k(spark):
    got = one(spark, *[pass_at_k(F.lit(n), F.lit(c), k).alias(f"k{i}") for i, (n, c, k) in enumerate([(10, 7, 1), (10, 7, 3), (10, 7, 5), (10, 0, 5), (3, 1, 5)])])
    assert [None if x is None else round(x, 5) for x in got] == [0.7, 0.99167, 1.0, 0.0, None]


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("select pass_at_k(10, 7, 3) p, wilson_lower(7, 10) l, wilson_upper(7, 10) u").first()
    assert (round(row.p, 5), round(row.l, 3), round(row.u, 3)) == (0.99167, 0.397, 0.892)


def test_discovery(spark):
    labels = spark.createDataFrame([("a",), ("a",), ("b",), ("b",)], "f string")
    curve = {r.k: r.df for r in A.discovery_curve(labels, [], "f").collect()}
    assert curve[1] == pytest.approx(1) and curve[2] == pytest.approx(5 / 3) and curve[4] == pytest.approx(2)
    assert A.expected_families(labels, [], "f", 2).first()[0] == pytest.approx(5 / 3)
    assert A.expected_families(labels, [], "f", 5).first()[0] is None
    points = lambda ys: spark.createDataFrame(list(enumerate(map(float, ys), 1)), "k int, df double")
    assert A.discovery_auc(points([1, 1, 1, 1]), []).first()["auc"] == 1.0
    assert A.discovery_auc(points([1, 2, 3, 4]), []).first()["auc"] == 2.5
    short = A.discovery_auc(points([1, 2]), [], 5).first()
    assert short["auc"] is None and "N=2" in short["reason"]


def test_family_stats(spark):
    got = A.family_stats(spark.createDataFrame([(1,), (1,), (2,), (3,)], "f int"), [], "f").first()
    assert got["raw_count"] == 3 and got["dominant_share"] == 0.5 and got["singleton_rate"] == 0.5
    assert got["effective_count"] == pytest.approx(math.exp(0.5 * math.log(2) + 0.5 * math.log(4)))


def test_adjusted_rand(spark):
    df = lambda a, b: spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int")
    assert A.adjusted_rand(df([0, 0, 1, 1], [1, 1, 0, 0]), [], "a", "b").first()["ari"] == 1.0
    assert A.adjusted_rand(df([0, 0, 1, 1], [0, 1, 0, 1]), [], "a", "b").first()["ari"] == pytest.approx(-0.5)
    trivial = A.agreement(df([0, 0, 0], [0, 1, 1]), [], "a", "b").first()
    assert trivial["ari"] is None and "trivial" in trivial["reason"]
    assert A.agreement(df([0], [0]), [], "a", "b").first()["reason"] == "fewer than two shared runs"
    assert C.rand_index(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])) == pytest.approx(-0.5)


def test_exact_repetition(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "h string, run int")
    got = A.exact_repetition(rows, [], "h", "run").first()
    assert got["unique_rate"] == 0.75 and got["modal_share"] == 0.5
    gap = A.exact_repetition(rows.unionByName(spark.createDataFrame([(None, 5)], "h string, run int")), [], "h", "run").first()
    assert gap["unique_rate"] is None and gap["modal_share"] is None


def test_vendi():
    assert C.vendi(np.eye(4))[0] == pytest.approx(4)
    assert C.vendi(np.array([[1.0, 0], [1, 0]]))[0] == pytest.approx(1)
    assert C.vendi(np.zeros((1, 3)))[0] == pytest.approx(1)
    assert C.vendi(np.zeros((3, 0)))[0] == pytest.approx(1)
    assert C.vendi(np.zeros((0, 3)))[0] is None
    assert C.vendi(np.array([[np.nan]]))[0] is None


def brute_linkage(d, threshold):
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        pairs = [(np.mean([d[x][y] for x in a for y in b]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        height, i, j = min(pairs)
        if height >= threshold:
            break
        groups[i] += groups.pop(j)
    out = np.zeros(len(d), int)
    for k, g in enumerate(sorted(groups, key=lambda g: (-len(g), min(g)))):
        out[g] = k
    return out


def test_average_linkage_against_brute_force():
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 25):
        x = rng.normal(size=(n, 4))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        d = C.cosine_matrix(x)
        merges = C.average_linkage(d)
        for t in (0.1, 0.5, 0.9, 1.5):
            assert (C.cut(n, merges, t) == brute_linkage(d, t)).all()


def test_cosine_of_zero_rows():
    d = C.cosine_matrix(np.array([[0.0, 0], [0, 0], [1, 0]]))
    assert d.tolist() == [[0, 0, 1], [0, 0, 1], [1, 1, 0]]


def test_thresholds():
    assert C.threshold_grid(0.05) == [0.025, 0.05, 0.075, 0.1, 0.15]
    assert C.threshold_grid(1, "0.2, 0.4") == [0.2, 0.4]
    with pytest.raises(ValueError):
        C.threshold_grid(1, [0.0])


def test_linkage_of_repeated_rows_and_up_to_a_height():
    """Rows that count several times give the clusters of as many equal rows; a stop leaves out only what a cut there would."""
    rng = np.random.default_rng(6)
    for n in (2, 5, 30):
        x = rng.normal(size=(n, 3))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        times = rng.integers(1, 4, n)
        place = np.repeat(np.arange(n), times)
        d, whole = C.cosine_matrix(x), C.cosine_matrix(x[place])
        for t in (0.1, 0.4, 1.1):
            short = C.cut(n, C.average_linkage(d, times, t), t)[place]
            full = C.cut(len(place), C.average_linkage(whole), t)
            assert C.rand_index(short, full) == 1.0 and sorted(np.bincount(short)) == sorted(np.bincount(full))


def test_bootstrap_is_the_same_in_any_chunks(spark):
    rng = np.random.default_rng(1)
    rows = [("g", i, [float(v) for v in rng.normal(size=3)]) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, run int, vector array<double>")
    get = lambda chunk: {r.metric: (r.lower, r.upper, r.replicates) for r in C.bootstrap(df, ["g"], 0.5, 30, chunk=chunk, k_max=4).collect()}
    assert get(30) == get(7) and len(get(7)) == 5


def test_success_rates_without_valid_attempts(spark):
    rows = spark.createDataFrame([("a", True, True), ("b", False, None)], "g string, infrastructure_failure boolean, success boolean")
    got = {r.g: r for r in R.success_rates(rows, ["g"]).collect()}
    assert got["a"]["conditional_rate"] is None and got["a"]["end_to_end_rate"] == 1.0 and got["b"]["conditional_rate"] == 0.0


def test_whole_tables(spark):
    """Queries that were bound to the first ids take every row."""
    n = {t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("embeddings", "events", "benchmark", "conversations")}
    vectors, items = n["embeddings"].count(), n["benchmark"].count()
    users = n["events"].filter("user_id is not null").select("user_id").distinct().count()
    run = lambda q: catalog.queries()[q](spark, DATA)
    assert run("clusters").count() == vectors and run("vendi").first()["n"] == vectors
    assert run("winnow_pairs").count() == run("levenshtein_pairs").count() == items * (items - 1) // 2
    assert run("cosine_pairs").count() == vectors * (vectors - 1) // 2
    assert run("behavior_fingerprint").count() == users
    turns = {}
    for r in n["conversations"].orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.text))
    expected = {}
    for c, own in turns.items():
        for (_, a), (t, b) in zip(own, own[1:], strict=False):
            if a is not None and b is not None:
                marks = [x[:2] for x in difflib.ndiff(a.splitlines(), b.splitlines())]
                expected[(c, t)] = (marks.count("+ "), marks.count("- "))
    assert {(r.conv_id, r.turn): (r.added, r.deleted) for r in run("line_churn").collect()} == expected
    runs = spark.range(30).select(F.lit("all").alias("space"), F.col("id").alias("run"))
    assert D.pairs_of(runs, ["space"]).count() == 435
    limit, D.MAX_ROWS = D.MAX_ROWS, 29
    with pytest.raises(Exception, match="too large for all pairs"):
        D.pairs_of(runs, ["space"]).count()
    D.MAX_ROWS = limit


def test_levenshtein_of_all_letters(spark, tmp_path):
    texts = ["kitten", "sitting", "é", "ée", "日本語", "日本", ""]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    got = {(r["left"], r["right"]): r["distance"] for r in catalog.queries()["levenshtein_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(i, j): round(edits(a, b) / max(len(a), len(b)), 6) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j}


@pytest.mark.parametrize("query", ["feature_distances", "cosine_pairs", "mean_pairwise", "population_structure", "representatives", "silhouette", "verdict_disagreement"])
def test_groups_of_any_size(spark, monkeypatch, query):
    """Groups above the bound of pairs_of() are cut into blocks, several of each kind here, for the same rows as SQL."""
    for name, value in {"MAX_ROWS": 29, "BLOCK": 40, "SIDE": 4, "MOST": 60, "STRIP": 16}.items():
        monkeypatch.setattr(D, name, value)
    same_rows(catalog.queries()[query](spark, DATA), catalog.oracle_sql()[query])


@pytest.mark.parametrize("query", ["feature_distances", "cosine_pairs"])
def test_pairs_are_made_from_runs_not_from_rows_of_whole_blocks(spark, query):
    """Rows that hold a block of runs are of several MB each at 1 GB, and their sorts took more heap than an executor has."""
    plan = catalog.queries()[query](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(run" not in plan and "FlatMapGroupsInArrow" in plan


def test_pairs_of_text_runs_with_nulls_copies_and_masks(spark, monkeypatch):
    """Runs without a name are in no pair, runs of one name don't meet, parts are of any size."""
    rng = np.random.default_rng(4)
    rows = [("gh"[i % 2], f"r{i % 40}" if i % 10 else None, [float(x) for x in rng.integers(-2, 3, 3)], i % 4) for i in range(90)]
    rows.append(("i", "only", [1.0, 0.0, 0.0], 3))
    want, common = [], []
    for g, a, x, m in rows:
        for h, b, y, k in rows:
            if g == h and a is not None and b is not None and a < b:
                norms = (np.linalg.norm(x), np.linalg.norm(y))
                d = 1 - np.dot(x, y) / np.prod(norms) if all(norms) else float(any(norms))
                want.append((g, a, b, round(d, 3)))
                common += [(g, a, b, m & k)] if m & k else []
    df = spark.createDataFrame(rows, "g string, run string, vector array<double>, mask long")
    for sizes in ({}, {"BLOCK": 7, "SIDE": 4, "MOST": 9, "STRIP": 3, "PART": 5}):
        for name, value in sizes.items():
            monkeypatch.setattr(D, name, value)
        got = sorted((r.g, r.left, r.right, round(r.distance, 3)) for r in D.vector_pairs(df, ["g"], "run", "vector", digits=9).collect())
        assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and [r[3] for r in got] == pytest.approx([r[3] for r in sorted(want)], abs=0.0011)
        assert sorted((r.g, r.left, r.right, r.mask) for r in D.vector_pairs(df, ["g"], "run", "vector", "mask").collect()) == sorted(common)
    assert D.rounded_half_up(np.array([0.0, 0.125, 0.375, 1.9999999, 2.0]), 2).tolist() == [0.0, 0.13, 0.38, 2.0, 2.0]


def test_distances_of_zero_rows_and_families_without_a_label(spark):
    rows = [("g", 1, 0, [0.0, 0.0]), ("g", 2, 0, [None, 0.0]), ("g", 3, 1, [3.0, 0.0]), ("g", 4, 1, [0.0, 2.0]), ("g", 5, None, [1.0, 0.0]), ("h", 1, 7, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "g string, run int, family int, vector array<double>")
    mean = {r.g: (r.mean_distance, r.n_pairs) for r in D.vector_mean(v, ["g"], "run", "vector").collect()}
    assert mean == {"g": (pytest.approx(8 / 10), 10), "h": (0.0, 0)}
    pairs = D.vector_pairs(v, ["g"], "run", "vector")
    assert {(r.left, r.right): r.distance for r in pairs.collect()} == {(a, b): 0.0 if (a, b) in ((1, 2), (3, 5)) else 1.0 for a in range(1, 6) for b in range(a + 1, 6)}
    got = {(r.g, r.family): (r["size"], r.medoid, r.mean_distance, r.max_distance) for r in D.vector_representatives(v, ["g"], "run", "vector", "family").collect()}
    assert got == {("g", 0): (2, 1, 0.0, 0.0), ("g", 1): (2, 3, 1.0, 1.0), ("g", None): (1, 5, 0.0, 0.0), ("h", 7): (1, 1, 0.0, 0.0)}
    labels = v.select("g", "run", "family")
    assert sorted(D.vector_silhouette(v, ["g"], "run", "vector", "family").collect()) == sorted(D.silhouette(labels, pairs, ["g"]).filter("g = 'g'").collect() + [("h", 1, 1, None)])


def test_rounds_of_mutual_neighbours():
    rng = np.random.default_rng(7)
    for n in (1, 2, 40, 300):
        x = rng.normal(size=(n, 4))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        times = rng.integers(1, 4, n)
        for t in (0.05, 0.4, 1.2):
            want = C.cut(n, C.average_linkage(C.cosine_matrix(x), times), t)
            got = C.linked(x, times, t)
            assert len(set(got)) == want.max() + 1 and C.rand_index(np.unique(got, return_inverse=True)[1], want) == 1.0


@pytest.mark.parametrize("operator", ["clusters", "sensitivity", "vendi", "bootstrap", "linkage", "ablation"])
def test_clusters_of_large_groups(spark, monkeypatch, operator):
    """Groups above the bound for one task have the same results; with copies, zero rows and a small group beside them."""
    rng = np.random.default_rng(8)
    rows = [(g, i, [float(v) for v in rng.normal(size=3)]) for g, n in (("big", 90), ("small", 7)) for i in range(n)]
    rows += [("big", 100 + i, rows[i][2]) for i in range(5)] + [("big", 200 + i, [0.0, 0.0, 0.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, run int, vector array<double>")
    features = spark.createDataFrame([(g, i, "a" if k < 2 else "b", str(k), float(v)) for g, i, x in rows for k, v in enumerate(x)], "g string, run int, block string, feature string, value double")

    def result():
        if operator == "clusters":
            return sorted(map(tuple, C.clusters(df, ["g"], 0.3).collect()))
        if operator == "sensitivity":
            out = C.sensitivity(df, ["g"], 0.3).collect()
        elif operator == "vendi":
            out = C.vendi_scores(df, ["g"]).collect()
        elif operator == "bootstrap":
            out = C.bootstrap(df, ["g"], 0.3, 30, chunk=12, k_max=5).collect()
        elif operator == "ablation":
            out = C.ablation(features, ["g"], {"both": ["a", "b"], "a": ["a"]}, 0.3).collect()
        else:
            out = C.linkage_table(df, ["g"]).filter("distance > 1e-9").collect()
            assert C.linkage_table(df, ["g"]).groupBy("g").agg(F.count("*").alias("n"), F.max("step").alias("m"), F.max("size").alias("s")).filter("n <> m + 1 or n <> s - 1").count() == 0
        return sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in out)

    want = result()
    monkeypatch.setattr(C, "MAX_RUNS", 20)
    monkeypatch.setattr(C, "LAST", 20)
    monkeypatch.setattr(D, "BLOCK", 30)
    assert result() == want


def test_ablation_labels_its_groups_once(spark):
    """What statistics and agreement read are written labels, so the plan that is run has no clustering in it, whose work would be done anew with each use."""
    rows = [("g", i, "ab"[k % 2], str(k), float(1 + (i * (k + 3)) % 5 + (k == i % 4) * 9)) for i in range(12) for k in range(4)]
    features = spark.createDataFrame(rows, "g string, run int, block string, feature string, value double")
    out = C.ablation(features, ["g"], {"both": ["a", "b"], "a": ["a"]}, 0.3)
    assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.g, r.representation, r.n) for r in out.collect()} == {("g", "both", 12), ("g", "a", 12)}


def test_listed_near_pairs_give_the_clusters_of_all_rows():
    """Replicates compare listed pairs only, instead of all rows that were drawn, and begin with tight groups: copies, near copies, rows that weren't drawn, and chains."""
    rng = np.random.default_rng(9)
    for n, t in ((2, 0.4), (60, 0.2), (300, 0.1), (300, 0.5)):
        x = rng.normal(size=(n, 6))
        x = np.concatenate([x, x[: n // 4] + rng.normal(size=(n // 4, 6)) * 0.01, x[: n // 8] + rng.normal(size=(n // 8, 6)) * 0.2])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.triu_indices(len(x), 1)
        d = ((1 - np.einsum("ij,ij->i", x[a], x[b])) + C.SNAP) - C.SNAP
        a, b, d = a[d < t], b[d < t], d[d < t]
        tight = C.tight_groups(len(x), a, b, d, t)
        times = rng.integers(0, 3, len(x)).astype(float)
        drawn = np.flatnonzero(times)
        want = np.unique(C.linked(x[drawn], times[drawn], t), return_inverse=True)[1]
        for groups in (None, tight):
            got = np.unique(C.near_roots(x, times, a, b, d, t, groups)[drawn], return_inverse=True)[1]
            assert got.max() == want.max() and C.rand_index(got, want) == 1.0


def test_bootstrap_with_too_many_near_pairs_to_list(spark, monkeypatch):
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([("g", i, [float(v) for v in rng.normal(size=3)]) for i in range(60)], "g string, run int, vector array<double>")
    get = lambda: sorted((r.metric, round(r.lower, 8), round(r.upper, 8), r.replicates) for r in C.bootstrap(df, ["g"], 0.3, 20, chunk=6, k_max=4).collect())
    want = get()
    monkeypatch.setattr(C, "MAX_RUNS", 20)
    for sparse in (32, 0):
        monkeypatch.setattr(C, "SPARSE", sparse)
        assert get() == want


def test_pairs_of_blocks_shuffle_no_vectors(spark):
    """A pair of blocks is two numbers; the blocks are read from the shared folder, so disk doesn't grow with how many each one meets."""
    plan = catalog.queries()["cosine_pairs"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\bv#", plan) and "_cell" in plan


def test_clusters_meet_without_a_shuffle_of_their_blocks(spark):
    rows = spark.createDataFrame([("g", i, [float(i % 7), 1.0, float(i % 3)]) for i in range(30)], "g string, run int, v array<double>")
    plans = [C.nearest_clusters(rows, ["g"]), D.vector_silhouette(rows.withColumn("f", F.col("run") % 4), ["g"], "run", "v", "f")]
    for plan in (p._jdf.queryExecution().optimizedPlan().toString() for p in plans):
        assert "_m_u" not in plan and "_cell" in plan
