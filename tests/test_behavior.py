"""Verdict traces by bitmaps and by counting, against pairs in plain Python."""

import random
from itertools import combinations

import pytest

from tallyloom.operators import behavior as B
from tallyloom.operators import distance
from tallyloom.plans import catalog


@pytest.mark.parametrize("block, verdicts", [(512, 2), (3, 9)])
def test_disagreement(spark, monkeypatch, block, verdicts):
    monkeypatch.setattr(distance, "BLOCK", block)
    rng = random.Random(1)
    traces = {}
    for g in ("a", "b", "c"):
        for run in range(1 if g == "c" else 17):
            cases = [f"c{i}" for i in range(4 if g == "a" and run % 5 == 0 else 11)]
            traces[g, run] = {c: rng.choice([*(f"v{k}" for k in range(verdicts)), None]) for c in cases}
    rows = [(g, run, c, v) for (g, run), t in traces.items() for c, v in t.items()]
    rng.shuffle(rows)
    results = spark.createDataFrame(rows, "g string, run int, case_id string, verdict string")
    got = {(r.g, r.left, r.right): (r.n_cases, r.distance) for r in B.disagreement(results, ["g"]).collect()}
    want = {}
    for (g, u), (h, v) in combinations(sorted(traces), 2):
        if g == h:
            a, b = traces[g, u], traces[g, v]
            same = set(a) == set(b)
            want[g, u, v] = (len(a), pytest.approx(sum(a[c] != b[c] for c in a) / len(a))) if same else (None, None)
    assert got == want
    totals = {r.g: r for r in B.disagreement_totals(results, ["g"]).collect()}
    for g in "abc":
        own = [x[1] for k, x in got.items() if k[0] == g]
        bad = sum(x is None for x in own)
        t = totals[g]
        assert (t.n_pairs, t.incomparable) == (len(own), bad) and (t.mean_distance is None) == (bad > 0 or not own) == (t.reason is not None)
        if t.mean_distance is not None:
            assert t.mean_distance == pytest.approx(sum(own) / len(own))


def test_summary_of_few_runs(spark):
    results = spark.createDataFrame([("visible", 1, "c", "PASS")], "scope string, run int, case_id string, verdict string")
    runs = spark.createDataFrame([(1, True), (2, True), (3, False)], "run int, success boolean")
    labels = spark.createDataFrame([(1, "x", None)], "run int, architecture string, strategy string")
    got = {r.scope: r for r in B.behavior_summary(results, runs, labels).collect()}
    assert set(got) == {"visible", "combined"}
    r = got["combined"]
    assert (r.coverage, r.mean_distance, r.reason, r.architecture_ari, r.architecture_reason, r.strategy_runs) == (0.5, None, "fewer than two runs", None, "fewer than two shared runs", 0)


def test_a_mean_of_just_fifty_in_any_order(spark, tmp_path):
    """Cents that make 50 on average fail, and one cent more passes, however the sums of doubles are rounded."""
    rng, rows = random.Random(3), []
    for user in range(300):
        cents = [rng.randrange(10_000) for _ in range(rng.randrange(2, 19))]
        cents.append(5000 * (len(cents) + 1) - sum(cents) + (user % 3 == 0))
        rows += [(user, "view", c / 100) for c in cents]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.verdict: r.n for r in catalog.queries()["trace_counts"](spark, str(tmp_path)).collect()}
    assert got == {"PASS": 100, "FAIL": 200}
    pairs = catalog.queries()["verdict_disagreement"](spark, str(tmp_path))
    assert pairs.filter("distance <> cast((left % 3 = 0) <> (right % 3 = 0) as int)").count() == 0
    prints = catalog.queries()["behavior_fingerprint"](spark, str(tmp_path))
    assert prints.groupBy("fingerprint").count().count() == 2
