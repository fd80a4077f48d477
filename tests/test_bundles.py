"""Closures, bundles and flattened names against plain Python."""

import random

import pytest

from tallyloom.operators import bundles
from tallyloom.operators.contracts import flat_names


@pytest.mark.parametrize("steps", [6, 1, 3])
def test_closure(spark, steps):
    """Deeper than a round, with cycles, by group, and names that nothing defines."""
    chain = [(f"n{i}", f"n{i + 1}") for i in range(10)]
    edges = [*chain, ("n4", "n2"), ("a", "b"), ("b", "a"), ("b", "b"), ("x", "y"), ("n10", None)][:-1]
    roots = [("g", "n0"), ("g", "n0"), ("h", "a"), ("h", "n8"), ("k", "nowhere")]
    got = bundles.closure(spark.createDataFrame(roots, "part string, name string"), spark.createDataFrame(edges, "name string, uses string"), ("part",), steps)
    uses = {}
    for a, b in edges:
        uses.setdefault(a, []).append(b)
    want = set()
    for part, name in roots:
        todo = [name]
        while todo:
            x = todo.pop()
            if (part, x) not in want:
                want.add((part, x))
                todo += uses.get(x, [])
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert bundles.closure(got.limit(0), spark.createDataFrame(edges, "name string, uses string"), ("part",), steps).count() == 0


def test_the_plan_of_a_closure_does_not_grow(spark):
    def plan(n):
        edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(n)], "name string, uses string")
        return len(bundles.closure(spark.createDataFrame([("0",)], "name string"), edges, (), 2)._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert plan(20) - plan(10) <= 12  # a written table for each round, and nothing of how it came about


def plain_names(paths):
    taken, out = set(), {}
    for p in sorted(paths):
        parts = p.rstrip("/").split("/")
        base, parent = parts[-1], (parts[-2] if len(parts) > 1 else "") or "root"
        name, n = base, 1
        while name in taken:
            name = f"{parent}__{base}" if n == 1 else f"{parent}__{n}__{base}"
            n += 1
        taken.add(name)
        out[p] = name
    return out


def test_flat_names(spark):
    rng = random.Random(2)
    paths = {"/" + "/".join(rng.choice(["a", "b", "2", "a__b"]) for _ in range(rng.randint(0, 3))) + "/" + rng.choice(["m.c", "a__m.c", "b__2__m.c", "q.c", "2__q.c", "z.h"]) for _ in range(300)}
    paths |= {"m.c", "//m.c", "/w/z.h"}
    rows = spark.createDataFrame([(p, i, i) for i, p in enumerate(sorted(paths))], "path string, row int, parent int")
    got = {r.path: r.flat_name for r in flat_names(rows).collect()}
    assert got == plain_names(paths) and len(set(got.values())) == len(paths)


def test_a_ladder_is_short(spark):
    ladder = spark.range(bundles.LADDER + 1).selectExpr("cast(id as string) as checkpoint", "array('-a') as allowed")
    with pytest.raises(ValueError):
        bundles.kept_cases(spark.createDataFrame([(["-a"], None)], "flags array<string>, absent_flags array<string>"), ladder)


def test_nothing_to_bundle(spark):
    from tallyloom.plans.bundle_queries import material
    from tests.conftest import DATA

    cases, ladder, definitions, references = material(spark, DATA)
    members = bundles.payload(cases.limit(0), ladder, definitions, references)
    assert {r["path"] for r in members.collect()} == {"config.json", "checks.py"}
    assert all(r["cases_included"] == 0 for r in bundles.manifests(members).collect())
