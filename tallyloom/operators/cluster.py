"""Average-linkage clustering, Vendi scores, threshold sensitivity and bootstrap intervals.

Groups (space, population) of at most MAX_RUNS runs take a whole distance matrix, in one task each. Larger groups have none: the mean distance of two clusters of unit rows is 1 less the product
of their means, so clusters are kept as means, blocks of them meet in pairs, and all pairs of clusters that are each other's nearest are merged in a round. As no merge brings two clusters nearer
to each other than the nearer one of its parts was, that gives the merges of the one-by-one order; and clusters without a neighbour below the height in question are done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import distance as D
from tallyloom.plans.shared import ranked, written

MAX_RUNS, LAST = 2000, 16_384
SPARSE = 32  # near pairs for each row of two blocks, and of a group, up to which they are listed
SNAP = 1.5 * 2.0**12  # added and taken off again, it leaves multiples of 2^-40, so that heights are equal whatever the order of their sums


def cosine_matrix(x: np.ndarray) -> np.ndarray:
    """Distances of rows of unit norm or zero; zero rows are equal to each other and at 1 from all others."""
    zero = ~x.any(axis=1)
    d = 1 - np.clip(x @ x.T, -1, 1)
    d[np.ix_(zero, zero)] = 0
    d[np.ix_(zero, ~zero)] = d[np.ix_(~zero, zero)] = 1
    np.fill_diagonal(d, 0)
    return np.clip(d, 0, 2)


def average_linkage(distance: np.ndarray, sizes: np.ndarray | None = None, stop: float = np.inf) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) by mean distance; ties go to the pair of the smallest first members.

    Every row keeps its nearest neighbour, and only rows whose neighbour was merged look for another one. sizes: how often each row counts. stop: merges from this height on are left out
    (heights never fall).
    """
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, merges = np.ones(n) if sizes is None else sizes.astype(float), []
    if n < 2:
        return merges
    near = d.argmin(axis=1)
    height = d[np.arange(n), near]
    for _ in range(n - 1):
        a = int(np.argmin(height))
        b = int(near[a])
        if not height[a] < stop:
            break
        merges.append((a, b, float(height[a])))
        row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        row[[a, b]] = np.inf
        size[a] += size[b]
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf
        height[b] = np.inf
        again = np.flatnonzero(((near == a) | (near == b)) & np.isfinite(height))
        closer = np.flatnonzero((row < height) | (row == height) & (a < near))
        near[closer], height[closer] = a, row[closer]
        again = np.union1d(again, a)
        near[again] = d[again].argmin(axis=1)
        height[again] = d[again, near[again]]
    return merges


def cut(n: int, merges: list[tuple[int, int, float]], threshold: float) -> np.ndarray:
    """Labels where only merges below the threshold count; numbered by descending size, then first member."""
    root = np.arange(n)
    for a, b, height in merges:
        if height < threshold:
            root[root == b] = a
    _, first, label, size = np.unique(root, return_index=True, return_inverse=True, return_counts=True)
    rank = np.empty(len(first), int)
    rank[np.lexsort((first, -size))] = np.arange(len(first))
    return rank[label]


def threshold_grid(primary: float, given: str | list[float] | None = None) -> list[float]:
    """The given thresholds, or seven around the primary one; positive ones only."""
    if given is not None:
        values = [float(x) for x in given.split(",") if x.strip()] if isinstance(given, str) else [float(x) for x in given]
        if min(values, default=1) <= 0:
            raise ValueError("thresholds must be positive")
        return values
    return [round(primary + o, 10) for o in (-0.1, -0.05, -0.025, 0, 0.025, 0.05, 0.1) if primary + o > 0]


def entropy_count(labels: np.ndarray) -> tuple[float, float, float]:
    """Effective count, dominant share, singletons over n."""
    sizes = np.bincount(labels)
    p = sizes[sizes > 0] / len(labels)
    return float(np.exp(-(p * np.log(p)).sum())), float(p.max()), float((sizes == 1).sum() / len(labels))


def vendi(x: np.ndarray, tolerance: float = 1e-8) -> tuple[float | None, str | None]:
    """Effective number of rows by the eigenvalues of their similarities; zero rows share an axis of their own.

    Of the two Gram matrices, with the same positive eigenvalues, the smaller one is decomposed.
    """
    if x.ndim != 2 or not len(x):
        return None, "empty structural representation"
    if not np.isfinite(x).all():
        return None, "non-finite structural representation"
    wide = np.hstack([x, (~x.any(axis=1)).astype(float)[:, None]])
    return effective_number(wide @ wide.T if len(wide) <= wide.shape[1] else wide.T @ wide, tolerance)


def effective_number(gram: np.ndarray, tolerance: float = 1e-8) -> tuple[float | None, str | None]:
    """The exponential of the entropy of a Gram matrix's eigenvalues, or why there is none."""
    if not np.isfinite(gram).all():
        return None, "non-finite structural representation"
    values = np.linalg.eigvalsh((gram + gram.T) / 2)
    if values.min() < -tolerance:
        return None, "Gram matrix has materially negative eigenvalues"
    values = np.clip(values, 0, None)
    if values.sum() <= 0:
        return None, "zero-trace Gram matrix"
    p = values / values.sum()
    p = p[p > 0]
    return float(np.exp(-(p * np.log(p)).sum())), None


def rand_index(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted Rand index; 1 where both labelings agree by necessity."""
    cells = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(cells, (a, b), 1)
    two = lambda v: (v * (v - 1) / 2).sum()
    ij, i, j, all_pairs = two(cells), two(cells.sum(axis=1)), two(cells.sum(axis=0)), len(a) * (len(a) - 1) / 2
    expected, most = i * j / all_pairs if all_pairs else 0, (i + j) / 2
    return 1.0 if most == expected else float((ij - expected) / (most - expected))


def mean_silhouette(distance: np.ndarray, labels: np.ndarray) -> float | None:
    n, k = len(labels), labels.max() + 1
    if not 2 <= k < n:
        return None
    total = np.stack([distance[:, labels == c].sum(axis=1) for c in range(k)], axis=1)
    sizes = np.bincount(labels, minlength=k)
    own = sizes[labels]
    a = total[np.arange(n), labels] / np.maximum(own - 1, 1)
    others = total / sizes
    others[np.arange(n), labels] = np.inf
    b = others.min(axis=1)
    top = np.maximum(a, b)
    return float(np.where((own == 1) | (top == 0), 0, (b - a) / np.where(top == 0, 1, top)).mean())


def expected_families(labels: np.ndarray, k: int) -> float:
    return expected_of_sizes(np.bincount(labels), k)


def expected_of_sizes(sizes: np.ndarray, k: int) -> float:
    n, i = int(sizes.sum()), np.arange(k)
    size, times = np.unique(sizes[sizes > 0], return_counts=True)
    return float(sum(t * (1 - (np.prod((n - s - i) / (n - i)) if n - s >= k else 0.0)) for s, t in zip(size, times, strict=True)))


def discovery_area(labels: np.ndarray, k_max: int) -> float:
    return area_of_sizes(np.bincount(labels), k_max)


def area_of_sizes(sizes: np.ndarray, k_max: int) -> float:
    values = [expected_of_sizes(sizes, k) for k in range(1, k_max + 1)]
    return values[0] if k_max == 1 else float(np.trapezoid(values) / (k_max - 1))


def _matrix(pdf: pd.DataFrame, run: str, vector: str) -> tuple[list, np.ndarray]:
    if len(pdf) > MAX_RUNS:
        raise ValueError(f"a group has {len(pdf)} runs; {MAX_RUNS} at most can be clustered")
    pdf = pdf.sort_values(run)
    x = np.array(pdf[vector].tolist(), float).reshape(len(pdf), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return pdf[run].tolist(), x / np.where(norm > 0, norm, 1)


def nearest(x: np.ndarray, y: np.ndarray | None = None, rows: int = 256) -> tuple[np.ndarray, ...]:
    """For each row of x the distance and the place of its nearest row of y, and the same for y. Without y: of the nearest other row of x. The first of equally near ones."""
    own, at = np.full(len(x), np.inf), np.zeros(len(x), int)
    other, there = (np.full(len(y), np.inf), np.zeros(len(y), int)) if y is not None else (None, None)
    for k in range(0, len(x), rows):
        d = x[k : k + rows] @ (x if y is None else y).T
        np.subtract(1, d, out=d)
        d += SNAP
        d -= SNAP
        r = np.arange(len(d))
        if y is None:
            d[r, k + r] = np.inf
        at[k : k + len(d)] = d.argmin(axis=1)
        own[k : k + len(d)] = d[r, at[k : k + len(d)]]
        if y is not None:
            low = d.min(axis=0)
            closer = np.flatnonzero(low < other)
            there[closer], other[closer] = k + d[:, closer].argmin(axis=0), low[closer]
    return (own, at) if y is None else (own, at, other, there)


def mutual_merges(means: np.ndarray, sizes: np.ndarray, stop: float = np.inf, rows: int = 256) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) below a height by rounds of mutual neighbours, without a matrix of all rows; later ones may be lower, but none is lower than that of its parts.

    Only what was merged, or had its neighbour merged, looks for a neighbour again.
    """
    means, sizes, alive, merges = means.copy(), sizes.astype(float), np.ones(len(means), bool), []
    at, height, risen, todo = np.zeros(len(means), int), np.full(len(means), np.inf), np.zeros(len(means)), np.arange(len(means))
    while alive.sum() > 1:
        active = np.flatnonzero(alive)
        others = means[active]
        for k in range(0, len(todo), rows):
            own = todo[k : k + rows]
            d = ((1 - means[own] @ others.T) + SNAP) - SNAP
            d[np.arange(len(own)), np.searchsorted(active, own)] = np.inf
            first = d.argmin(axis=1)
            at[own], height[own] = active[first], d[np.arange(len(own)), first]
        alive &= height < stop
        active = np.flatnonzero(alive)
        lo = active[(at[at[active]] == active) & (active < at[active])]
        if len(active) and not len(lo):  # by a rounding of products only
            i = active[height[active].argmin()]
            lo, at[min(i, at[i])] = np.array([min(i, at[i])]), max(i, at[i])
        hi = at[lo]
        means[lo] = (sizes[lo, None] * means[lo] + sizes[hi, None] * means[hi]) / (sizes[lo] + sizes[hi])[:, None]
        sizes[lo] += sizes[hi]
        risen[lo] = np.maximum(height[lo], np.maximum(risen[lo], risen[hi]))
        merges += zip(lo.tolist(), hi.tolist(), np.clip(risen[lo], 0, 2).tolist(), sizes[lo].astype(int).tolist(), strict=True)
        alive[hi] = False
        active = np.flatnonzero(alive)
        todo = active[np.isin(at[active], np.concatenate([lo, hi])) | np.isin(active, lo)]
    return merges


def linked(means: np.ndarray, sizes: np.ndarray, stop: float) -> np.ndarray:
    """The first row of each row's cluster where merges below a height count."""
    return cut_roots(len(means), mutual_merges(means, sizes, stop))


def near_roots(x: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray, stop: float, tight: np.ndarray | None = None) -> np.ndarray:
    """linked() where a, b, d are all pairs of rows (a < b) with a distance below the height.

    A merge brings no two clusters nearer to each other than the nearer one of its parts was, so those below the height always have such a pair of rows between them, and other ones needn't be compared.
    tight: tight_groups(), to begin with their means. Rows of size 0 take no part.
    """
    means, sizes, root = x.copy(), sizes.astype(float), np.arange(len(x))
    both = (sizes[a] > 0) & (sizes[b] > 0)
    a, b, d = a[both], b[both], d[both]
    if tight is not None:
        root = tight
        grouped = np.flatnonzero(np.bincount(tight)[tight] > 1)
        firsts, place = np.unique(tight[grouped], return_inverse=True)
        total = np.stack([np.bincount(place, sizes[grouped] * x[grouped, k], len(firsts)) for k in range(x.shape[1])], axis=1) if len(firsts) else means[:0]
        weight = np.bincount(place, sizes[grouped], len(firsts))
        means[firsts], sizes[firsts] = total / np.maximum(weight, 1)[:, None], weight
        moved = np.zeros(len(x), bool)
        moved[firsts] = True
        a, b = tight[a], tight[b]
        again = moved[a] | moved[b]
        u, v, new = _between(means, a[again], b[again])
        a, b, d = (np.concatenate([old[~again], more[new < stop]]) for old, more in ((a, u), (b, v), (d, new)))
    return _rounds(means, sizes, root, a, b, d, stop)


def _between(means: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different ones of the pairs, in order, and their distances."""
    n = len(means)
    key = np.unique((np.minimum(a, b) * n + np.maximum(a, b))[a != b])
    u, v = key // n, key % n
    return u, v, np.concatenate([((1 - np.einsum("ij,ij->i", means[u[k : k + 8192]], means[v[k : k + 8192]])) + SNAP) - SNAP for k in range(0, max(len(u), 1), 8192)])


def _rounds(means: np.ndarray, sizes: np.ndarray, root: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray, stop: float) -> np.ndarray:
    n, parents = len(means), []
    near, at, to, merged = np.full(n, np.inf), np.full(n, n), np.arange(n), np.zeros(n, bool)
    while len(a):
        near[a], near[b], at[a], at[b] = np.inf, np.inf, n, n
        np.minimum.at(near, a, d)
        np.minimum.at(near, b, d)
        for u, v in ((a, b), (b, a)):
            first = d == near[u]
            np.minimum.at(at, u[first], v[first])
        nodes = np.unique(a)
        lo = nodes[(at[at[nodes]] == nodes) & (nodes < at[nodes])]
        hi = at[lo]
        means[lo] = (sizes[lo, None] * means[lo] + sizes[hi, None] * means[hi]) / (sizes[lo] + sizes[hi])[:, None]
        sizes[lo] += sizes[hi]
        to[hi] = lo
        parents.append((lo, hi))
        a, b = to[a], to[b]
        merged[lo] = True
        again = merged[a] | merged[b]
        merged[lo] = False
        u, v, new = _between(means, a[again], b[again])
        a, b, d = (np.concatenate([old[~again], more[new < stop]]) for old, more in ((a, u), (b, v), (d, new)))
    for lo, hi in reversed(parents):
        to[hi] = to[lo]
    return to[root]


def tight_groups(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray, stop: float) -> np.ndarray:
    """For each row the first row of its group, where groups are sets of rows whose distances from each other are all below those from any other row: whatever rows are drawn of one, these are merged before all else."""
    root, low = np.arange(n), d < stop / 2
    u, v = a[low], b[low]
    while (root[u] != root[v]).any():
        first = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], first)
        np.minimum.at(root, root[v], first)
        root = root[root]
    inside = root[a] == root[b]
    size, pairs = np.bincount(root, minlength=n), np.bincount(root[a[inside]], minlength=n)
    most, least = np.zeros(n), np.full(n, np.inf)
    np.maximum.at(most, root[a[inside]], d[inside])
    for m in (a, b):
        np.minimum.at(least, root[m[~inside]], d[~inside])
    return np.where(((2 * pairs == size * (size - 1)) & (most < least))[root], root, np.arange(n))


def _by_size(vectors: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Groups of at most MAX_RUNS runs, and larger ones if there are any."""
    large = vectors.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > MAX_RUNS).select(*by)
    if large.isEmpty():
        return vectors, None
    return vectors.join(large, by, "left_anti"), vectors.join(large, by, "left_semi")


def _distinct(vectors: DataFrame, by: list[str], run: str, vector: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """units (by, run, v), clusters of equal rows (by, run: the first one, w, v: the mean), and members (by, run, root). Rows that are equal to twelve places are at distance 0 to that many."""
    units = D.unit_rows(vectors.withColumn("run", F.col(run)), [*by, "run"], vector)
    units = written(units.withColumn("_k", F.transform("v", lambda x: F.round(x, 12) + F.lit(0.0))), "units")
    first = written(units.groupBy(*by, "_k").agg(F.count("*").cast("double").alias("w"), F.min_by("v", "run").alias("v"), F.min("run").alias("root")), "distinct")
    members = units.select(*by, "_k", "run").join(first.select(*by, "_k", "root"), [*by, "_k"]).select(*by, "run", "root")
    return units.drop("_k"), first.select(*by, F.col("root").alias("run"), "w", "v"), written(members, "members")


def nearest_clusters(clusters: DataFrame, by: list[str]) -> DataFrame:
    """by, run, d, other: the nearest other cluster of its group of each one, the first of equally near ones. clusters: run, v."""
    kinds = {f.name: f.dataType.simpleString() for f in clusters.select(*by, "run").schema}

    def meet(keys: list[pa.Scalar], u: pa.StructArray, v: pa.StructArray, same: bool) -> Iterator[pa.RecordBatch]:
        u, v = (m.take(pc.sort_indices(m.field("run"))) for m in (u, v))
        x, a, c = D.matrix(u), u.field("run"), v.field("run")
        if same:
            if len(x) < 2:
                return
            own, at = nearest(x)
            found = [(a, own, c.take(pa.array(at)))]
        else:
            own, at, other, there = nearest(x, D.matrix(v))
            found = [(a, own, c.take(pa.array(at))), (c, other, a.take(pa.array(there)))]
        for runs, d, o in found:
            yield pa.RecordBatch.from_arrays([*(pa.repeat(g, len(d)) for g in keys), runs, pa.array(d), o], [*by, "run", "d", "other"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), f"run {kinds['run']}, d double, other {kinds['run']}"])
    each = D.stored_pairs(clusters.select(*by, "run", "v"), by, meet, schema)
    return each.groupBy(*by, "run").agg(F.min(F.struct("d", "other")).alias("_b")).select(*by, "run", "_b.d", "_b.other")


def near_pairs(clusters: DataFrame, by: list[str], stop: float) -> DataFrame | None:
    """by, run, other, d: all pairs of clusters of a group below a height; none if there are more than SPARSE for each row. clusters: run, v."""
    kinds = {f.name: f.dataType.simpleString() for f in clusters.select(*by, "run").schema}

    def find(keys: list[pa.Scalar], u: pa.StructArray, v: pa.StructArray, same: bool) -> Iterator[pa.RecordBatch]:
        u, v = (m.take(pc.sort_indices(m.field("run"))) for m in (u, v))
        x, y, a, c, n = D.matrix(u), D.matrix(v), u.field("run"), v.field("run"), 0
        for k in range(0, len(x), D.STRIP):
            d = x[k : k + D.STRIP] @ y.T
            r, s = np.nonzero(d > 1 - stop - 1e-9)
            d = ((1 - d[r, s]) + SNAP) - SNAP
            wanted = (d < stop) & (k + r < s) if same else d < stop
            r, s, d = r[wanted], s[wanted], d[wanted]
            if not len(r):
                continue
            n += len(r)
            if n > SPARSE * (len(x) + len(y)):  # a row without a distance: too many
                yield pa.RecordBatch.from_arrays([*(pa.repeat(g, 1) for g in keys), a[:1], c[:1], pa.nulls(1, pa.float64())], [*by, "run", "other", "d"])
                return
            left, right = a.take(pa.array(k + r)), c.take(pa.array(s))
            turn = pc.greater(left, right)
            yield pa.RecordBatch.from_arrays([*(pa.repeat(g, len(r)) for g in keys), pc.if_else(turn, right, left), pc.if_else(turn, left, right), pa.array(d)], [*by, "run", "other", "d"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), f"run {kinds['run']}, other {kinds['run']}, d double"])
    found = written(D.stored_pairs(clusters.select(*by, "run", "v"), by, find, schema), "near")
    counts = found.groupBy(*by).agg(F.count("*").alias("_n"), F.count_if(F.col("d").isNull()).alias("_cut")).join(clusters.groupBy(*by).agg(F.count("*").alias("_rows")), by)
    return found if counts.filter((F.col("_cut") > 0) | (F.col("_n") > SPARSE * F.col("_rows"))).isEmpty() else None


def _merge_all(clusters: DataFrame, members: DataFrame, by: list[str], stop: float) -> tuple[DataFrame, DataFrame | None]:
    """members after all merges below a height, and the merges: by, left, right, distance, size, _round, _nth.

    Rounds of mutual neighbours, written one by one, until at most LAST clusters of each group can still be merged; these go to one task for each group, without a matrix.
    """
    merges, turn = [], 0
    while not clusters.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > LAST).isEmpty():
        turn += 1
        near = written(nearest_clusters(clusters, by).filter(F.col("d") < stop), "near")
        back = near.select(*by, F.col("run").alias("other"), F.col("other").alias("run"), F.lit(True).alias("_mutual"))
        pairs = near.join(back, [*by, "run", "other"]).filter("run < other").select(*by, F.col("run").alias("left"), F.col("other").alias("right"), F.col("d").alias("distance"))
        pairs = written(pairs, "pairs")
        if pairs.isEmpty() and not near.isEmpty():  # by a rounding of products only
            low = near.groupBy(*by).agg(F.min(F.struct("d", F.least("run", "other").alias("left"), F.greatest("run", "other").alias("right"))).alias("_b"))
            pairs = written(low.select(*by, "_b.left", "_b.right", F.col("_b.d").alias("distance")), "pairs")
        ends = pairs.select(*by, F.explode(F.array("left", "right")).alias("run"), F.col("left").alias("_to"))
        active = clusters.join(near.select(*by, "run"), [*by, "run"]).join(ends, [*by, "run"], "left").withColumn("_to", F.coalesce("_to", "run"))
        parts = active.groupBy(*by, "_to").agg(F.sum("w").alias("_w"), F.array_sort(F.collect_list(F.struct("run", "w", "v"))).alias("_p"))
        a, b = F.element_at("_p", 1), F.try_element_at("_p", F.lit(2))
        mean = F.zip_with(a["v"], b["v"], lambda x, y: (a["w"] * x + b["w"] * y) / (a["w"] + b["w"]))
        clusters = written(parts.select(*by, F.col("_to").alias("run"), F.col("_w").alias("w"), F.when(F.size("_p") == 1, a["v"]).otherwise(mean).alias("v")), "clusters")
        members = written(_moved(members, pairs.select(*by, F.col("right").alias("root"), F.col("left").alias("_to")), by), "members")
        size = clusters.select(*by, F.col("run").alias("left"), F.col("w").cast("int").alias("size"))
        merges.append(pairs.join(size, [*by, "left"]).select(*by, "left", "right", "distance", "size", F.lit(turn).alias("_round"), F.lit(0).alias("_nth")))
    kinds = {f.name: f.dataType.simpleString() for f in clusters.select(*by, "run").schema}

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run")
        runs, w, x = pdf["run"].tolist(), pdf["w"].to_numpy(float), np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
        found = mutual_merges(x, w, stop)
        root = cut_roots(len(runs), found)
        rows = [(runs[a], runs[b], height, size, nth, runs[root[b]]) for nth, (a, b, height, size) in enumerate(found)]
        if not rows:
            return pd.DataFrame()
        out = pd.DataFrame(rows, columns=["left", "right", "distance", "size", "_nth", "_to"])
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(out) for c in by}, **{c: out[c] for c in out}})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), f"left {kinds['run']}, right {kinds['run']}, distance double, size int, _nth int, _to {kinds['run']}"])
    last = written(clusters.groupBy(*by).applyInPandas(finish, schema), "merges")
    members = written(_moved(members, last.select(*by, F.col("right").alias("root"), "_to"), by), "members")
    every = last.select(*by, "left", "right", "distance", "size", F.lit(turn + 1).alias("_round"), "_nth")
    for m in merges:
        every = every.unionByName(m)
    return members, every


def cut_roots(n: int, merges: list[tuple]) -> np.ndarray:
    """The first row of each row's cluster after all merges."""
    root = np.arange(n)
    for a, b, *_ in reversed(merges):
        root[b] = root[a]
    return root


def _moved(members: DataFrame, to: DataFrame, by: list[str]) -> DataFrame:
    return members.join(to, [*by, "root"], "left").select(*by, "run", F.coalesce("_to", "root").alias("root"))


def _numbered(members: DataFrame, by: list[str], run: str) -> DataFrame:
    """by, run, family: numbers from 0 by descending size, then first run."""
    sizes = members.groupBy(*by, "root").agg(F.count("*").alias("_size"))
    placed = ranked(sizes, *[F.col(c) for c in by], F.desc("_size"), F.col("root"), name="_place")
    families = placed.join(placed.groupBy(*by).agg(F.min("_place").alias("_first")), by).select(*by, "root", (F.col("_place") - F.col("_first")).cast("int").alias("family"))
    return members.join(families, [*by, "root"]).select(*by, F.col("run").alias(run), "family")


def dense_vectors(features: DataFrame, by: list[str]) -> DataFrame:
    """by, run, vector over the sorted features of each group, from normalized_features()."""
    names = features.groupBy(*by).agg(F.array_sort(F.collect_set("feature")).alias("_names"))
    maps = features.groupBy(*by, "run").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("_m"))
    return maps.join(names, by).select(*by, "run", F.transform("_names", lambda n: F.coalesce(F.element_at("_m", n), F.lit(0.0))).alias("vector"))


def clusters(vectors: DataFrame, by: list[str], threshold: float, run: str = "run", vector: str = "vector") -> DataFrame:
    """by, run, family for each run of each group."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.select(*by, run).schema)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        runs, x = _matrix(pdf, run, vector)
        family = cut(len(runs), average_linkage(cosine_matrix(x), stop=threshold), threshold)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, run: runs, "family": family})

    small, large = _by_size(vectors.select(*by, run, vector), by)
    out = small.groupBy(*by).applyInPandas(label, f"{kinds}, family int")
    if large is not None:
        _, distinct, members = _distinct(large, by, run, vector)
        out = out.unionByName(_numbered(_merge_all(distinct, members, by, threshold)[0], by, run))
    return out


def sensitivity(vectors: DataFrame, by: list[str], primary: float, thresholds: list[float] | None = None, run: str = "run", vector: str = "vector") -> DataFrame:
    """Family statistics, silhouette and ARI against the primary cut, for each threshold."""
    grid = threshold_grid(primary, thresholds)
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in vectors.select(*by).schema)

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        runs, x = _matrix(pdf, run, vector)
        d = cosine_matrix(x)
        merges = average_linkage(d)
        first = cut(len(runs), merges, primary)
        rows = []
        for t in grid:
            labels = cut(len(runs), merges, t)
            effective, dominant, single = entropy_count(labels)
            rows.append({"threshold": t, "families": int(labels.max() + 1), "effective": effective, "dominant": dominant, "singleton_rate": single, "silhouette": mean_silhouette(d, labels), "ari": rand_index(first, labels)})
        return pd.DataFrame(rows).assign(**{c: pdf[c].iloc[0] for c in by})

    small, large = _by_size(vectors.select(*by, run, vector), by)
    out = small.groupBy(*by).applyInPandas(measure, kinds + "threshold double, families int, effective double, dominant double, singleton_rate double, silhouette double, ari double")
    return out if large is None else out.unionByName(_large_sensitivity(large, by, primary, grid, run, vector))


def _large_sensitivity(vectors: DataFrame, by: list[str], primary: float, grid: list[float], run: str, vector: str) -> DataFrame:
    """sensitivity() of large groups; each threshold goes on from the clusters of the one below."""
    from tallyloom.operators.families import adjusted_rand, family_stats

    units, clusters, members = _distinct(vectors, by, run, vector)
    found = {}
    for t in sorted({*grid, primary}):
        if found:
            sums = D.vector_sums(units.join(members, [*by, "run"]), [*by, "root"])
            clusters = written(sums.select(*by, F.col("root").alias("run"), F.col("_n").cast("double").alias("w"), F.transform("s", lambda x: x / F.col("_n")).alias("v")), "clusters")
        members = found[t] = _merge_all(clusters, members, by, t)[0]
    base = found[primary].select(*by, "run", F.col("root").alias("_base"))
    labels = None
    for t in sorted(set(grid)):
        one = found[t].select(*by, F.lit(t).alias("threshold"), "run", "root")
        labels = one if labels is None else labels.unionByName(one)
    keys = [*by, "threshold"]
    stats = family_stats(labels, keys, "root").select(*keys, F.col("raw_count").cast("int").alias("families"), F.col("effective_count").alias("effective"), F.col("dominant_share").alias("dominant"), "singleton_rate")
    shape = D.vector_silhouette(units.join(labels, [*by, "run"]), keys, "run", "v", "root", unit=True).select(*keys, "silhouette")
    ari = adjusted_rand(labels.join(base, [*by, "run"]), keys, "root", "_base").select(*keys, "ari")
    return stats.join(shape, keys).join(ari, keys)


def vendi_scores(vectors: DataFrame, by: list[str], run: str = "run", vector: str = "vector") -> DataFrame:
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in vectors.select(*by).schema)

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        score, reason = vendi(_matrix(pdf, run, vector)[1])
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, "n": len(pdf), "vendi": score, "reason": reason}])

    def of_products(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.array(pdf["products"].iloc[0], float)
        score, reason = effective_number(g.reshape(2 * [round(len(g) ** 0.5)]))
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, "n": int(pdf["_n"].iloc[0]), "vendi": score, "reason": reason}])

    small, large = _by_size(vectors.select(*by, run, vector), by)
    out = small.groupBy(*by).applyInPandas(measure, kinds + "n int, vendi double, reason string")
    if large is not None:  # of many rows only the sum of their outer products goes to a task
        sums = D.vector_sums(D.unit_rows(large.withColumn("run", F.col(run)), [*by, "run"], vector), by, products=True)
        out = out.unionByName(sums.groupBy(*by).applyInPandas(of_products, kinds + "n int, vendi double, reason string"))
    return out


def bootstrap(vectors: DataFrame, by: list[str], threshold: float, replicates: int = 1000, seed: int = 20260723, k_max: int | None = None, chunk: int = 25, run: str = "run", vector: str = "vector") -> DataFrame:
    """metric, lower, upper, replicates: percentile intervals over resampled runs, by group.

    Each chunk of replicates is a task; all take their rows from one seeded stream, in the order of the replicates. In groups of more than MAX_RUNS runs, pairs of kinds of rows below the threshold are
    listed once, for all replicates: only these can be merged first, and the clusters that hold them later. A task for each core then takes some of the chunks, so that the rows aren't sent with each one.
    Where there are too many such pairs, rows that have one are merged without a matrix of all of them.
    """
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in vectors.select(*by).schema)
    chunks = -(-replicates // chunk)

    def moments(counts: list[np.ndarray], x: np.ndarray) -> list[tuple[str, float | None]]:
        """What comes from sums over a replicate's rows: for several ones at once, as products of how often each row counts with the products of its values."""
        times, (i, j) = np.stack(counts), np.triu_indices(x.shape[1])
        total, upper = np.zeros((len(times), x.shape[1])), np.zeros((len(times), len(i)))
        for k in range(0, len(x), 512):
            some, w = x[k : k + 512], times[:, k : k + 512].astype(float)
            total += w @ some
            upper += w @ (some[:, i] * some[:, j])
        rows, n = [], int(times[0].sum())
        for t, up in zip(total, upper, strict=True):
            gram = np.zeros(2 * [x.shape[1]])
            gram[i, j] = gram[j, i] = up
            rows += [("mean_pairwise_distance", float((n * n - t @ t) / (n * (n - 1)))), ("vendi_score", effective_number(gram)[0])]
        return rows

    def draw_large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        drawn = set(t["_chunk"][0].as_py())
        pair = pc.is_valid(t["other"])
        pairs, t = t.filter(pair), t.filter(pc.invert(pair))
        t = t.take(pc.sort_indices(t["run"]))
        kinds_of = t.filter(pc.is_valid(t["v"])).combine_chunks()
        names, near = kinds_of["run"].chunk(0), kinds_of["_near"].to_numpy()
        kind = pc.index_in(t["root"], value_set=names).to_numpy()
        a, b, d = *(pc.index_in(pairs[c], value_set=names).to_numpy().astype(np.int64) for c in ("run", "other")), pairs["d"].to_numpy()
        x, n = D.matrix(pa.StructArray.from_arrays([kinds_of["v"].chunk(0)], ["v"])), t.num_rows
        keys = [t[g][0] for g in by]
        del t, pairs, kinds_of
        listed = np.flatnonzero(near)
        place = np.cumsum(near) - 1
        own, a, b = x[listed], place[a], place[b]
        tight = tight_groups(len(own), a, b, d, threshold) if sparse else None
        stream, rows, counts = np.random.default_rng(seed), [], []
        for r in range(min(replicates, (max(drawn) + 1) * chunk)):
            index = stream.integers(0, n, size=n)
            if r // chunk not in drawn:
                continue
            times = np.bincount(kind[index], minlength=len(x)).astype(float)
            w = times[listed]
            if sparse:
                merged = np.bincount(near_roots(own, w, a, b, d, threshold, tight), w)
            else:
                some = np.flatnonzero(w)
                merged = np.bincount(linked(own[some], w[some], threshold), w[some])
            sizes = np.concatenate([times[~near], merged])
            p = sizes[sizes > 0] / n
            counts.append(times.astype(np.int32))
            values = {"effective_family_count": float(np.exp(-(p * np.log(p)).sum())), "dominant_family_share": float(p.max())}
            if k_max is not None and k_max <= n:
                values["family_discovery_auc_at_kmax"] = area_of_sizes(sizes.astype(np.int64), k_max)
            rows += values.items()
            if len(counts) == chunk:
                rows += moments(counts, x)
                counts = []
        rows += moments(counts, x) if counts else []
        rows = [(m, v) for m, v in rows if v is not None]
        metrics, found = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([*(pa.repeat(k, len(rows)) for k in keys), pa.array(metrics, pa.string()), pa.array(found, pa.float64())], [*by, "metric", "value"])

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf["_chunk"].iloc[0])
        runs, x = _matrix(pdf, run, vector)
        n = len(runs)
        stream = np.random.default_rng(seed)
        whole, rows = cosine_matrix(x), []
        for r in range(min(replicates, (at + 1) * chunk)):
            index = stream.integers(0, n, size=n)
            if r < at * chunk:
                continue
            # rows that were drawn several times are one row that counts so often
            drawn, first, place, times = np.unique(index, return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(first)
            own = whole[np.ix_(drawn[order], drawn[order])]
            labels = cut(len(drawn), average_linkage(own, times[order], threshold), threshold)
            labels = labels[np.argsort(order)][place]
            effective, dominant, _ = entropy_count(labels)
            pairs = n * (n - 1)
            mean = float(times[order] @ own @ times[order]) / pairs if pairs else 0.0
            values = {"effective_family_count": effective, "dominant_family_share": dominant, "mean_pairwise_distance": mean, "vendi_score": vendi(x[index])[0]}
            if k_max is not None and k_max <= n:
                values["family_discovery_auc_at_kmax"] = discovery_area(labels, k_max)
            rows += [{"metric": m, "value": v} for m, v in values.items() if v is not None]
        return pd.DataFrame(rows).assign(**{c: pdf[c].iloc[0] for c in by})

    small, large = _by_size(vectors.select(*by, run, vector), by)
    chunked = lambda df: df.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).groupBy(*by, "_chunk")
    values = chunked(small).applyInPandas(draw, kinds + "metric string, value double")
    if large is not None:
        _, distinct, members = _distinct(large, by, run, vector)
        pairs = near_pairs(distinct, by, threshold)
        sparse = pairs is not None
        near = nearest_clusters(distinct, by).filter(F.col("d") < threshold).select(*by, "run") if pairs is None else pairs.select(*by, F.explode(F.array("run", "other")).alias("run")).distinct()
        pair_kinds = {f.name: f.dataType.simpleString() for f in distinct.select("run").schema}
        v = distinct.select(*by, "run", "v").join(near.withColumn("_near", F.lit(True)), [*by, "run"], "left").withColumn("_near", F.coalesce("_near", F.lit(False)))
        rows = members.join(v, [*by, "run"], "left").select(*by, "run", "root", "v", "_near", F.lit(None).cast(pair_kinds["run"]).alias("other"), F.lit(None).cast("double").alias("d"))
        if sparse:
            rows = rows.unionByName(pairs, allowMissingColumns=True)
        rows = written(rows, "rows")
        tasks = min(chunks, rows.sparkSession.sparkContext.defaultParallelism)
        shares = F.explode(F.array(*[F.struct(F.lit(i).alias("_task"), F.array(*[F.lit(c) for c in range(i, chunks, tasks)]).alias("_chunk")) for i in range(tasks)])).alias("_s")
        # ranges of more parts than tasks, so that no two of them share one
        dealt = rows.select("*", shares).select(*rows.columns, "_s.*").repartitionByRange(8 * tasks, "_task")
        values = values.unionByName(dealt.groupBy(*by, "_task").applyInArrow(draw_large, kinds + "metric string, value double"))
    return values.groupBy(*by, "metric").agg(F.percentile("value", F.lit(0.025)).alias("lower"), F.percentile("value", F.lit(0.975)).alias("upper"), F.count("*").alias("replicates"))


def ablation(features: DataFrame, by: list[str], representations: dict[str, list[str]], threshold: float) -> DataFrame:
    """Family statistics and ARI against the first representation, for each choice of feature blocks; features: run, block, feature, value.

    Vectors and labels are written, as each is read several times: once, not with every use, features are counted and groups labelled.
    """
    from tallyloom.operators.distance import normalized_features

    chosen = F.explode(F.array(*[F.struct(F.lit(n).alias("representation"), F.array(*map(F.lit, b)).alias("_blocks")) for n, b in representations.items()]))
    rows = features.withColumn("_x", chosen).filter(F.array_contains("_x._blocks", F.col("block"))).withColumn("representation", F.col("_x.representation")).drop("_x")
    vectors = written(dense_vectors(written(normalized_features(rows, [*by, "representation"]), "features"), [*by, "representation"]), "vectors")
    found = written(clusters(vectors, [*by, "representation"], threshold), "found")
    primary = next(iter(representations))
    base = found.filter(F.col("representation") == primary).select(*by, "run", F.col("family").alias("base"))
    from tallyloom.operators.families import adjusted_rand, family_stats

    stats = family_stats(found, [*by, "representation"], "family")
    return stats.join(adjusted_rand(found.join(base, [*by, "run"]), [*by, "representation"], "family", "base").select(*by, "representation", "ari"), [*by, "representation"])


def linkage_table(vectors: DataFrame, by: list[str], run: str = "run", vector: str = "vector") -> DataFrame:
    """by, step, left, right, distance, size: the merges of average linkage, each named by its clusters' first runs; what a dendrogram is drawn from."""
    kind = vectors.select(run).schema[0].dataType.simpleString()
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in vectors.select(*by).schema)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        runs, x = _matrix(pdf, run, vector)
        merges, size = average_linkage(cosine_matrix(x)), {i: 1 for i in range(len(runs))}
        rows = []
        for step, (a, b, height) in enumerate(merges):
            size[a] += size[b]
            rows.append((step, runs[a], runs[b], height, size[a]))
        if not rows:
            return pd.DataFrame()
        out = pd.DataFrame(rows, columns=["step", "left", "right", "distance", "size"])
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(out) for c in by}, **{c: out[c] for c in out}})

    small, large = _by_size(vectors.select(*by, run, vector), by)
    out = small.groupBy(*by).applyInPandas(merge, f"{kinds}step int, left {kind}, right {kind}, distance double, size int")
    if large is not None:
        _, distinct, members = _distinct(large, by, run, vector)
        nth = F.row_number().over(Window.partitionBy(*by, "root").orderBy("run"))
        copies = members.filter("run <> root").select(*by, F.col("root").alias("left"), F.col("run").alias("right"), F.lit(0.0).alias("distance"), (nth + 1).alias("size"), F.lit(0).alias("_round"), F.lit(0).alias("_nth"))
        order = [F.col(c) for c in (*by, "distance", "_round", "_nth", "left", "right")]
        placed = ranked(copies.unionByName(_merge_all(distinct, members, by, np.inf)[1]), *order, name="_place")
        first = placed.groupBy(*by).agg(F.min("_place").alias("_first"))
        step = (F.col("_place") - F.col("_first")).cast("int").alias("step")
        out = out.unionByName(placed.join(first, by).select(*by, step, "left", "right", "distance", "size"))
    return out
