"""Toxicity by a logistic classifier with counterfactual regularisation.

Features are the parts of words: runs of 4, 6 and 8 bytes of a lowered text whose inner bytes are letters, so that a word's first and last part also
has the blank beside it. (They fit into a 64-bit number, which is the feature itself and no hash of it; other characters than letters count as blanks.) A text has a feature or
hasn't, however often and however long the text is. Spark counts in how many toxic and other texts of the sample each feature
is; those that are significantly more frequent in toxic ones (a likelihood ratio of `least` or more) are kept, the best `max_features` of them.

A feature's value is the log ratio of its frequencies, so that what is seen often in toxic texts only needs less weight than what is rare. Weights minimise the log loss, plus `ridge` times their squares, plus the counterfactual penalty: in every sentence of the labelled texts that names
a group of people (`IDENTITY_TERMS`) each name is swapped for the others of its line, and `pairing` times the mean square of the change of the sentence's margin is added. So words that
are frequent in toxic texts only because these speak of a group get no weight, and a neutral mention of the group changes no score.
least and ridge are chosen by log loss on every fifth row, with features and weights of the other rows, and the model is then made of all rows. The minimum is found by
Newton steps, each solved by conjugate gradients.

Training takes at most `max_rows` labelled rows (those of the smallest hash of doc_id; the bound of the sample, whose texts are read whole); equal texts of one label count once. Rows with null
labels or null doc_ids teach nothing; a document labelled more than once counts once for each label. Null, empty and letterless texts have no feature, and the score of such a text. With one class only
all scores are 1 or 0, as it is; without rows they are 0.5. A class of any size teaches, but too few rows give no significant feature, and then the class's frequency is the score.
Rows that repeat are rows of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import fresh_path, remove, small_batches, written
from tallyloom.llm.decontaminate import sliced
from tallyloom.llm.words import text_column

THRESHOLD = 0.7
LENGTHS = (4, 6, 8)
PIECE = 1 << 19  # positions worked on at a time
LEASTS = (8.0, 16.0)  # what the likelihood ratio of a feature may have to reach
RIDGES = (0.003, 0.03)

#: Names of groups of people. Those of one line stand for each other; the first of a line names nobody in particular.
IDENTITY_TERMS = """
person woman man girl boy muslim christian jew hindu buddhist atheist immigrant refugee foreigner african american asian european mexican
people women men girls boys muslims christians jews hindus buddhists atheists immigrants refugees foreigners africans americans asians europeans mexicans
ordinary black white gay lesbian straight transgender bisexual deaf blind disabled old young female male jewish islamic
mensch frau mann mädchen junge muslim christ jude buddhist ausländer flüchtling afrikaner amerikaner asiat europäer
menschen frauen männer muslime christen juden hindus buddhisten ausländer flüchtlinge afrikaner amerikaner asiaten europäer
personne femme homme fille garçon musulman chrétien juif hindou bouddhiste immigré réfugié étranger africain américain asiatique européen
gens femmes hommes filles garçons musulmans chrétiens juifs hindous bouddhistes immigrés réfugiés étrangers africains américains asiatiques européens
persona mujer hombre chica chico musulmán cristiano judío hindú budista inmigrante refugiado extranjero africano americano asiático europeo
personas mujeres hombres chicas chicos musulmanes cristianos judíos hindúes budistas inmigrantes refugiados extranjeros africanos americanos asiáticos europeos
"""

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[0x80:] = np.arange(0x80, 256)
_HEADS = {n: np.uint64((1 << 8 * n) - 1) for n in LENGTHS}
_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def swaps(terms: str = IDENTITY_TERMS) -> dict[str, list[str]]:
    """For each term what it is swapped for; of a term on several lines, all that stand there."""
    out: dict[str, dict[str, None]] = {}
    for line in terms.strip().splitlines():
        for t in line.split():
            out.setdefault(t, {}).update({x: None for x in line.split() if x != t})
    return {t: list(x) for t, x in out.items()}


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) of every place of every text, some places at a time; they repeat."""
    data, offsets = text_column(pc.utf8_lower(column.cast(pa.string())))
    n = len(offsets) - 1
    out = np.full(len(data) + n + 1 + 8, 0x20, np.uint8)  # a blank before each text and behind the last
    data = _LETTERS[data]
    begin = offsets[:-1] + np.arange(1, n + 1)
    for i in range(n):
        out[begin[i] : begin[i] + offsets[i + 1] - offsets[i]] = data[offsets[i] : offsets[i + 1]]
    eight = np.ndarray(len(out) - 8, "<u8", out, strides=(1,))
    for lo in range(0, len(eight), PIECE):
        hi = min(len(eight), lo + PIECE)
        blanks = np.zeros(hi - lo + 9, np.int32)
        np.cumsum(out[lo : hi + 8] == 0x20, out=blanks[1:])
        for size in LENGTHS:
            at = np.flatnonzero(blanks[size - 1 : size - 1 + hi - lo] == blanks[1 : 1 + hi - lo])
            yield np.searchsorted(begin, at + (lo + 1), "right") - 1, eight[lo + at] & _HEADS[size]


def feature_set(text: str) -> np.ndarray:
    found = [keys for _, keys in features(pa.array([text]))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


class Lookup:
    """Places of features among the sorted ones that are kept; a table of bits tells most others apart first."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint64))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self._spot(self.keys)] = True

    @staticmethod
    def _spot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are kept, and their places."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = np.flatnonzero(self.bits[self._spot(keys)])
        spot = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        same = self.keys[spot] == keys[some]
        return some[same], spot[same]

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of the kept features of every text, each once, in order."""
        found = []
        for doc, keys in features(column):
            some, spot = self(keys)
            found.append(np.unique(doc[some] * len(self.keys) + spot))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both // max(1, len(self.keys)), both % max(1, len(self.keys))


class Sparse:
    """A matrix by its entries (row, column, value)."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.value, self.shape = row, column, value, shape

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * v[self.column], self.shape[0])

    def part(self, rows: np.ndarray, columns: np.ndarray) -> Sparse:
        """The rows and columns that are asked for."""
        own = rows[self.row] & columns[self.column]
        at, to = np.cumsum(rows) - 1, np.cumsum(columns) - 1
        return Sparse(at[self.row[own]], to[self.column[own]], self.value[own], (int(rows.sum()), int(columns.sum())))

    def transposed(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * v[self.row], self.shape[1])


def fitted(x: Sparse, y: np.ndarray, swapped: Sparse, share: np.ndarray, ridge: float, pairing: float) -> np.ndarray:
    """The weights, the last one that of the constant.

    Least of sum(log loss) + ridge / 2 * |w|^2 + pairing / 2 * rows * sum(share * (swapped @ w)^2); the constant is free of both penalties.
    """
    n, m = x.shape
    free = np.append(np.full(m, ridge), 1e-9)
    weight = pairing * n * share

    def state(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        t, change = x @ w[:-1] + w[-1], swapped @ w[:-1]
        loss = np.logaddexp(0, np.where(y == 1, -t, t)).sum() + 0.5 * (free * w * w).sum() + 0.5 * (weight * change * change).sum()
        p = 1 / (1 + np.exp(-np.clip(t, -35, 35)))
        slope = np.append(x.transposed(p - y) + swapped.transposed(weight * change), (p - y).sum()) + free * w
        return loss, slope, np.maximum(p * (1 - p), 1e-9)

    def curved(v: np.ndarray, d: np.ndarray) -> np.ndarray:
        u = d * (x @ v[:-1] + v[-1])
        return np.append(x.transposed(u) + swapped.transposed(weight * (swapped @ v[:-1])), u.sum()) + free * v

    w = np.zeros(m + 1)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    loss, slope, d = state(w)
    for _ in range(60):
        if np.abs(slope).max() < 1e-6 * n:
            break
        step, left = np.zeros(m + 1), -slope
        way, size = left.copy(), left @ left
        goal = 1e-4 * size
        for _ in range(250):
            c = curved(way, d)
            along = size / (way @ c)
            step += along * way
            left = left - along * c
            last, size = size, left @ left
            if size <= goal:
                break
            way = left + size / last * way
        length = 1.0
        while length > 1e-6:
            now = state(w + length * step)
            if now[0] <= loss + 1e-4 * length * (slope @ step):
                break
            length /= 2
        else:
            break
        w = w + length * step
        loss, slope, d = now
    return w


class Toxicity:
    """Kept features, their weights, and the constant."""

    def __init__(self, lookup: Lookup, weights: np.ndarray, chosen: tuple[float, ...] = ()):
        self.lookup, self.weights, self.chosen = lookup, weights, chosen

    def margin(self, column: pa.Array) -> np.ndarray:
        doc, spot = self.lookup.rows(column)
        return np.bincount(doc, self.weights[spot], len(column)) + self.weights[-1]

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(column), -35, 35)))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """text, toxic (0 or 1) and kind (toxic, and 2 more for every fifth row, by a hash) of the labelled rows of the smallest hash of doc_id, equal texts of one label once."""
    known = labels.filter("toxic is not null and doc_id is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    picked = docs.sparkSession.createDataFrame(picked.collect(), known.schema)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    # by a digest, so that the texts of copies aren't gathered
    rows = rows.groupBy(F.sha2("text", 256).alias("digest"), "toxic").agg(F.any_value("text").alias("text"))
    return rows.select("text", "toxic", (F.col("toxic") + F.when(F.pmod(F.xxhash64("digest"), F.lit(5)) == 4, 2).otherwise(0)).alias("kind"))


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature (as a signed long), and how many texts of each kind (n0 to n3) have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]

        def counted() -> Iterator[pa.RecordBatch]:
            for kind in range(4):
                keys, n = np.unique(np.concatenate(held[kind]), return_counts=True) if held[kind] else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                none = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_pydict({"feature": keys.view(np.int64)} | {f"n{k}": n if k == kind else none for k in range(4)})
                held[kind].clear()

        size = 0
        for b in batches:
            for text, kind in zip(b["text"], b["kind"].to_pylist(), strict=True):
                found = feature_set(text.as_py())
                held[kind].append(found)
                size += len(found)
                if size > 1 << 22:
                    yield from counted()
                    size = 0
        yield from counted()

    counts = rows.mapInArrow(count, "feature long, n0 long, n1 long, n2 long, n3 long")
    return counts.groupBy("feature").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)])


def best_features(counts: DataFrame, seen0: Column, seen1: Column, n0: int, n1: int, least: float, max_features: int) -> dict[int, float]:
    """The likelihood ratio of those more frequent in texts of label 1. seen0 and seen1: how many of the n0 and n1 texts have the feature."""
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    rows = counts.select("feature", seen0.cast("double").alias("b"), seen1.cast("double").alias("a")).filter(F.col("a") * n0 > F.col("b") * n1)
    a, b = F.col("a"), F.col("b")
    share = (a + b) / (n0 + n1)
    ratio = 2 * (part(a, n1 * share) + part(b, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - b, n0 * (1 - share)))
    picked = rows.select("feature", ratio.alias("ratio")).filter(F.col("ratio") >= least).orderBy(F.desc("ratio"), "feature").limit(max_features).collect()
    return {r["feature"]: r["ratio"] for r in picked}


def counterfactuals(text: str, others: dict[str, list[str]], lookup: Lookup) -> Iterator[tuple[tuple, tuple]]:
    """For each name of a group in each sentence, and each that may stand for it: the kept features that come and those that go."""
    for sentence in _SENTENCE.split(text):
        words = _WORD.findall(sentence.lower())
        for k, w in enumerate(words):
            if w in others:
                kept = lambda s: set(lookup(feature_set(" ".join(s)))[1].tolist())
                before = kept(words)
                for other in others[w]:
                    after = kept([*words[:k], other, *words[k + 1 :]])
                    yield tuple(sorted(after - before)), tuple(sorted(before - after))


def choose(
    found: Lookup, x: Sparse, y: np.ndarray, check: np.ndarray, part: dict[int, float], whole: dict[int, float], change: Sparse, share: np.ndarray, leasts, ridges, pairing: float
) -> Toxicity:
    """The model of all rows, with the least ratio and the ridge that have the least log loss on the checked rows if the others teach."""

    def fit(some: np.ndarray, ratios: dict[int, float], least: float, ridge: float) -> np.ndarray:
        ratio = np.array([ratios.get(k, 0.0) for k in found.keys.view(np.int64).tolist()])
        kept = ratio >= least
        own, swapped, toxic = x.part(some, kept), change.part(np.ones(change.shape[0], bool), kept), y[some] == 1
        seen = [np.bincount(own.column[toxic[own.row] == c], minlength=own.shape[1]) + 1 for c in (False, True)]
        scale = np.log(seen[1] / (toxic.sum() + 1)) - np.log(seen[0] / ((~toxic).sum() + 1))
        scale /= max(1.0, np.abs(scale).max(initial=0))
        own.value, swapped.value = own.value * scale[own.column], swapped.value * scale[swapped.column]
        w = np.zeros(len(kept) + 1)
        w[np.append(kept, True)] = fitted(own, y[some], swapped, share, ridge, pairing) * np.append(scale, 1)
        return w

    best = None
    for least in leasts:
        for ridge in ridges:
            w = fit(~check, part, least, ridge) if (~check).any() and check.any() else np.zeros(len(found.keys) + 1)
            t = (x @ w[:-1] + w[-1])[check]
            loss = np.logaddexp(0, np.where(y[check] == 1, -t, t)).mean() if check.any() else 0.0
            if best is None or loss < best[0]:
                best = (loss, least, ridge)
    return Toxicity(found, fit(np.ones(len(y), bool), whole, *best[1:]), best[1:])


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, max_features: int = 1 << 14, leasts: tuple[float, ...] = LEASTS,
    ridges: tuple[float, ...] = RIDGES, pairing: float = 10.0, terms: str = IDENTITY_TERMS,
) -> Toxicity:
    """From docs (doc_id, text) and labels (doc_id, toxic)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = written(spark, sample(docs, labels, max_rows), "toxicity", path := fresh_path(spark, "toxicity"))
    try:
        n = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        n = [n.get(k, 0) for k in range(4)]
        if not n[0] + n[2] or not n[1] + n[3]:
            return Toxicity(Lookup(np.zeros(0, np.uint64)), np.array([0.0 if not sum(n) else 35.0 if n[1] + n[3] else -35.0]))
        counts = written(spark, feature_counts(rows), "features", counts_path := fresh_path(spark, "features"))
        try:
            # without the rows that choose between models, and with them
            part = best_features(counts, F.col("n0"), F.col("n1"), n[0], n[1], min(leasts), max_features) if n[0] and n[1] else {}
            whole = best_features(counts, F.col("n0") + F.col("n2"), F.col("n1") + F.col("n3"), n[0] + n[2], n[1] + n[3], min(leasts), max_features)
        finally:
            remove(spark, counts_path)
        found = Lookup(np.array(sorted(part | whole), np.int64).view(np.uint64))
        lookup, others = spark.sparkContext.broadcast(found), swaps(terms)

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for some in sliced(b, "text"):
                    doc, spot = lookup.value.rows(some.column("text"))
                    at = np.searchsorted(doc, np.arange(some.num_rows + 1))
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(spot, pa.int32()))
                    yield pa.RecordBatch.from_arrays([some.column("kind"), lists], ["kind", "features"])

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                met = [p for t in b["text"] for p in counterfactuals(t.as_py(), others, lookup.value)]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in met], pa.list_(pa.int32())) for i in (0, 1)], ["come", "go"])

        got = rows.mapInArrow(entries, "kind int, features array<int>").orderBy("kind", F.xxhash64("features")).toArrow()
        met = rows.mapInArrow(pairs, "come array<int>, go array<int>").groupBy("come", "go").agg(F.count("*").alias("n")).orderBy("come", "go").collect()
        lookup.unpersist()
    finally:
        remove(spark, path)
    kind, lists = got["kind"].to_numpy(), got["features"].combine_chunks()
    y, check = kind % 2, kind >= 2
    row, flat = np.repeat(np.arange(len(y)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()
    total = sum(r["n"] for r in met)
    change = [(i, f, v) for i, r in enumerate(met) for v, fs in ((1.0, r["come"]), (-1.0, r["go"])) for f in fs]
    change = Sparse(*(np.array([x[i] for x in change], t) for i, t in enumerate((np.int64, np.int64, float))), (len(met), len(found.keys)))
    share = np.array([r["n"] / total for r in met], float)

    return choose(found, Sparse(row, flat, np.ones(len(row)), (len(y), len(found.keys))), y, check, part, whole, change, share, leasts, ridges, pairing)


def scored(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id and score for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in sliced(b, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(part.column("text")))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
