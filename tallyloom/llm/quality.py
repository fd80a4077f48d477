"""Quality classification by a regularised quadratic discriminant.

Each text gets statistics of its bytes, words and lines (`statistics`), transformed by logarithms and square roots to be closer
to normal. Each class has a mean and a covariance shrunk twice: towards the pooled covariance (by `pool`) and towards a
multiple of the identity (by `ridge`). The discriminant is the difference of the classes' log densities, by Mahalanobis
distances through Cholesky factors that are computed once, plus the log ratio of the classes' frequencies. The score is a
logistic function of it. pool, ridge, and the slope and intercept of the logistic are chosen by log loss over FOLDS folds of each class, each scored by a model of the others.

A class of fewer than OWN rows for each statistic (54 rows) has the pooled covariance, and so any number of rows from one on teaches; a class that a fold leaves without rows has the mean of all rows there.

Training takes at most `max_rows` labelled rows, those of the smallest hash of doc_id, so the driver holds that many vectors of
statistics. Rows with null labels or null doc_ids teach nothing; a document labelled more than once counts once for each
label. Null and empty texts have statistics of their own (zeros) and get a score. With one class only, or none,
all scores are that class's frequency (0.5 without rows). Rows that repeat are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import small_batches
from tallyloom.llm.decontaminate import sliced
from tallyloom.llm.words import text_column, word_hashes

THRESHOLD = 0.3
FOLDS = 5
OWN = 3  # rows for each statistic from which a class has a covariance of its own
FLOOR = 0.05  # of the mean variance that the identity is scaled by
STATISTICS = [
    "log_words", "word_bytes", "line_words", "upper", "digit", "marks", "symbols", "bars", "wide", "repeat_next", "repeat_second",
    "distinct_words", "distinct_lines", "entropy", "long_words", "top_word", "line_ends", "spaces",
]

_KINDS = np.zeros(256, np.uint8)  # 0 lower-case letters and the rest
_KINDS[65:91] = 1
_KINDS[48:58] = 2
_KINDS[[ord(c) for c in ".,;:?'\"()-"]] = 3
_KINDS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{}~"]] = 4
_KINDS[ord("|")] = 5
_KINDS[0x80:] = 6
_KINDS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 7
_KINDS[0x0A] = 8


def statistics(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row of transformed statistics for each text."""
    data, offsets = text_column(column)
    n = len(offsets) - 1
    words, at, first, end = word_hashes(data, offsets, spans=True)
    n_bytes, n_words = np.diff(offsets), np.diff(at)
    kinds = _KINDS[data]
    doc = np.repeat(np.arange(n), n_words)

    def per_doc(flags: np.ndarray, places: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[places[1:]] - total[places[:-1]]

    share = lambda k: per_doc(kinds == k, offsets) / np.maximum(n_bytes, 1)
    some = np.maximum(n_words, 1)
    length = (end - first).astype(float)
    same = lambda j: per_doc(np.concatenate([np.zeros(min(j, len(words)), bool), (words[j:] == words[:-j]) & (doc[j:] == doc[:-j])]), at) / some
    n_lines = per_doc(kinds == 8, offsets) + (n_bytes > 0)
    order = np.lexsort((words, doc))
    w, d = words[order], doc[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    runs = np.flatnonzero(new)
    count = np.diff(np.append(runs, len(w)))
    top = np.zeros(n)
    np.maximum.at(top, d[runs], count)
    distinct = np.bincount(d[runs], minlength=n) if len(runs) else np.zeros(n)
    before_end = np.zeros(len(data), bool)  # a full stop, question or exclamation mark that ends a line
    if len(data):
        stop = (data == ord(".")) | (data == ord("?")) | (data == ord("!"))
        before_end[:-1] = stop[:-1] & (kinds[1:] == 8)
        last = offsets[1:][n_bytes > 0] - 1
        before_end[last] = stop[last]
    entropy, lines = np.zeros(n), np.zeros(n)
    for i in np.flatnonzero(n_bytes):
        raw = data[offsets[i] : offsets[i + 1]]
        p = np.bincount(raw, minlength=256) / len(raw)
        p = p[p > 0]
        entropy[i] = -(p * np.log(p)).sum()
        lines[i] = len(set(raw.tobytes().split(b"\n"))) if n_lines[i] > 1 else 1
    out = np.stack([
        np.log1p(n_words), np.log1p(np.bincount(doc, length, n) / some), np.log1p(n_words / np.maximum(n_lines, 1)), np.sqrt(share(1)), np.sqrt(share(2)),
        np.sqrt(share(3)), np.sqrt(share(4)), np.sqrt(share(5)), np.sqrt(share(6)), np.sqrt(same(1)), np.sqrt(same(2)),
        np.log1p(distinct) - np.log1p(n_words), lines / np.maximum(n_lines, 1), entropy, np.sqrt(per_doc(length > 20, at) / some),
        np.sqrt(top / some), per_doc(before_end, offsets) / np.maximum(n_lines, 1), np.sqrt(share(7)),
    ], axis=1)
    return out


class Discriminant:
    def __init__(self, x: np.ndarray, y: np.ndarray, pools=(0.0, 0.1, 0.3, 0.6), ridges=(0.01, 0.05, 0.2)):
        self.slope, self.shift, self.constant = 1.0, 0.0, None
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        self.center, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        fold = np.zeros(len(y), int)
        for c in (0, 1):
            fold[y == c] = np.arange((y == c).sum()) % FOLDS
        best = None
        for pool in pools:
            for ridge in ridges:
                margin = np.zeros(len(y))
                for f in range(FOLDS):
                    if (fold == f).any() and (fold != f).any():
                        self._fit(x[fold != f], y[fold != f], pool, ridge)
                        margin[fold == f] = self.margin(x[fold == f])
                slope, shift, loss = self._calibrated(margin, y)
                if best is None or loss < best[0]:
                    best = (loss, pool, ridge, slope, shift)
        _, self.pool, self.ridge, self.slope, self.shift = best
        self._fit(x, y, self.pool, self.ridge)

    def _fit(self, x: np.ndarray, y: np.ndarray, pool: float, ridge: float) -> None:
        z = (x - self.center) / self.scale
        n = np.bincount(y, minlength=2)
        weights = n / len(y) if n.min() else (n + 0.5) / (len(y) + 1)
        means = [z[y == c].mean(axis=0) if n[c] else z.mean(axis=0) for c in (0, 1)]
        enough = [n[c] >= OWN * z.shape[1] for c in (0, 1)]
        covariances = [np.cov(z[y == c], rowvar=False) if enough[c] else None for c in (0, 1)]
        if all(enough):
            pooled = weights[0] * covariances[0] + weights[1] * covariances[1]
        else:
            inside = z - np.where(y[:, None] == 1, means[1], means[0])
            pooled = inside.T @ inside / max(1, len(y) - 2)
        self.classes = []
        for c in (0, 1):
            s = (1 - pool) * covariances[c] + pool * pooled if enough[c] else pooled
            s = (1 - ridge) * s + ridge * max(np.trace(s) / len(s), FLOOR) * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            self.classes.append((means[c], np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(weights[c])))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The difference of the log densities with the log frequencies."""
        z = (x - self.center) / self.scale
        density = [prior - half - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, half, prior in self.classes]
        return density[1] - density[0]

    @staticmethod
    def _calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
        best = (1.0, 0.0, np.inf)
        for slope in (0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0):
            for shift in np.linspace(-8, 8, 65):
                t = np.clip(slope * margin + shift, -35, 35)
                loss = np.mean(np.log1p(np.exp(np.where(y == 1, -t, t))))
                if loss < best[2]:
                    best = (slope, float(shift), loss)
        return best

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -35, 35)))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> Discriminant:
    """From docs (doc_id, text) and labels (doc_id, quality)."""
    known = labels.filter("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    picked = docs.sparkSession.createDataFrame(picked.collect(), known.schema)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in sliced(b, "text"):
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    found = sorted(rows.mapInArrow(measure, "doc_id long, quality int, x array<double>").collect(), key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 % (1 << 64), r["quality"], r["x"]))
    return Discriminant(np.array([r["x"] for r in found], float).reshape(-1, len(STATISTICS)), (np.array([r["quality"] for r in found], int) > 0).astype(int))


def scored(docs: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in sliced(b, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(statistics(part.column("text"))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
