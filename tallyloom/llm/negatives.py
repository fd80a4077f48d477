"""Hard-negative mining by full sorts of each anchor's scores.

Vectors become integers (floor(scale * x), x as double), so scores are exact inner products and the result is the same on every machine.
An anchor's positives are the first rows of its own label by (score descending, id ascending). For each positive the negatives are the first rows of
other labels, in the same order, whose score lies between `lower` and `upper` hundredths of the positive's.

Rows are packed into blocks of bounded size where they are read and dealt round robin, so no key, label or common vector gathers. Each block
of rows meets each block of anchors in one task. There an anchor's scores against the block are sorted once by (score, id); each positive's
upper limit is found by binary search, and k entries of other labels are read from there on while they reach the lower limit. The first ones
of each block are merged by a bounded top-k. A first round does the same for the rows of the anchor's own label, which gives the positives.

A row takes part if it has an id, a label and a vector without null or non-finite components; others are neither anchors nor found. Vectors are compared with those of
the same length only (a score between empty vectors is 0). A positive is a row with another vec_id than the anchor's. Rows that repeat a vec_id are rows of their own, and are
found as often as they are there; of anchors with the same vec_id the first by (label, vector) is the anchor. An anchor without
positives, or a positive without rows between its limits (always so below a score of 0), has no result rows. Components beyond a bound that keeps scores
within 64 bits (2^26 for up to 1024 dimensions) count as that bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PACK_ROWS = 1024  # what one task packs before rows are dealt
LEAST_ROWS = 1024  # of a block that is smaller only to keep cores busy
SCORES = 1 << 23  # held at a time
PACK = "dims int, ids binary, labels binary, codes binary"


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    bound = min(1 << 26, isqrt((1 << 62) // max(1, vectors.shape[1])))
    return np.clip(np.floor(scale * vectors.astype(np.float64)), -bound, bound).astype(np.int32)


def packed(ids: np.ndarray, labels: np.ndarray, codes: np.ndarray) -> dict:
    return {"dims": codes.shape[1], "ids": ids.astype(np.int64).tobytes(), "labels": labels.astype(np.int64).tobytes(), "codes": codes.astype(np.int32).tobytes()}


def unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    return ids, np.frombuffer(row[f"{prefix}labels"], np.int64), np.frombuffer(row[f"{prefix}codes"], np.int32).reshape(len(ids), row["dims"])


def _known(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and codes of the rows that take part, by length of the vectors."""
    batch = batch.filter(pc.and_(pc.and_(batch["vec_id"].is_valid(), batch["label"].is_valid()), batch["embedding"].is_valid()))
    dims = pc.list_value_length(batch["embedding"]).to_numpy(zero_copy_only=False)
    for n in np.unique(dims):
        own = batch.filter(pa.array(dims == n))
        vectors = own["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.num_rows, int(n))  # nulls become NaN
        fine = np.isfinite(vectors).all(axis=1)
        yield own["vec_id"].to_numpy()[fine], own["label"].to_numpy()[fine], integers(vectors[fine], scale)


def _packs(rows: DataFrame, scale: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, labels, codes in _known(b, scale):
                parts = [packed(ids[lo : lo + PACK_ROWS], labels[lo : lo + PACK_ROWS], codes[lo : lo + PACK_ROWS]) for lo in range(0, len(ids), PACK_ROWS)]
                if parts:
                    yield pa.RecordBatch.from_pylist(parts, schema=pa.schema([("dims", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("codes", pa.binary())]))

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").mapInArrow(pack, PACK)


def _blocks(packs: DataFrame, n: int) -> DataFrame:
    """One row for each of n parts and each length of vectors, with the number of the part."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for b in batches:
            for x in b.to_pylist():
                held.setdefault(x["dims"], []).append(unpacked(x))
        at = TaskContext.get().partitionId()
        for own in held.values():
            x = packed(*(np.concatenate(part) for part in zip(*own, strict=True)))
            yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "dims": pa.array([x["dims"]], pa.int32()), **{c: pa.array([x[c]], pa.binary()) for c in ("ids", "labels", "codes")}})

    return packs.repartition(n).mapInArrow(join, "block int, " + PACK)


def scores(anchors: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The inner products of some anchors at a time with all rows, with the place of the first of them. Exact, in floats where these are."""
    most = lambda x: int(np.abs(x).max()) if x.size else 0
    kind = np.float64 if most(anchors) * most(rows) * max(1, rows.shape[1]) < 1 << 53 else np.int64
    other, step = rows.astype(kind).T, max(1, SCORES // max(1, len(rows)))
    for lo in range(0, len(anchors), step):
        yield lo, (anchors[lo : lo + step].astype(kind) @ other).astype(np.int64)


def best_of_label(anchor_ids, anchor_labels, anchors, ids, labels, rows, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor its place, and ids and scores of its first n rows of the same label with another id."""
    for label in np.unique(anchor_labels):
        own, same = np.flatnonzero(anchor_labels == label), np.flatnonzero(labels == label)
        for lo, found in scores(anchors[own], rows[same]):
            for j, s in zip(own[lo : lo + len(found)], found, strict=True):
                order = np.lexsort((ids[same], -s))
                order = order[ids[same][order] != anchor_ids[j]][:n]
                yield j, ids[same][order], s[order]


def between(order: np.ndarray, falling: np.ndarray, others: np.ndarray, positive: int, k: int, lower: int, upper: int) -> np.ndarray:
    """The first k rows of other labels with lower * positive <= 100 * score <= upper * positive.

    order: rows by (score descending, id ascending). falling: the negated scores in this order. others: the places in it of rows of other labels.
    """
    first = np.searchsorted(falling, -(upper * positive // 100), "left")
    end = np.searchsorted(falling, lower * positive // -100, "right")  # minus the least score, rounded up
    at = others[np.searchsorted(others, first) :][:k]
    return order[at[at < end]]


def _met(blocks: DataFrame, anchors: DataFrame, n: int, search: Callable, schema: str) -> DataFrame:
    """search(row block, anchor block) for each pair of blocks."""
    anchors = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                yield from search(x)

    return blocks.join(anchors, ["block", "dims"]).mapInArrow(run, schema)


def hard_negatives(
    spark: SparkSession, rows: DataFrame, anchors: DataFrame, k: int = 10, positives: int = 5, lower: int = 30, upper: int = 90, scale: int = 256,
    block_rows: int = 1 << 15, block_anchors: int = 1 << 12,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score, positive_rank. rows and anchors have vec_id, embedding and label."""
    n_rows = rows.count()
    n = max(1, -(-n_rows // block_rows), min(spark.sparkContext.defaultParallelism, -(-n_rows // LEAST_ROWS)))
    blocks = _blocks(_packs(rows, scale), n)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                ids, labels, codes = unpacked(x)
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "label": labels, "codes": pa.array([c.tobytes() for c in codes], pa.binary())})

    # one row for each anchor; the vector decides as bytes, which is an order as good as any
    single = _packs(anchors, scale).mapInArrow(apart, "vec_id long, label long, codes binary").groupBy("vec_id").agg(F.min(F.struct("label", "codes")).alias("a"))
    single = single.select("vec_id", "a.*", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-anchors.count() // block_anchors)))).alias("part"), (F.octet_length("a.codes") / 4).cast("int").alias("dims"))

    def joined(df: DataFrame, *more: str) -> DataFrame:
        """Anchors as blocks; more: columns that are kept as one binary of longs for each anchor, all in a list."""

        def pack(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            columns = {"dims": pa.array([t["dims"][0].as_py()], pa.int32())}
            for name, c in (("a_ids", "vec_id"), ("a_labels", "label")):
                columns[name] = pa.array([t[c].to_numpy().astype(np.int64).tobytes()], pa.binary())
            columns["a_codes"] = pa.array([b"".join(t["codes"].to_pylist())], pa.binary())
            return pa.table(columns | {c: pa.array([t[c].to_pylist()], pa.list_(pa.list_(pa.int64()))) for c in more})

        schema = "dims int, a_ids binary, a_labels binary, a_codes binary" + "".join(f", {c} array<array<long>>" for c in more)
        return df.groupBy("part", "dims").applyInArrow(pack, schema)

    def search_positives(x: dict) -> Iterator[pa.RecordBatch]:
        ids, labels, codes = unpacked(x)
        a_ids, a_labels, a_codes = unpacked(x, "a_")
        for j, found, s in best_of_label(a_ids, a_labels, a_codes, ids, labels, codes, positives):
            if len(found):
                yield pa.RecordBatch.from_pydict({"anchor_id": np.full(len(found), a_ids[j]), "positive_id": found, "positive_score": s})

    def search_negatives(x: dict) -> Iterator[pa.RecordBatch]:
        ids, labels, codes = unpacked(x)
        a_ids, a_labels, a_codes = unpacked(x, "a_")
        for lo, found in scores(a_codes, codes):
            out = []
            for j, s in enumerate(found, lo):
                order = np.lexsort((ids, -s))
                falling, others = -s[order], np.flatnonzero(labels[order] != a_labels[j])
                for r, (positive, score) in enumerate(zip(x["p_ids"][j], x["p_scores"][j], strict=True), 1):
                    got = between(order, falling, others, score, k, lower, upper)
                    if len(got):
                        out.append([np.full(len(got), v) for v in (a_ids[j], r, positive, score)] + [ids[got], s[got]])
            if out:
                names = ["anchor_id", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score"]
                yield pa.RecordBatch.from_pydict({c: np.concatenate(v).astype(np.int64) for c, v in zip(names, zip(*out, strict=True), strict=True)})

    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = _met(blocks, joined(single), n, search_positives, "anchor_id long, positive_id long, positive_score long")
    found = found.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= positives)
    lists = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("r", "positive_id", "positive_score"))).alias("p"))
    lists = lists.select("vec_id", F.col("p.positive_id").alias("p_ids"), F.col("p.positive_score").alias("p_scores"))
    schema = "anchor_id long, positive_rank long, positive_id long, positive_score long, negative_id long, negative_score long"
    out = _met(blocks, joined(single.join(lists, "vec_id"), "p_ids", "p_scores"), n, search_negatives, schema)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_rank").orderBy(F.desc("negative_score"), "negative_id"))
    # the planner cuts each task's rows to k by anchor and positive before the shuffle
    out = out.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("positive_rank").cast("int").alias("positive_rank"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.common import table

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(spark, rows, rows.filter("vec_id % 100 = 0"))


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label,
         CAST(coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM e a JOIN e r ON len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank
  FROM s WHERE label = anchor_label AND vec_id <> anchor_id QUALIFY positive_rank <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id
  WHERE s.label <> s.anchor_label AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score,
       CAST(positive_rank AS INTEGER) AS positive_rank
FROM n WHERE rank <= 10
"""
