"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit for each dimension, set where the value is above 0. The code is cut into segments of
16 bits. Each block of rows has one table for each segment, sorted by the segment's value. A query looks up all
values within a segment radius, the radius growing by one segment at a time: once the first j + 1 of m segments
were searched with radius s and the rest with s - 1, every code within Hamming distance m * s + j was seen. The
search ends when the kth distance verified so far is within that bound, so results are exact, ties included (the
smaller id wins).

Rows are dealt into blocks of bounded size, and so are the queries; each pair of a query block and a row block is searched in one
task, which builds the tables of the row block once for all queries of the other, and the k best of each block are
merged by query with a bounded aggregate. Query blocks are large, so a row block is copied only a few times, and no smaller than
it takes to keep all cores busy.

A null or empty vector, or a null id, has no code: as a row it is found by no query, as a query it has no result.
Vectors are compared with those of the same length only. A repeated id in the rows is a row of its own; of a
repeated id among the queries the vector that is first in the order of arrays is the query. A query finds itself too (distance 0), as it is a row
like all others. Nulls in a vector count as 0.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = 16
LEAST_QUERIES = 64  # of a block that is smaller only to keep cores busy


def codes_of(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes as rows of 16-bit segments; the lengths. All vectors must be of one length."""
    n = len(vectors)
    flat = np.nan_to_num(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    dims = len(flat) // n if n else 0
    bits = np.packbits(flat.reshape(n, dims) > 0, axis=1)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 2)))
    return np.ascontiguousarray(bits).view(">u2").astype(np.uint16).reshape(n, -1), dims


def flips(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)


def search_block(ids: np.ndarray, codes: np.ndarray, query_codes: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (distances, ids) of its k nearest rows by (distance, id)."""
    n, m = codes.shape
    order = [np.argsort(codes[:, j], kind="stable") for j in range(m)]
    begins = [np.searchsorted(codes[order[j], j], np.arange(65537)) for j in range(m)]
    out = []
    masks = {s: flips(SEGMENT, s) for s in range(3)}
    for q in query_codes:
        seen = np.zeros(n, bool)
        got, dist = [], []
        need, done = min(k, n), False
        for s in range(SEGMENT + 1):
            if s not in masks:
                masks[s] = flips(SEGMENT, s)
            for j in range(m):
                at = masks[s] ^ int(q[j])
                lo, hi = begins[j][at], begins[j][at + 1]
                hit = np.flatnonzero(hi > lo)
                if len(hit):
                    rows = order[j][np.concatenate([np.arange(lo[h], hi[h]) for h in hit])] if len(hit) > 1 else order[j][lo[hit[0]] : hi[hit[0]]]
                    rows = rows[~seen[rows]]
                    if len(rows):
                        seen[rows] = True
                        got.append(rows)
                        dist.append(np.bitwise_count(codes[rows] ^ q).sum(axis=1).astype(np.int64))
                covered = m * s + j
                if got and sum(map(len, got)) >= need:
                    d = np.concatenate(dist)
                    done = len(d) == n or np.partition(d, need - 1)[need - 1] <= covered
                if done:
                    break
            if done:
                break
        if got:
            rows, d = np.concatenate(got), np.concatenate(dist)
            best = np.lexsort((ids[rows], d))[:k]
            out.append((d[best], ids[rows[best]]))
        else:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    return out


def exact_top_k(spark: SparkSession, rows: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 1 << 17, block_queries: int = 1 << 15) -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance. rows and queries have vec_id and embedding."""

    def known(df: DataFrame) -> DataFrame:
        return df.select("vec_id", "embedding").filter("vec_id is not null and size(embedding) > 0")

    def blocks(df: DataFrame, size: int, least: int = 1) -> tuple[DataFrame, int]:
        n_rows = df.count()
        n = max(1, -(-n_rows // size), min(least, -(-n_rows // LEAST_QUERIES)))
        return df.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn("dims", F.size("embedding")), n

    def packed(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        codes, _ = codes_of(t["embedding"].combine_chunks())
        ids = t["vec_id"].to_numpy().astype(np.int64)
        return pa.table({"block": t["block"][:1].cast("int32"), "dims": t["dims"][:1].cast("int32"), "ids": pa.array([ids.tobytes()], pa.binary()), "codes": pa.array([codes.tobytes()], pa.binary())})

    schema = "block int, dims int, ids binary, codes binary"
    r, nr = blocks(known(rows), block_rows)
    q = known(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    q, nq = blocks(q, block_queries, -(-spark.sparkContext.defaultParallelism // nr))
    r = r.groupBy("block", "dims").applyInArrow(packed, schema)
    q = q.groupBy("block", "dims").applyInArrow(packed, schema).select(F.col("block").alias("at"), "dims", F.col("ids").alias("q_ids"), F.col("codes").alias("q_codes"))
    pairs = r.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).join(q, ["at", "dims"])

    def searched(batches):
        for b in batches:
            for x in b.to_pylist():
                ids, q_ids = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["q_ids"], np.int64)
                codes, q_codes = (np.frombuffer(x[c], np.uint16).reshape(len(i), -1) for c, i in (("codes", ids), ("q_codes", q_ids)))
                found = search_block(ids, codes, q_codes, k)
                for lo in range(0, len(found), 4096):
                    part = found[lo : lo + 4096]
                    yield pa.RecordBatch.from_pydict({"query_id": np.repeat(q_ids[lo : lo + 4096], [len(d) for d, _ in part]), "distance": np.concatenate([d for d, _ in part]).astype(np.int32), "neighbor_id": np.concatenate([i for _, i in part])})

    # small rows with much work each: dealt by number, not by bytes
    found = pairs.select("ids", "codes", "q_ids", "q_codes").repartition(max(1, nr * nq)).mapInArrow(searched, "query_id long, distance int, neighbor_id long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    # the planner cuts each task's rows to k by query before the shuffle
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.common import table

    rows = table(spark, sf_dir, "embeddings")
    return exact_top_k(spark, rows, rows.filter("vec_id % 50 = 0"), k=10)


OP8_SQL = """
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id,
         list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: abs(z[1] - z[2]))) AS distance
  FROM codes q, codes r WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, CAST(distance AS INTEGER) AS distance
FROM ranked WHERE rank <= 10
"""
