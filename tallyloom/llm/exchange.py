"""Finding which hashes several documents share, without a row for each hash.

Documents are dealt into batches by a hash of doc_id. Each batch sends its distinct hashes, cut to as many bits as
the amount of text asks for (`hash_bits`), in sorted and packed blobs to buckets by their highest bits. A bucket sorts what
all batches sent, keeps the hashes that more than one document has, and sends them back to the batches that have them.
So a hash that a third of all documents share costs one entry for each batch, not one for each document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import parts, small_batches
from tallyloom.llm.decontaminate import sliced

BATCH_BYTES = 4 << 20
PART_BYTES = 16 << 20
BUCKET_BYTES = 8 << 20
SLICE_BYTES = 4 << 20
NULL_ID = (1 << 63) - 1


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Integers (modulo 2^64) by byte planes, compressed; differences where they rise."""
    v = values.astype(np.uint64)
    if rising and len(v):
        v = np.diff(v, prepend=np.uint64(0))
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(v).to_bytes(4, "little") + bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, rising: bool = False) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), data[4]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5:], max_output_size=max(1, n * width)), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    v = out.reshape(-1).view(np.uint64)
    return np.cumsum(v, dtype=np.uint64) if rising else v


class Layout:
    """How many batches, partitions and buckets, and how many bits of a hash, for so many bytes of text."""

    def __init__(self, n_bytes: int, spare_bits: int = 12):
        self.n_batches = parts(n_bytes, BATCH_BYTES)
        self.n_parts = parts(n_bytes, PART_BYTES)
        self.bucket_bits = max(2, math.ceil(math.log2(parts(n_bytes, BUCKET_BYTES))))
        self.hash_bits = min(64, max(32, math.ceil(math.log2(max(n_bytes, 64) / 6)) + spare_bits))

    def cut(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.hash_bits)

    def bucket_edges(self, h: np.ndarray) -> np.ndarray:
        """Where the buckets begin among cut hashes in order."""
        step = 1 << (self.hash_bits - self.bucket_bits)
        return np.searchsorted(h, np.arange((1 << self.bucket_bits) + 1, dtype=np.uint64) * np.uint64(step))


def dealt(docs: DataFrame, layout: Layout) -> DataFrame:
    """doc (null: NULL_ID), key of the row's doc_id and text, text, batch; hash-partitioned by batch.

    The rows of one doc_id are in one batch; rows without doc_id are dealt by their texts.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("doc_id", "text").alias("key"), "text")
    by = F.when(F.col("doc") == NULL_ID, F.xxhash64("doc", "key")).otherwise(F.xxhash64("doc"))
    return rows.withColumn("batch", F.pmod(by, F.lit(layout.n_batches)).cast("int")).repartition(layout.n_parts, "batch")


def shared_hashes(rows: DataFrame, layout: Layout, hashes: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], owner: bool) -> DataFrame:
    """batch, bucket, hashes, values: the hashes of each batch that several documents have.

    rows: as of dealt(). hashes: gives all hashes (uncut) of some rows and the index of the row of each.
    values: with `owner` the smallest document, else the number of documents (rows without doc_id count once for each batch).
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("batch").to_numpy()
            for n in np.unique(own):
                for part in sliced(b.filter(pa.array(own == n)), "text", SLICE_BYTES):
                    h, row = hashes(part)
                    h, doc = layout.cut(h), part.column("doc").to_numpy()[row]
                    order = np.lexsort((doc, h))
                    h, doc = h[order], doc[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                    h, doc = h[new], doc[new]
                    first = np.ones(len(h), bool)
                    first[1:] = h[1:] != h[:-1]
                    if owner:  # the smallest and the largest document stand for all
                        last = np.append(first[1:], True)
                        h, value = h[first | last], doc[first | last]
                        ids, value = np.unique(value, return_inverse=True)
                    else:
                        at = np.flatnonzero(first)
                        ids, value = np.zeros(0, np.int64), np.diff(np.append(at, len(h)))
                        h = h[at]
                    edges = layout.bucket_edges(h)
                    full = np.flatnonzero(np.diff(edges))
                    cuts = [slice(edges[k], edges[k + 1]) for k in full]
                    small = [np.unique(value[c]) for c in cuts] if owner else None
                    yield pa.RecordBatch.from_arrays([
                        pa.array(full, pa.int32()), pa.array(np.full(len(full), n), pa.int32()),
                        pa.array([pack(h[c], True) for c in cuts], pa.binary()),
                        pa.array([pack(ids[s], True) for s in small] if owner else [b""] * len(cuts), pa.binary()),
                        pa.array([pack(np.searchsorted(s, value[c])) for c, s in zip(cuts, small, strict=True)] if owner else [pack(value[c]) for c in cuts], pa.binary()),
                    ], ["bucket", "batch", "hashes", "ids", "value"])

    def settle(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        batch = t["batch"].to_numpy()
        found = [unpack(x, True) for x in t["hashes"].to_pylist()]
        sent = [unpack(x).astype(np.int64) for x in t["value"].to_pylist()]
        if owner:
            sent = [unpack(i, True).astype(np.int64)[v] for i, v in zip(t["ids"].to_pylist(), sent, strict=True)]
        h, value = np.concatenate(found), np.concatenate(sent)
        whose = np.repeat(batch, [len(x) for x in found])
        order = np.lexsort((value, h)) if owner else np.argsort(h, kind="stable")
        h, value, whose = h[order], value[order], whose[order]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(h))))
        if owner:
            many = value[np.append(at[1:], len(h)) - 1] > value[at] if len(at) else np.zeros(0, bool)
            result = value[at]
        else:
            result = np.add.reduceat(value, at) if len(at) else value
            many = result > 1
        keep = many[group] if len(at) else np.zeros(0, bool)
        h, whose, result = h[keep], whose[keep], result[group][keep] if len(at) else result
        order = np.lexsort((h, whose))
        h, whose, result = h[order], whose[order], result[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (whose[1:] != whose[:-1])
        h, whose, result = h[new], whose[new], result[new]
        to, begin = np.unique(whose, return_index=True)
        edges = np.append(begin, len(h))  # of no batch, if documents share nothing here
        cuts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({
            "batch": pa.array(to, pa.int32()), "bucket": pa.array(np.full(len(to), t["bucket"][0].as_py()), pa.int32()),
            "hashes": pa.array([pack(h[c], True) for c in cuts], pa.binary()), "values": pa.array([pack(result[c]) for c in cuts], pa.binary()),
        })

    sent = rows.mapInArrow(send, "bucket int, batch int, hashes binary, ids binary, value binary")
    return sent.groupBy("bucket").applyInArrow(settle, "batch int, bucket int, hashes binary, values binary")


def received(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The cut hashes in order and their values, of the rows of shared_hashes() for one batch."""
    t = t.sort_by("bucket")
    if not t.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.concatenate([unpack(x, True) for x in t["hashes"].to_pylist()])
    return h, np.concatenate([unpack(x) for x in t["values"].to_pylist()]).astype(np.int64)


def look_up(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each hash among known ones in order, and whether it is there."""
    if not len(known):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return at, known[at] == h
