"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Texts are sets of five-word shingles (A-Z lowered, words split at x20 and x09-x0D; fewer than five words make one
shingle of the whole sequence). A document holds an item if at least 80 % of the item's shingles are among the
document's.

Both sides have MinHash sketches of one hash function. An item of n shingles has the n - ceil(0.8 n) + 1 smallest of its hashes: a
document of any length that holds the item holds one of them, with certainty and not just likely. Items are partitioned by
the power of two of their size. In each partition a document large enough to hold its smallest item has as its sketch all its
hashes up to the largest of the items' sketches, so the part of a document that counts depends on the sizes in the partition and
not on how long the document is. Documents and items that share a sketch hash are candidates. (Banded MinHash
of whole documents would miss short items in long ones, whose Jaccard similarity is near 0.) Candidates whose hashes
say that enough shingles are shared are verified by the words of the shingles themselves.

The items are broadcast in blocks of bounded text size. If there are several, each has a pass of its own over the documents, whose findings are written, and is given up before the
next one is made; so the memory doesn't depend on their number. Null or empty
texts, on either side, hold and match nothing. Repeated rows are rows of their own: a result row for each document row
and item row that match. Null ids are carried through. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import parts, small_batches, text_bytes, written
from tallyloom.llm.words import lower_words, shared_shingles, shingle_sets, text_column

SCHEMA = "doc_id long, item_id long, n_shared int, n_item int"
ITEM_BLOCK_BYTES = 8 << 20


def needed(n: np.ndarray | int, percent: int):
    """The least number of n shingles that is percent of them."""
    return -(-n * percent // 100)


class ItemBlock:
    """Items of one block by size partition: sketch hashes in order with their owners, and all shingles."""

    def __init__(self, ids: list, texts: pa.Array, k: int = 5, percent: int = 80):
        self.ids, self.k, self.percent = ids, k, percent
        self.hashes, self.at = shingle_sets(texts, k)
        self.size = np.diff(self.at)
        level = np.where(self.size > 0, np.log2(np.maximum(self.size, 1)).astype(int), -1)
        self.partitions = []
        for p in np.unique(level[level >= 0]):
            own = np.flatnonzero(level == p)
            sketches = [self.hashes[self.at[i] : self.at[i + 1]][: self.size[i] - needed(int(self.size[i]), percent) + 1] for i in own]
            owner = np.repeat(own, [len(s) for s in sketches])
            flat = np.concatenate(sketches)
            order = np.argsort(flat, kind="stable")
            self.partitions.append((needed(int(self.size[own].min()), percent), flat[order], owner[order]))
        self.words: dict[int, list[bytes]] = {}
        self.texts = texts

    def candidates(self, hashes: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) of all that share a sketch hash in some partition. hashes: those of each document in order."""
        size, pairs = np.diff(at), set()
        doc = np.repeat(np.arange(len(size)), size)
        for least, sketch, owner in self.partitions:
            part = np.flatnonzero((hashes <= sketch[-1]) & (size[doc] >= least))  # the documents' sketches
            lo = np.searchsorted(sketch, hashes[part])
            part, lo = part[sketch[lo] == hashes[part]], lo[sketch[lo] == hashes[part]]
            hi = np.searchsorted(sketch, hashes[part], "right")
            item = owner[np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
            pairs.update(zip(np.repeat(doc[part], hi - lo).tolist(), item.tolist(), strict=True))
        return pairs

    def _words(self, o: int) -> list[bytes]:
        if o not in self.words:
            self.words[o] = lower_words(self.texts[o].as_py())
        return self.words[o]

    def matches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, shared shingles, the item's shingles) of all documents that hold an item."""
        hashes, at = shingle_sets(texts, self.k)
        pairs = self.candidates(hashes, at)
        found, last, own_words = [], -1, []
        for d, o in sorted(pairs):
            own, item = hashes[at[d] : at[d + 1]], self.hashes[self.at[o] : self.at[o + 1]]
            spot = np.searchsorted(own, item)
            spot[spot == len(own)] = 0
            shared = int((own[spot] == item).sum())
            if 100 * shared >= self.percent * len(item):
                if d != last:
                    last, own_words = d, lower_words(texts[d].as_py())
                shared, _, n = shared_shingles(own_words, self._words(o), self.k)
                if 100 * shared >= self.percent * n:
                    found.append((d, o, shared, n))
        return tuple(np.array([x[i] for x in found], np.int64) for i in range(4))


def item_blocks(spark: SparkSession, items: DataFrame, k: int = 5, percent: int = 80) -> tuple[int, Iterator[Broadcast]]:
    """How many blocks of about ITEM_BLOCK_BYTES of text the items have, and each of them as a broadcast when it is asked for."""
    items = items.select("item_id", "text").filter("text is not null")
    n_blocks = parts(text_bytes(items), ITEM_BLOCK_BYTES)

    def made() -> Iterator[Broadcast]:
        for i in range(n_blocks):
            own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == i).toArrow()
            yield spark.sparkContext.broadcast(ItemBlock(own["item_id"].to_pylist(), own["text"].combine_chunks(), k, percent))

    return n_blocks, made()


def contained_items(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_shared, n_item for every document (doc_id, text) that holds an item (item_id, text)."""
    small_batches(spark)
    found, (n_blocks, blocks) = None, item_blocks(spark, items, k, percent)
    for block in blocks:

        def look(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            held = block.value
            ids = pa.array(held.ids, pa.int64())
            for b in batches:
                for part in sliced(b, "text"):
                    d, o, shared, n = held.matches(part.column("text"))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d)), ids.take(pa.array(o)), pa.array(shared, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "item_id", "n_shared", "n_item"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(look, SCHEMA)
        if n_blocks > 1:
            part = written(spark, part, "contained")
            block.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def sliced(batch: pa.RecordBatch, column: str, n_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of text, one row at least."""
    _, offsets = text_column(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + n_bytes, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def decontaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with their columns. Each row goes by its own text, whatever its doc_id."""
    small_batches(spark)
    schema, at = docs.schema, docs.columns.index("text")
    n_blocks, blocks = item_blocks(spark, items)
    if n_blocks == 1:
        block = next(blocks)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = block.value
            for b in batches:
                for part in sliced(b, b.schema.names[at]):
                    keep = np.ones(part.num_rows, bool)
                    keep[held.matches(part.column(at))[0]] = False
                    yield part.filter(pa.array(keep))

        return docs.mapInArrow(clean, schema)
    dirty = None  # digests of the texts that hold an item
    for block in blocks:

        def find(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            held = block.value
            for b in batches:
                for part in sliced(b, "text"):
                    texts = part.column("text").take(pa.array(np.unique(held.matches(part.column("text"))[0])))
                    yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t.as_py().encode()).digest() for t in texts], pa.binary())], ["digest"])

        part = written(spark, docs.select("text").mapInArrow(find, "digest binary").distinct(), "contained")
        block.destroy()
        dirty = part if dirty is None else dirty.unionByName(part)
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2("text", 256)).alias("digest"))
    return rows.join(dirty.distinct(), "digest", "left_anti").select("row.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.common import table

    return contained_items(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SHINGLES_SQL = """
  SELECT {id}, unnest(CASE WHEN len(w) >= 5
      THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM (SELECT {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x20\\x09-\\x0D]+') AS w FROM {table} WHERE text IS NOT NULL)
"""
OP9_SQL = f"""
WITH d AS ({SHINGLES_SQL.format(id="doc_id", table="documents")}),
i AS ({SHINGLES_SQL.format(id="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_shared AS INTEGER) AS n_shared, CAST(n_item AS INTEGER) AS n_item
FROM s JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""
