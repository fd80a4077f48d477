"""Substring dedup: matching statistics of documents against suffix automata of reference shards.

A window is LENGTH consecutive words (split at x20 and x09-x0D) of one document. A word is removed if a window that
covers it also starts in a document with a smaller doc_id; windows are judged on the input.

Documents are dealt into batches, and a batch is a reference shard. Rolling hashes first tell each batch which of its
windows other documents have too, and claim the smallest document for each of these (`exchange`); that document's shard owns the
window. Runs of windows with one claim travel as word sequences, each distinct one once per batch, to the owner's
shard. There, suffix automata over the shard's own sequences, each state with the smallest document that its strings
start in, are held by every task of the shard while the sequences stream through: wherever the match is LENGTH words or
longer, the state of the last LENGTH words tells the smallest document. If that is the claimed one, the window counts for every
other document. The hashes are short, so now and then a claim is wrong: the windows that the automata don't
confirm, few as they are, are then compared as bytes with each other.

An automaton holds at most AUTOMATON_WORDS words of distinct sequences (a sequence above that has one of its own); a shard
with more has several, and the smallest document over all of them counts. A shard that receives more than
SALT_BYTES of sequences is salted: its references are copied to that many tasks and its sequences are dealt over them.

A null or empty text has no words. A null doc_id is larger than all others. Rows of one doc_id are one document: they
don't take words from each other. Equal rows have equal results. An empty table gives an empty result. The words
kept are joined by single spaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import release, table, text_bytes, written
from tallyloom.llm.exchange import NULL_ID, Layout, dealt, look_up, received, shared_hashes
from tallyloom.llm.words import gram_hashes, text_column, within, word_hashes

LENGTH = 13
AUTOMATON_WORDS = 100_000
SALT_BYTES = 16 << 20


class SuffixAutomaton:
    """A suffix automaton over word sequences, each state with the first (smallest) document of its strings.

    Sequences must be added in ascending order of their documents.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.last, self.words = 0, 0

    def add(self, words: list[bytes], doc: int) -> None:
        if self.words:
            self._extend(self.words, doc)  # a separator that occurs nowhere else
        for w in words:
            self._extend(w, doc)
        self.words += len(words)

    def _extend(self, w, doc: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[self.last] + 1)
        first.append(doc)
        p = self.last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def statistics(self, words: list[bytes], least: int) -> Iterator[tuple[int, int]]:
        """(end, first document) of each run of `least` words that ends at word `end` and is known."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state = matched = 0
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(w)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= least:
                while length[link[state]] >= least:  # only the last `least` words matter from here on
                    state = link[state]
                    matched = length[state]
                yield i, first[state]


def _windows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words, at = word_hashes(*text_column(part.column("text")))
    h = gram_hashes(words, LENGTH)
    keep = within(at, LENGTH, len(h))
    return h[keep], np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(h)][keep]


RUNS = "kind int, claim long, batch int, doc long, key long, text string, n_words long, kept_sha256 string, words binary, docs array<long>, keys array<long>, starts array<int>"


def _runs(layout: Layout):
    """Of one batch: finished documents (kind 0), documents to finish (1), runs of windows by owner (2)."""

    def split(docs: pa.Table, shared: pa.Table) -> pa.Table:
        out = {f.split()[0]: [] for f in RUNS.split(", ")}

        def row(**x):
            for c, v in out.items():
                v.append(x.get(c))

        if docs.num_rows:
            known, claims = received(shared)
            batch = docs["batch"][0].as_py()
            data, offsets = text_column(docs["text"])
            words, at, first, end = word_hashes(data, offsets, spans=True)
            h = layout.cut(gram_hashes(words, LENGTH))
            place, has = look_up(known, h)
            has &= within(at, LENGTH, len(h))
            claim = np.where(has, claims[place] if len(claims) else -1, -1)
            doc_of = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(h)]
            ids, keys = docs["doc"].to_numpy(), docs["key"].to_numpy()
            change = np.concatenate([[True], (claim[1:] != claim[:-1]) | (doc_of[1:] != doc_of[:-1])]) if len(h) else np.zeros(0, bool)
            begins = np.flatnonzero(change & has)
            edges = np.append(np.flatnonzero(change), len(h))
            raw = data.tobytes()
            runs: dict[tuple[int, bytes], dict] = {}
            touched = np.zeros(docs.num_rows, bool)
            for b in begins:
                last = int(edges[np.searchsorted(edges, b, "right")]) - 1 + LENGTH - 1  # its last word
                d = int(doc_of[b])
                touched[d] = True
                words_of = b" ".join(raw[first[b] : end[last]].split())
                seen = runs.setdefault((int(claim[b]), words_of), {})
                seen[(int(ids[d]), int(keys[d]), int(b - at[d]))] = None
            for (claimed, words_of), seen in runs.items():
                row(kind=2, claim=claimed, batch=batch, words=words_of, docs=[x[0] for x in seen], keys=[x[1] for x in seen], starts=[x[2] for x in seen])
            for d in range(docs.num_rows):
                x = {"kind": int(touched[d]), "batch": batch, "doc": int(ids[d]), "key": int(keys[d]), "n_words": int(at[d + 1] - at[d])}
                text = raw[offsets[d] : offsets[d + 1]]
                if touched[d]:
                    row(**x, text=text.decode())
                else:
                    row(**x, kept_sha256=hashlib.sha256(b" ".join(text.split())).hexdigest())
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
        return pa.table({c: pa.array(v, kinds[f.split()[1]]) for (c, v), f in zip(out.items(), RUNS.split(", "), strict=True)})

    return split


def _spans(ends: list[int]) -> tuple[list[int], list[int]]:
    """First and past-last words of what the windows with these last words cover."""
    begins, stops = [], []
    for e in ends:
        if stops and e - LENGTH + 1 <= stops[-1]:
            stops[-1] = e + 1
        else:
            begins.append(e - LENGTH + 1)
            stops.append(e + 1)
    return begins, stops


REMOVALS = "batch int, key long, begins array<int>, stops array<int>, doc long, window binary"


def _removals(t: pa.Table) -> pa.Table:
    """Of one salt of one shard: what is removed, by document row; and the windows (window, doc) of unconfirmed claims."""
    t = t.combine_chunks()
    is_own = t["batch"].to_numpy() == t["shard"][0].as_py()
    own = sorted((min(x["docs"]), x["words"]) for x in t.filter(pa.array(is_own)).select(["docs", "words"]).to_pylist())
    automata: list[SuffixAutomaton] = []
    for doc, words in own:
        words = words.split(b" ")
        if not automata or automata[-1].words and automata[-1].words + len(words) > AUTOMATON_WORDS:
            automata.append(SuffixAutomaton())
        automata[-1].add(words, doc)
    out = {f.split()[0]: [] for f in REMOVALS.split(", ")}

    def row(*values):
        for column, v in zip(out.values(), values, strict=True):
            column.append(v)

    mine = pa.array(t["mine"].to_numpy(zero_copy_only=False).astype(bool))
    for x in t.filter(mine).select(["claim", "batch", "words", "docs", "keys", "starts"]).to_pylist():
        words, claim = x["words"].split(b" "), x["claim"]
        confirmed = sorted({e for a in automata for e, first in a.statistics(words, LENGTH) if first == claim})
        begins, stops = _spans(confirmed)
        doubtful = sorted(set(range(LENGTH - 1, len(words))).difference(confirmed)) if len(confirmed) < len(words) - LENGTH + 1 else []
        for doc, key, start in zip(x["docs"], x["keys"], x["starts"], strict=True):
            if doc == claim:  # no smaller document has a window of these hashes
                continue
            if begins:
                row(x["batch"], key, [b + start for b in begins], [s + start for s in stops], None, None)
            for e in doubtful:
                b = e - LENGTH + 1
                row(x["batch"], key, [b + start], [e + 1 + start], doc, b" ".join(words[b : e + 1]))
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.table({c: pa.array(v, kinds[f.split()[1]]) for (c, v), f in zip(out.items(), REMOVALS.split(", "), strict=True)})


RESULT = "doc long, n_words long, n_removed long, kept_sha256 string, kept string"


def _finish(with_text: bool):
    def finish(docs: pa.Table, gone: pa.Table) -> pa.Table:
        spans: dict[int, list[tuple[int, int]]] = {}
        for x in gone.select(["key", "begins", "stops"]).to_pylist():
            spans.setdefault(x["key"], []).extend(zip(x["begins"], x["stops"], strict=True))
        n_words, n_removed, shas, texts = [], [], [], []
        for key, text in zip(docs["key"].to_pylist(), docs["text"].to_pylist(), strict=True):
            words = (text or "").encode().split()
            kept, at = [], 0
            for b, s in sorted(spans.get(key, ())):
                if s > at:
                    kept += words[at : max(at, b)]
                    at = s
            kept += words[at:]
            joined = b" ".join(kept)
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            shas.append(hashlib.sha256(joined).hexdigest())
            texts.append(joined.decode() if with_text else None)
        return pa.table({"doc": docs["doc"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string()), "kept": pa.array(texts, pa.string())})

    return finish


def _written_runs(spark: SparkSession, docs: DataFrame, layout: Layout) -> DataFrame:
    rows = dealt(docs, layout)
    shared = shared_hashes(rows, layout, _windows, owner=True)
    return written(spark, rows.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(_runs(layout), RUNS), "substrings")


def dedup_substrings(spark: SparkSession, docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text, for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    layout = Layout(text_bytes(docs))
    runs = _written_runs(spark, docs, layout)
    release(spark)  # the texts and hashes that were shuffled
    owner = F.pmod(F.xxhash64("claim"), F.lit(layout.n_batches)).cast("int")  # as dealt() deals documents
    moving = runs.filter("kind = 2").select(owner.alias("shard"), "claim", "batch", "words", "docs", "keys", "starts")
    salts = moving.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("words") + 20 * F.size("docs")) / SALT_BYTES).cast("int").alias("salts"))
    moving = moving.join(salts, "shard").withColumn("mine", F.pmod(F.xxhash64("batch", "words"), F.col("salts")).cast("int"))
    refs = F.when(F.col("batch") == F.col("shard"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array("mine"))
    moving = moving.withColumn("salt", F.explode(refs)).withColumn("mine", F.col("mine") == F.col("salt")).drop("salts")
    found = written(spark, moving.groupBy("shard", "salt").applyInArrow(_removals, REMOVALS), "substrings")
    doubtful = found.filter("window is not null")
    first = doubtful.groupBy("window").agg(F.min("doc").alias("first"))
    spans = ["batch", "key", "begins", "stops"]
    gone = found.filter("window is null").select(*spans).unionByName(doubtful.join(first, "window").filter("doc > first").select(*spans))
    left = runs.filter("kind = 1").select("batch", "doc", "key", "text")
    finished = left.groupBy("batch").cogroup(gone.groupBy("batch")).applyInArrow(_finish(with_text), RESULT)
    untouched = runs.filter("kind = 0").select("doc", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept"))
    out = finished.unionByName(untouched)
    return out.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", *["kept"] * with_text)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark, table(spark, sf_dir, "documents"), with_text=False)


OP1_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (
  SELECT doc_id, unnest(range(0, len(words) - 12)) AS i,
         unnest(list_transform(range(1, len(words) - 11), lambda j: array_to_string(words[j:j + 12], ' '))) AS gram
  FROM w WHERE len(words) >= 13),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first_doc FROM g),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS places FROM f WHERE first_doc < doc_id GROUP BY doc_id),
k AS (
  SELECT w.doc_id, coalesce(len(words), 0) AS n_words, coalesce(len(places), 0) AS n_removed,
         CASE WHEN places IS NULL THEN array_to_string(words, ' ')
              ELSE array_to_string(list_filter(words, lambda x, i: NOT list_contains(places, i - 1)), ' ') END AS kept
  FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""
