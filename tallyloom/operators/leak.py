"""Which given texts occur inside documents.

A needle of at least MINIMUM characters is found by its first MINIMUM characters: every document's substrings of that length
meet the needles' heads in an equality join, and what meets is verified. While the needles are small (BROADCAST_BYTES), they
go out as an automaton instead that finds all of them in one pass over a document.
"""

from __future__ import annotations

import base64
import gzip
import json
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # documents are then matched needle by needle
    ahocorasick = None

MINIMUM = 12
BROADCAST_BYTES = 8 << 20


def leaks(docs: DataFrame, needles: DataFrame, doc: str, text: str, needle: str, value: str, minimum: int = MINIMUM) -> DataFrame:
    """doc, needle of all pairs where the document's text holds the needle's value."""
    usable = needles.filter(F.length(value) >= minimum).select(F.col(needle).alias("_needle"), F.col(value).alias("_value"), F.left(value, F.lit(minimum)).alias("_head"))
    small = (usable.agg(F.sum(F.octet_length("_value"))).first()[0] or 0) <= BROADCAST_BYTES
    heads = usable.select("_head").distinct()
    rows = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).filter(F.length("_text") >= minimum)
    if small and ahocorasick is not None:
        return _one_pass(docs, usable, doc, text, needle)
    if small:
        # within the bound, a document is matched against the distinct needles directly
        found = rows.join(F.broadcast(usable), F.contains("_text", F.col("_value")))
        return found.select(F.col("_doc").alias(doc), F.col("_needle").alias(needle))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_text") - minimum + 1), lambda i: F.substr("_text", i, F.lit(minimum))))
    met = rows.select("_doc", F.explode(grams).alias("_head")).join(heads, "_head").join(usable, "_head")
    pairs = met.select("_doc", "_needle", "_value").join(rows, "_doc").filter(F.contains("_text", F.col("_value")))
    return pairs.select(F.col("_doc").alias(doc), F.col("_needle").alias(needle)).distinct()


def _one_pass(docs: DataFrame, needles: DataFrame, doc: str, text: str, needle: str) -> DataFrame:
    """All needles are found in one pass over each document by an automaton; the needles are within BROADCAST_BYTES."""
    kinds = {c.name: c.dataType for c in [*docs.select(F.col(doc).alias("d")).schema, *needles.select(F.col("_needle").alias("n")).schema]}
    numbered = needles.select("_needle", "_value").toArrow()
    places: dict[str, list[int]] = {}
    for i, value in enumerate(numbered["_value"].to_pylist()):
        places.setdefault(value, []).append(i)
    ids = numbered["_needle"].combine_chunks()
    shared = docs.sparkSession.sparkContext.broadcast((places, ids))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, names = shared.value
        machine = ahocorasick.Automaton()
        for value, at in values.items():
            machine.add_word(value, at)
        if values:
            machine.make_automaton()
        for b in batches:
            rows, hits = [], []
            for i, t in enumerate(b.column(1)):
                found = {n for _, at in machine.iter(t.as_py()) for n in at} if values and t.is_valid else ()
                rows += [i] * len(found)
                hits += sorted(found)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), names.take(pa.array(hits, pa.int64()))], [doc, needle])

    schema = f"`{doc}` {kinds['d'].simpleString()}, `{needle}` {kinds['n'].simpleString()}"
    return docs.select(doc, F.col(text)).mapInArrow(scan, schema)


def searchable_forms(raw: bytes) -> list[bytes]:
    """The bytes, and what they hold when they are gzip or zlib data."""
    forms = [raw]
    for opened in (gzip.decompress, zlib.decompress):
        try:
            forms.append(opened(raw))
        except (OSError, EOFError, zlib.error):
            continue
    return forms


def scannable_values(case: str, minimum: int = MINIMUM) -> list[str]:
    """All strings of a JSON value of at least so many characters, and the text of those that are base64."""
    found: set[str] = set()

    def walk(x) -> None:
        if isinstance(x, dict):
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)
        elif isinstance(x, str):
            if len(x) >= minimum:
                found.add(x)
            try:
                plain = base64.b64decode(x, validate=True).decode()
            except ValueError:
                return
            if len(plain) >= minimum:
                found.add(plain)

    walk(json.loads(case))
    return sorted(found)


def needles_of(cases: DataFrame, name: str, body: str, minimum: int = MINIMUM) -> DataFrame:
    """name, value of every scannable string of JSON cases."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(n, v) for n, b in zip(p["name"], p["body"], strict=True) if b is not None for v in scannable_values(b, minimum)]
            yield pd.DataFrame(rows, columns=["name", "value"])

    return cases.select(F.col(name).cast("string").alias("name"), F.col(body).alias("body")).mapInPandas(scan, "name string, value string")
