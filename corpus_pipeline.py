"""A training corpus from `documents` in five stages; each works on all that the one before it kept.

Nulls, empty texts and repeated rows are treated as each operator's docstring says. In short: texts without
letters leave in stage 1; lines of later repeated runs are cut from texts in stage 2 (a text may become empty, and stays);
of each group of near copies the smallest doc_id stays in stage 3, and of equal rows one; documents that hold a benchmark item leave
in stage 4; stage 5 gives doc_id, n_ids and ids. Other columns pass through unchanged, n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import fresh_path, scratch, table, written
from tallyloom.llm.decontaminate import decontaminated
from tallyloom.llm.jaccard import one_of_each
from tallyloom.llm.langid import keep_identified
from tallyloom.llm.lines import WORDS, dedup_lines
from tallyloom.llm.pieces import Vocabulary, encoded


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages of the corpus."""
    return keep_identified(spark, docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of later repeated runs."""
    out = dedup_lines(docs, WORDS)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(out.columns[-1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingle similarity of 0.8 or more."""
    return one_of_each(spark, docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`."""
    return decontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids."""
    return encoded(docs, Vocabulary.load())


STAGES = [
    ("language ID", identify_languages),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: language ID, near copies by hash and Viterbi have no SQL form; tests compare stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage-{i + 1}")
        with scratch(spark):  # what a stage writes on its way goes once its result is there
            docs = written(spark, stage(spark, docs, sf_dir), f"stage-{i + 1}", path)
    return docs
