"""The corpus pipeline: documents through the stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercata.llm import packing as _packing
from mercata.llm import quality as _quality
from mercata.llm import simhash as _simhash
from mercata.llm import substrings as _substrings
from mercata.llm.text import word_count
from mercata.session import write_table
from mercata.sources.tables import read_table

#: The contract of SimHash near-dedup: shingles of three words, one 64-bit fingerprint, at most 3 differing bits.
SHINGLE, FINGERPRINT_WORDS, MOST_BITS = 3, 1, 3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go.

    Null and empty texts are scored as empty ones; repeated rows share their
    score; without documents there are no rows, and without labels nothing is
    known and every row stays.
    """
    return _quality.keep_good(docs, read_table(spark, sf_dir, "labels"), "doc_id", "text", "quality")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id.

    Documents whose fingerprints differ in at most ``MOST_BITS`` bits are
    linked; null and empty texts have fingerprint zero and are one group. Rows
    of one doc_id count as one document, rows without a doc_id stay.
    """
    return _simhash.keep_first(docs, "doc_id", "text", SHINGLE, FINGERPRINT_WORDS, MOST_BITS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 20 words or more that also stand earlier go from the text; n_chars follows.

    Null, empty and short texts stay as they are; rows equal in doc_id and text
    are one document and lose the same.
    """
    out = _substrings.strip_repeats(docs, "doc_id", "text")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of every document that is left.

    Null and empty texts have length 0 and take the smallest bucket; a text
    longer than the budget is a batch alone; repeated rows are rows of their own.
    """
    return _packing.pack(docs, "doc_id", word_count(F.col("text")))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: SQL cannot express the classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
