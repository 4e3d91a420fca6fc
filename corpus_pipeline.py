"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, byte-level BPE. Part of the subpackage cairn.llm.

Each stage takes all documents that the one before kept and returns those that it keeps,
with the columns of documents; the last returns tokens, each with its document's place in the mixture: sorted by
(mix_slot, mix_pos), every prefix holds the sources by their target weights to within one block.

No stage fails on nulls, empty or very long texts, repeated rows, empty tables or more columns (these go); what becomes of
such rows is said where the operators are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import jaccard, line_dedup, mixing, quality, tokenize
from cairn.llm.common import discard, materialize, table
from cairn.llm.queries import PATTERN, RANKS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned ones reject go."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.apply_rules(docs, rules).filter("kept").select(*COLUMNS)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which no word is left."""
    out = line_dedup.dedup_lines(docs, whole=True).filter((F.size("deleted_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.keep_one(docs).select(*COLUMNS)


ORDER = ("mix_slot", "mix_pos")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    mixed = mixing.mix_sources(docs)
    return mixed.repartitionByRange(*ORDER, "mix_source").sortWithinPartitions(*ORDER, "mix_source").select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them, and its slot and position. Files keep no order, and documents no column for it:
    the schedule follows from the rows alone, so it is worked out again as the stage before had it."""
    return tokenize.round_trip(mixing.mix_sources(docs.select(*COLUMNS)), RANKS, PATTERN, keep_ids=True, keep=ORDER, memory=60_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_runs),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mixture),
    ("byte_bpe", byte_bpe),
]

#: Learned rules, components and token ids have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
