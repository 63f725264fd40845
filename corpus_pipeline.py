"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, pieces.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept. All but the last give the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import contamination, line_dedup, neardup, pieces, repetition
from linkloom.llm.base import table
from linkloom.session import work_path

#: Near copies share so much of their word shingles; op10 has its own threshold.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return repetition.passing(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many pages of a source go; the documents stay."""
    return line_dedup.dedup_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.keep_one(docs, NEAR_PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return contamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left, and whether they give its text back."""
    found = pieces.round_trips(docs, pieces.load_vocabulary(), ["doc_id", "lang", "source"])
    return found.select("row.*", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near),
    ("benchmark_decontamination", benchmark),
    ("sentencepiece", tokens),
]

#: Signatures, and paths over pieces, have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        path = work_path(spark, f"pipeline-{name}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
