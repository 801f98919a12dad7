"""A training corpus from documents: quality, exact copies, near copies, benchmark passages, and a mix of sources.

Each stage takes any rows with doc_id, text and source: null texts count as empty, rows are told apart by a number of their
own, so rows that repeat a doc_id (of equal text or not) are judged one by one, and every other column, whatever its name,
passes through unchanged.  An empty table stays empty.  Ties within a group of copies go to the row that comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm.common import stored, table
from sieveline.llm.decontam import clean
from sieveline.llm.exact_dedup import unique
from sieveline.llm.mixing import mixed
from sieveline.llm.quality import good
from sieveline.llm.simhash import BANDS, representatives

#: Near copies share five-word shingles at an exact similarity of 0.8 or more, and fingerprints of their sets then differ
#: in 10 bits on average, with a standard deviation of 3; the BK-trees look for partners five of these further.
WORDS, RADIUS = 5, 24


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects."""
    return good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the longest, then of the smallest doc_id (null last)."""
    return unique(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: of the smallest doc_id (null last)."""
    return representatives(docs, WORDS, RADIUS, BANDS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, copies and taken words (``mix_`` before a name that is in use)."""
    return mixed(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontaminate", benchmark_stage), ("mix", mix_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
