"""From raw documents to packed token sequences, in five stages.

1. ``language``: documents without letters or unlike every learned language go (rank-order profiles).
2. ``exact``: of equal texts the row with the largest id stays (polynomial fingerprints).
3. ``near``: of each component of near duplicates, five-word shingles at similarity 0.8 or more, one row stays (MinHash).
4. ``leaks``: documents that hold a benchmark item, up to a few edits, go (pigeonhole edit matching).
5. ``pack``: what is left is tokenised and packed into sequences (residual best fit).

Every stage takes all that its predecessor kept, in all columns of ``documents``; only the last returns others.  Empty
tables pass through.  SQL cannot express stages 1, 3, 4 and 5, so ``ORACLE_SQL`` is ``None`` and
``tests/llm`` holds the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import edit_leaks, hamming_minhash, poly_dedup, rank_order, residual_packing
from emberlog.llm.common import table
from emberlog.session import cut_lineage

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rank_order.in_known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return poly_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hamming_minhash.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return edit_leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return residual_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("leaks", leaks), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what each keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
