"""The corpus pipeline: five stages applied to ``documents`` one after the other.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import bpe, decontam, linededup, neardup, quality
from pathloom.llm.common import store, table
from pathloom.llm.queries import word_bpe

#: The stages have no SQL form (a trained model, hashes and a tokenizer decide); tests compare with brute force.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more).

    Null and empty texts are scored as one empty line; without labelled rows every document scores 0.5 and stays.
    """
    chain = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, chain)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without line chunks that occurred before; documents of which nothing is left go.

    Null texts, and texts that were empty before, stay.
    """
    out = linededup.dedup(docs)
    return out.where((F.col("_n_removed") == 0) | (F.trim("text") != "")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8), that of the smallest id.

    Texts without words are in no group; rows with a null id, and rows that repeat a kept id, stay.
    """
    return neardup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; null and empty texts, and all texts if there is no benchmark, stay."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts, a row for every document; null text is empty."""
    return bpe.round_trip(docs, word_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_round_trip),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
