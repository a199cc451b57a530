"""A training corpus from raw documents: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes what the one before kept, written as Parquet and read again. All but the last return the
columns of `documents`; the last returns one row per packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import common, linededup, mixing, near, packing, quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Least words of a document that the pipeline keeps. The operator's default of 50 would lose one clean document in
#: twenty; the distribution test judges short texts from 20 words on.
MIN_WORDS = 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word that pass the repetition rule and the distribution test."""
    return quality.keep(docs, MIN_WORDS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those with nothing left go."""
    out = linededup.dedup(docs).filter(F.col(common.fresh(docs, "deleted")).isNull() | (F.btrim("text", F.lit(" \t\n\x0b\f\r")) != ""))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, by fingerprints and by five-word shingles."""
    return near.dedup(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: Dedup components, dependent rounding and packing can't be put as SQL; the tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; a stage's scratch tables go once its result is written, and a result once the next one is."""
    docs, last = common.documents(spark, sf_dir), None
    for name, stage in STAGES:
        with common.collected() as tables:
            docs = common.written(stage(spark, docs, sf_dir), name)
        for t in [*tables, *([last] if last is not None else [])]:
            if t is not docs:
                common.discard(t)
        last = docs
    return docs
