"""Shared pieces: row keys, word patterns, and the scratch tables of the sources package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.sources.tables import collected, discard, shared_root, tidied, written

__all__ = ["collected", "discard", "documents", "fresh", "keyed", "n_words", "shared_root", "tidied", "written"]

#: Words are maximal runs of anything but space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't use."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """docs with a unique long row key, and that column's name.

    Ids that are all present and distinct serve as they are. Otherwise the rows are written once with a
    generated number, so that every later read sees the same number for the same row.
    """
    key = fresh(docs, "row_key")
    ids = docs.groupBy(F.col(id_col).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("n > 1 or i is null").isEmpty():
        return docs.withColumn(key, F.col(id_col).cast("long")), key
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def n_words(text: Column) -> Column:
    """Words of a text as a long; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
