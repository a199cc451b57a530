"""Rasterising and counting over streams.

Surface, terrain, class-of-highest and lit counts are commutative and mergeable given an order column, so
they run as streaming aggregations: state is one row per open pixel and window, and a watermark closes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions import pixels as px


def rasterize_windows(located: DataFrame, order: list[str], time: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Surface, terrain and class of each pixel in each time window of a stream of located points."""
    top = F.struct((-F.col("z").cast("float")).alias("z"), *order)
    grouped = located.withWatermark(time, late).groupBy(F.window(time, window), "row", "col")
    return grouped.agg(
        F.max("z").cast("float").alias("dsm"),
        F.min(F.when(px.terrain("cls"), F.col("z"))).cast("float").alias("dtm"),
        F.min_by("cls", top).alias("cls"),
    )


def lit_windows(rows: DataFrame, by: str = "tile", time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Lit rows of each tile in each time window."""
    return rows.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count_if(F.col("lighted")).alias("n_lit"))


def confusion_windows(pairs: DataFrame, time: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of (ref, pred) in each time window; the dense grid is joined where the counts are read."""
    return pairs.withWatermark(time, late).groupBy(F.window(time, window), "ref", "pred").agg(F.count(F.lit(1)).alias("n"))
