"""Lighting results: counts of lit triangles and flags per tile in arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.pixels import tile_id


def lit_count(rows: DataFrame, by: str = "file", skip_first: bool = False, order: str = "pos") -> DataFrame:
    """Lit rows of each file; skip_first leaves out each file's first row, as the reference does."""
    if skip_first:
        rows = rows.withColumn("first_", F.min(order).over(Window.partitionBy(by))).filter(F.col(order) != F.col("first_"))
    return rows.groupBy(by).agg(F.count_if(F.col("lighted")).alias("n_lit"))


# Red, green and blue of lit and of unlit triangles.
LIT, UNLIT = (1.0, 0.9, 0.01), (0.2, 0.2, 0.2)


def triangle_colour(lighted) -> Column:
    """(r, g, b) of a triangle by its flag; a missing flag is unlit."""
    flag = F.coalesce(lighted if isinstance(lighted, Column) else F.col(lighted), F.lit(False))
    return F.struct(*(F.when(flag, F.lit(a)).otherwise(F.lit(b)).alias(c) for c, a, b in zip("rgb", LIT, UNLIT, strict=True)))


def shades(tiles: DataFrame, flags: DataFrame, uri: str = "uri") -> DataFrame:
    """tiles (uri) with the flags of the tile that their uri names, NULL for a tile without any."""
    return tiles.withColumn("tile", tile_id(uri)).join(flags, "tile", "left")


def flags_by_tile(rows: DataFrame, tile: str = "tile", order: str = "pos") -> DataFrame:
    """(tile, flags): lit flags of a tile in arrival order; a tile's flags are one mesh's, bounded by it."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("lighted", F.lit(False)).alias("lit"))))
    return rows.groupBy(tile).agg(F.transform(ordered, lambda x: x["lit"]).alias("flags"))
