"""Tile inventories: parsing, selection by origin, what is left to do, and the newest artifact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_origin(tiles: DataFrame) -> DataFrame:
    """tiles with x_min and y_min: both as given, else both from a name like "1830_5175" in kilometres.

    A tile with neither is an error when its origin is used.
    """
    for c, kind in (("x_min", "bigint"), ("y_min", "bigint"), ("nom", "string")):
        if c not in tiles.columns:
            tiles = tiles.withColumn(c, F.lit(None).cast(kind))
    part = lambda i: F.expr(f"try_cast(trim(get(split(nom, '_'), {i})) as bigint)") * 1000
    both = F.col("x_min").isNotNull() & F.col("y_min").isNotNull()
    named = part(0).isNotNull() & part(1).isNotNull()
    pick = lambda c, i: F.when(both, F.col(c)).when(named, part(i)).otherwise(F.raise_error(F.lit("tile without an origin")).cast("bigint"))
    return tiles.withColumns({"x_min": pick("x_min", 0), "y_min": pick("y_min", 1)})


def select(tiles: DataFrame, x_min: int, x_max: int, y_min: int, y_max: int) -> DataFrame:
    """Tiles whose origin lies in the box, both ends included."""
    if x_min > x_max or y_min > y_max:
        raise ValueError("bounding box is not ordered")
    return tiles.filter(F.col("x_min").between(x_min, x_max) & F.col("y_min").between(y_min, y_max))


def not_yet(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done, key, "left_anti")


def latest(files: DataFrame, by: list[str] | None = None, path: str = "path", time: str = "modificationTime") -> DataFrame:
    """The newest file, of each group if asked for; the last path on ties."""
    newest = F.max_by(path, F.struct(time, path))
    return files.groupBy(*(by or [])).agg(newest.alias(path), F.max(time).alias(time))
