"""Point clouds to rasters: extent, surface, terrain and class in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions import pixels as px


def extent(points: DataFrame, res: float, *by: str) -> DataFrame:
    """x0, y1, width and height of the points, per tile if asked for."""
    e = points.groupBy(*by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    side = lambda a, b: F.greatest(F.ceil((F.col(b) - F.col(a)) / res), F.lit(1)).cast("int")
    return e.select(*by, "x0", "y1", side("x0", "x1").alias("width"), side("y0", "y1").alias("height"))


def locate(points: DataFrame, extents: DataFrame, res: float, by: list[str] | None = None) -> DataFrame:
    """points with row and col on their extent's grid: one row broadcast, or one a tile joined."""
    on = points.join(extents, by) if by else points.crossJoin(F.broadcast(extents))
    row = F.least(F.greatest(((F.col("y1") - F.col("y")) / res).cast("int"), F.lit(0)), F.col("height") - 1)
    col = F.least(F.greatest(((F.col("x") - F.col("x0")) / res).cast("int"), F.lit(0)), F.col("width") - 1)
    return on.withColumns({"row": row, "col": col}).drop("x0", "y1", "width", "height")


def rasterize(located: DataFrame, order: list[str], by: list[str] | None = None, sequential: str | None = None) -> DataFrame:
    """Surface (max z), terrain (min z of terrain classes) and class of the highest point of each pixel.

    One hash aggregation with map-side combine. Heights are stored in single precision; among points of one
    stored height the first in `order` gives the class. A pixel without terrain points has a NULL terrain.

    `sequential` names a file-order number instead: points of one height then tie as in a loop that replaces a
    stored height by every greater one. Where storing rounds down, an equal later point is greater and wins;
    otherwise the first does.
    """
    z = F.col("z").cast("float")
    if sequential:
        later = z.cast("double") < F.col("z").cast("double")
        order = [F.when(later, -F.col(sequential)).otherwise(F.col(sequential)).alias("seq")]
    top = F.struct((-z).alias("z"), *order)
    return located.groupBy(*(by or []), "row", "col").agg(
        F.max("z").cast("float").alias("dsm"),
        F.min(F.when(px.terrain("cls"), F.col("z"))).cast("float").alias("dtm"),
        F.min_by("cls", top).alias("cls"),
    )


def strata(raster: DataFrame, low: float, medium: float) -> DataFrame:
    """raster with height and vegetation stratum."""
    h = px.height(F.col("dsm").cast("double"), F.col("dtm").cast("double"))
    return raster.withColumn("height", h).withColumn("stratum", px.classify_heights("height", px.vegetation_mask("cls"), low, medium))
