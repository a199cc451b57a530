"""Regular grids and zonal statistics by index arithmetic: membership is a group-by, coverage an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import pixels as px

SLOPE_METHODS = ("mean_thresholded", "slope_std_dev", "slope_max", "slope_mean_denoised", "best_fit_plane")


def grid(spark: SparkSession, minx: float, miny: float, maxx: float, maxy: float, size: float) -> DataFrame:
    """Cells (i, j, minx, miny, maxx, maxy) of a size; partial cells at the far edges are dropped."""
    if size <= 0 or maxx < minx or maxy < miny:
        raise ValueError("bounds must be ordered and the size positive")
    cols, rows = int((maxx - minx) // size), int((maxy - miny) // size)
    ids = spark.range(cols * rows)
    i, j = F.floor(F.col("id") / max(rows, 1)).cast("int"), (F.col("id") % max(rows, 1)).cast("int")
    box = ids.select(i.alias("i"), j.alias("j"))
    x, y = minx + F.col("i") * F.lit(float(size)), miny + F.col("j") * F.lit(float(size))
    return box.select("i", "j", x.alias("minx"), y.alias("miny"), (x + size).alias("maxx"), (y + size).alias("maxy"))


def cells(raster: DataFrame, size: int) -> DataFrame:
    """raster with the cell (i, j) that holds each pixel's centre; cells are half open."""
    return raster.withColumn("i", F.floor(F.col("col") / size).cast("int")).withColumn("j", F.floor(F.col("row") / size).cast("int"))


def _plane() -> Column:
    """Degrees of the least-squares plane z ~ x + y; flat below three pixels, least norm where x and y are collinear."""
    sxx, syy, sxy = F.var_pop("x"), F.var_pop("y"), F.covar_pop("x", "y")
    sxz, syz = F.covar_pop("x", "z"), F.covar_pop("y", "z")
    det, trace = sxx * syy - sxy * sxy, sxx + syy
    full = det > 1e-12 * trace * trace
    a = F.when(full, (sxz * syy - syz * sxy) / F.nullif(det, F.lit(0.0))).otherwise(sxz / F.nullif(trace, F.lit(0.0)))
    b = F.when(full, (syz * sxx - sxz * sxy) / F.nullif(det, F.lit(0.0))).otherwise(syz / F.nullif(trace, F.lit(0.0)))
    tilt = F.degrees(F.atan(F.sqrt(a * a + b * b)))
    return F.when(F.count("z") >= 3, F.coalesce(tilt, F.lit(0.0))).otherwise(0.0)


def slope_stat(method: str) -> Column:
    """An aggregate over pixels (slope_deg, slope_rad; x, y, z for the plane) of a cell; 0 where there is nothing."""
    found = {
        "mean_thresholded": lambda: F.avg(F.when(px.slope_band("slope_deg"), F.col("slope_deg"))),
        "slope_std_dev": lambda: F.stddev_pop("slope_deg"),
        "slope_max": lambda: F.max("slope_deg"),
        "slope_mean_denoised": lambda: F.avg("slope_rad"),
        "best_fit_plane": _plane,
    }
    if method not in found:
        raise ValueError(f"unknown method {method}; one of {SLOPE_METHODS}")
    return F.coalesce(found[method](), F.lit(0.0))


def zonal_slope(raster: DataFrame, size: int, method: str) -> DataFrame:
    """(i, j, slope) of every cell of `size` pixels."""
    return cells(raster, size).groupBy("i", "j").agg(slope_stat(method).alias("slope"))


def zonal_slope_on_grid(raster: DataFrame, geo: tuple, bounds: tuple, size: float, method: str) -> DataFrame:
    """The cells of `grid` over bounds (minx, miny, maxx, maxy) with the slope of the pixels whose centres they hold.

    A geo is (x0, y1, res). Cells start at the lower left corner, partial ones are dropped and pixels in them
    with it; cells without pixels have 0. The cell is arithmetic on the centre, so only sums are shuffled.
    """
    (x0, y1, res), (minx, miny, maxx, maxy) = geo, bounds
    out = grid(raster.sparkSession, minx, miny, maxx, maxy, size)
    cols, rows = int((maxx - minx) // size), int((maxy - miny) // size)
    x, y = px.pixel_center("row", "col", x0, y1, res)
    at = {"i": F.floor((x - minx) / size).cast("int"), "j": F.floor((y - miny) / size).cast("int")}
    inside = raster.withColumns(at).filter(F.col("i").between(0, cols - 1) & F.col("j").between(0, rows - 1))
    found = inside.groupBy("i", "j").agg(slope_stat(method).alias("slope"))
    return out.join(found, ["i", "j"], "left").fillna(0.0, ["slope"])


def weighted_mean(boxes: DataFrame, raster: DataFrame, res: float = 1.0) -> DataFrame:
    """boxes (i, j, minx..maxy, y growing with row) with the coverage-weighted mean of the pixels they touch.

    A box lists the pixel indices it covers, bounded by its own size, and meets the raster on equality.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / res).cast("int"), (F.ceil(F.col(b) / res) - 1).cast("int"))
    c = boxes.withColumn("col", F.explode(span("minx", "maxx"))).withColumn("row", F.explode(span("miny", "maxy")))
    overlap = lambda a, b, at: F.least(F.col(b), (F.col(at) + 1) * res) - F.greatest(F.col(a), F.col(at) * res)
    w = (overlap("minx", "maxx", "col") * overlap("miny", "maxy", "row")).alias("w")
    met = c.select("i", "j", "row", "col", w).join(raster.filter("v is not null").select("row", "col", "v"), ["row", "col"])
    mean = met.groupBy("i", "j").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("mean"))
    return boxes.join(mean, ["i", "j"], "left")


def min_max(table: DataFrame, column: str, out: str) -> DataFrame:
    """table with a column scaled to its range; NULL where the range is empty. The two bounds are one row."""
    bounds = table.agg(F.min(column).cast("double").alias("lo_"), F.max(column).cast("double").alias("hi_"))
    scaled = (F.col(column) - F.col("lo_")) / F.nullif(F.col("hi_") - F.col("lo_"), F.lit(0.0))
    return table.crossJoin(F.broadcast(bounds)).withColumn(out, scaled).drop("lo_", "hi_")
