"""Joining rasters: padding, cropping, mosaicking, and overlap on a shared grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pad_outer(left: DataFrame, right: DataFrame, fill: dict | None = None) -> DataFrame:
    """Every pixel of either raster; missing values become `fill`'s, or stay NULL."""
    out = left.join(right, ["row", "col"], "full_outer")
    return out.fillna(fill) if fill else out


def pad_left(base: DataFrame, other: DataFrame, crop: bool = True) -> DataFrame:
    """The base raster's pixels with the other's values; without crop a larger other is an error."""
    if not crop:
        over = other.join(base, ["row", "col"], "left_anti")
        if not over.isEmpty():
            raise ValueError("raster is larger than its base")
    return base.join(other, ["row", "col"], "left")


def shape(*rasters: DataFrame) -> DataFrame:
    """The least shape (height, width) that holds all rasters."""
    union = rasters[0].select("row", "col")
    for r in rasters[1:]:
        union = union.unionByName(r.select("row", "col"))
    return union.agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


def mosaic(tiles: DataFrame, order: str = "tile_id", value: str = "v") -> DataFrame:
    """One raster of all tiles' pixels (row, col on the shared grid); the first tile with a value wins."""
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    return tiles.groupBy("row", "col").agg(F.when(F.count(value) > 0, first).alias(value))


def overlap(ref: DataFrame, pred: DataFrame, ref_geo: tuple, pred_geo: tuple) -> DataFrame:
    """(row, col, ref, pred) where both rasters lie, on the prediction's grid, nearest reference pixel.

    A geo is (x0, y1, res); both rasters share a coordinate system. The reference index is arithmetic on
    the prediction's pixel centre, so the join is on equality. Disjoint rasters are an error.
    """
    (rx, ry, rres), (x0, y1, res) = ref_geo, pred_geo
    x, y = x0 + (F.col("col") + 0.5) * res, y1 - (F.col("row") + 0.5) * res
    at = pred.select("row", "col", F.col("v").alias("pred"), F.floor((ry - y) / rres).cast("int").alias("r"), F.floor((x - rx) / rres).cast("int").alias("c"))
    out = at.join(ref.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("v").alias("ref")), ["r", "c"])
    return require_overlap(out.select("row", "col", "ref", "pred"))


def require_overlap(joined: DataFrame) -> DataFrame:
    if joined.isEmpty():
        raise ValueError("rasters do not overlap")
    return joined


def blocks(raster: DataFrame, size: int = 256) -> DataFrame:
    """raster with block keys, to write or shuffle by."""
    return raster.withColumn("block_row", F.floor(F.col("row") / size).cast("int")).withColumn("block_col", F.floor(F.col("col") / size).cast("int"))


def resampled_size(size: int, res: float, target: float) -> int:
    """Pixels of a side at a target resolution, at least one."""
    if target <= 0 or res <= 0:
        raise ValueError("resolutions must be positive")
    return max(1, int(size / (target / res)))


def source_resolution(x_res: float, y_res: float) -> float:
    """A raster's resolution; pixels that aren't square within 1e-9 are an error."""
    if abs(abs(x_res) - abs(y_res)) > 1e-9:
        raise ValueError(f"pixels aren't square: {x_res} x {y_res}")
    return abs(x_res)


def bilinear(raster: DataFrame, height: int, width: int, res: float, target: float) -> DataFrame:
    """(row, col, v) at a target resolution: each new pixel's centre between the four old centres around it.

    New sides are int(side / scale), at least one, and the new pixels cover the raster exactly. Beyond the
    outermost centres the nearest row and column count; missing old pixels are left out of the weights. A new
    pixel lists the old ones it reads, four at most, and meets them on equality.
    """
    rows, cols = resampled_size(height, res, target), resampled_size(width, res, target)
    spark = raster.sparkSession
    new = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))

    def sides(index: str, n: int, size: int, out: str) -> Column:
        at = F.greatest(F.lit(0.0), F.least(F.lit(float(size - 1)), (F.col(index) + 0.5) * (size / n) - 0.5))
        low = F.floor(at).cast("int")
        pair = F.array(F.struct(low.alias(out), (1 - (at - low)).alias("w" + out)), F.struct((low + 1).alias(out), (at - low).alias("w" + out)))
        return F.explode(F.filter(pair, lambda s: s["w" + out] > 0))

    reads = new.select("row", "col", sides("row", rows, height, "r").alias("y")).select("row", "col", "y.*", sides("col", cols, width, "c").alias("x")).select("row", "col", "r", "wr", "x.*")
    old = raster.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("v").cast("double").alias("v"))
    weight = F.when(F.col("v").isNotNull(), F.col("wr") * F.col("wc"))
    met = reads.join(old, ["r", "c"], "left").groupBy("row", "col")
    return met.agg((F.sum(weight * F.col("v")) / F.nullif(F.sum(weight), F.lit(0.0))).alias("v"))


def block_average(raster: DataFrame, factor: int) -> DataFrame:
    """Our own resampling to a coarser grid: the mean of each factor x factor block's values."""
    r, c = (F.floor(F.col(x) / factor).cast("int").alias(x) for x in ("row", "col"))
    return raster.groupBy(r, c).agg(F.avg("v").alias("v"))
