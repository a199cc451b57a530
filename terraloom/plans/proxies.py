"""Test tables seen as rasters, point clouds and cells, once in Spark and once as DuckDB common table expressions.

They prove operators, not geodata: lineitem is a point cloud, embeddings are class probabilities.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators import blocks
from terraloom.operators import points as pts
from terraloom.session import load
from terraloom.sources.tables import written

#: Point order: every column, so that what still ties is the same row.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def points(spark: SparkSession, sf: str) -> DataFrame:
    line = load(spark, sf, "lineitem")
    return line.select((F.col("l_partkey") / 20).alias("x"), (F.col("l_suppkey") / 5).alias("y"), F.col("l_extendedprice").alias("z"), F.col("l_linenumber").alias("cls"), *ORDER)


def raster(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels (row, col, dsm, dtm, cls)."""
    p = points(spark, sf)
    return pts.rasterize(pts.locate(p, pts.extent(p, 1.0), 1.0), ORDER)


def dem(spark: SparkSession, sf: str) -> DataFrame:
    """A dense raster (row, col, v, cls); pixels without points are at 1000."""
    ext = pts.extent(points(spark, sf), 1.0)
    rows = ext.select("width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row")).repartition("row")
    full = rows.select("row", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))
    r = raster(spark, sf)
    return full.join(r, ["row", "col"], "left").select("row", "col", F.coalesce(F.col("dsm").cast("double"), F.lit(1000.0)).alias("v"), F.coalesce("cls", F.lit(0)).alias("cls"))


def dem_pixels(spark: SparkSession, sf: str) -> blocks.Raster:
    """The dense raster by its pixels with points; points that tie on the order's first two columns have one class."""
    p = points(spark, sf)
    ext = pts.extent(p, 1.0)
    height, width = ext.select("height", "width").first()
    r = pts.rasterize(pts.locate(p, ext, 1.0), ORDER[:2])
    pixels = r.select("row", "col", F.coalesce(F.col("dsm").cast("double"), F.lit(1000.0)).alias("v"), F.coalesce("cls", F.lit(0)).alias("cls"))
    return blocks.Raster(pixels, height, width, 1000.0)


def _holes(rows, cols, v, cls) -> None:
    v[(rows * 7 + cols * 3) % 5 == 0] = float("nan")


def holed_pixels(spark: SparkSession, sf: str) -> blocks.Raster:
    """The dense raster with holes, by its pixels with points, which are written as filling reads them more than once."""
    dem = dem_pixels(spark, sf)
    return replace(dem, pixels=written(dem.pixels, "pixels"), edit=_holes)


def holed(spark: SparkSession, sf: str) -> DataFrame:
    """The dense raster with holes; class 7 stands for water."""
    hole = (F.col("row") * 7 + F.col("col") * 3) % 5 == 0
    return dem(spark, sf).select("row", "col", F.when(~hole, F.col("v")).alias("v"), "cls")


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels (row, col, probs) of 19 bands."""
    e = load(spark, sf, "embeddings")
    return e.select("vec_id", (F.col("vec_id") % 20).cast("int").alias("row"), F.floor(F.col("vec_id") / 20).cast("int").alias("col"), F.slice("embedding", 1, 19).alias("probs"), "label")


_ORDER_SQL = ", ".join(ORDER)
#: The same, as SQL: pts, ext, loc, ras, dem, holed, slopes, prob.
POINTS = f"""
pts AS (SELECT CAST(l_partkey AS DOUBLE) / 20 AS x, CAST(l_suppkey AS DOUBLE) / 5 AS y, l_extendedprice AS z, l_linenumber AS cls, {_ORDER_SQL} FROM lineitem),
ext AS (SELECT min(x) AS x0, max(y) AS y1, greatest(CAST(ceil(max(x) - min(x)) AS INTEGER), 1) AS width, greatest(CAST(ceil(max(y) - min(y)) AS INTEGER), 1) AS height FROM pts),
loc AS (SELECT pts.*, least(greatest(CAST(trunc(y1 - y) AS INTEGER), 0), height - 1) AS "row", least(greatest(CAST(trunc(x - x0) AS INTEGER), 0), width - 1) AS col FROM pts, ext),
ras AS (SELECT "row", col, CAST(max(z) AS FLOAT) AS dsm, CAST(min(z) FILTER (WHERE cls NOT IN (1, 3, 4, 5, 8)) AS FLOAT) AS dtm,
    first(cls ORDER BY CAST(z AS FLOAT) DESC, {_ORDER_SQL}) AS cls FROM loc GROUP BY "row", col)"""
DEM = (
    POINTS
    + """,
dem AS (SELECT g."row", g.col, coalesce(CAST(dsm AS DOUBLE), 1000.0) AS v, coalesce(cls, 0) AS cls
    FROM (SELECT r."row", c.col FROM (SELECT CAST(unnest(range(height)) AS INTEGER) AS "row" FROM ext) r, (SELECT CAST(unnest(range(width)) AS INTEGER) AS col FROM ext) c) g LEFT JOIN ras ON g."row" = ras."row" AND g.col = ras.col),
grad AS (SELECT d."row", d.col, d.v,
    CASE WHEN u.v IS NULL AND b.v IS NULL THEN 0.0 WHEN u.v IS NULL THEN b.v - d.v WHEN b.v IS NULL THEN d.v - u.v ELSE (b.v - u.v) / 2 END AS d_row,
    CASE WHEN l.v IS NULL AND r.v IS NULL THEN 0.0 WHEN l.v IS NULL THEN r.v - d.v WHEN r.v IS NULL THEN d.v - l.v ELSE (r.v - l.v) / 2 END AS d_col
    FROM dem d LEFT JOIN dem u ON u."row" = d."row" - 1 AND u.col = d.col LEFT JOIN dem b ON b."row" = d."row" + 1 AND b.col = d.col
    LEFT JOIN dem l ON l."row" = d."row" AND l.col = d.col - 1 LEFT JOIN dem r ON r."row" = d."row" AND r.col = d.col + 1),
slopes AS (SELECT *, atan(sqrt(d_row * d_row + d_col * d_col)) AS slope_rad, degrees(atan(sqrt(d_row * d_row + d_col * d_col))) AS slope_deg FROM grad),
areas AS (SELECT d."row", d.col, d.v, CASE WHEN d."row" > 0 AND d."row" < height - 1 AND d.col > 0 AND d.col < width - 1
    THEN 1 + (SELECT count(*) FROM dem n WHERE n."row" BETWEEN d."row" - 1 AND d."row" + 1 AND n.col BETWEEN d.col - 1 AND d.col + 1 AND n.v < d.v) ELSE 1 END AS area FROM dem d, ext),
holed AS (SELECT "row", col, CASE WHEN ("row" * 7 + col * 3) % 5 <> 0 THEN v END AS v, cls FROM dem)"""
)
PROB = """
prob AS (SELECT vec_id, CAST(vec_id % 20 AS INTEGER) AS "row", CAST(vec_id // 20 AS INTEGER) AS col, embedding[1:19] AS probs, label FROM embeddings)"""
