"""Neighbourhood operators on dense rasters.

Neighbours come from two windows, along rows and along columns, so a 3x3 stencil shuffles each pixel twice
and never multiplies it. Rasters must be dense: missing values are rows with a NULL, not missing rows.
Window groups are a raster's rows or columns, within a tile if `by` names one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.sources.tables import discard, written


def _near(value: Column | str, index: str, step: int, window) -> Column:
    """The value `step` pixels on, if that pixel is there."""
    there = F.lead(index, step).over(window) == F.col(index) + step
    return F.when(there, F.lead(value, step).over(window))


def neighbours(raster: DataFrame, v: str = "v", by: tuple[str, ...] = ()) -> DataFrame:
    """raster with `near`: the values of the 8 neighbours, NULL where there is none."""
    across, down = Window.partitionBy(*by, "row").orderBy("col"), Window.partitionBy(*by, "col").orderBy("row")
    three = raster.withColumn("three_", F.struct(_near(v, "col", -1, across).alias("l"), F.col(v).alias("c"), _near(v, "col", 1, across).alias("r")))
    three = three.withColumns({"up_": _near("three_", "row", -1, down), "down_": _near("three_", "row", 1, down)})
    rows = [F.col(f"{s}.{p}") for s in ("up_", "three_", "down_") for p in ("l", "c", "r") if (s, p) != ("three_", "c")]
    return three.withColumn("near", F.array(*rows)).drop("three_", "up_", "down_")


def gradient(raster: DataFrame, v: str = "v", res: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """raster with d_row and d_col: central differences inside, one-sided at the edges."""

    def along(index: str, other: str) -> Column:
        w = Window.partitionBy(*by, other).orderBy(index)
        before, after = _near(v, index, -1, w), _near(v, index, 1, w)
        here = F.col(v)
        first, last = F.lag(index).over(w).isNull(), F.lead(index).over(w).isNull()
        return F.when(first & last, F.lit(0.0)).when(first, after - here).when(last, here - before).otherwise((after - before) / 2) / res

    return raster.withColumn("d_row", along("row", "col")).withColumn("d_col", along("col", "row"))


def lower_neighbours(raster: DataFrame, v: str = "v", by: tuple[str, ...] = ()) -> DataFrame:
    """raster with `area`: one plus the neighbours below the centre; 1 on the border."""
    across, down = Window.partitionBy(*by, "row"), Window.partitionBy(*by, "col")
    inner = (F.col("col") > F.min("col").over(across)) & (F.col("col") < F.max("col").over(across))
    inner = inner & (F.col("row") > F.min("row").over(down)) & (F.col("row") < F.max("row").over(down))
    lower = F.size(F.filter("near", lambda n: n < F.col(v)))
    return neighbours(raster, v, by).withColumn("area", F.when(inner, lower + 1).otherwise(1)).drop("near")


def fill_jacobi(raster: DataFrame, v: str = "v", cls: str | None = "cls", water: int = 9, by: tuple[str, ...] = ()) -> DataFrame:
    """Holes filled ring by ring from the state before each round, until nothing changes; tile by tile if `by` names one.

    Water pixels take the tile's minimum first, and so do holes that no value reaches; a tile without any value
    becomes zeros. Each round is written to the shared folder and costs one pass over the tiles that still have
    holes that values reach; rounds are as many as the widest hole's radius.
    """
    names = [*raster.columns, "least_"]
    least = raster.groupBy(*by).agg(F.min(v).alias("least_"))
    now = raster.join(least, list(by)) if by else raster.crossJoin(F.broadcast(least))  # one row
    value = F.col(v) if cls is None else F.when(F.col(cls) == water, F.col("least_")).otherwise(F.col(v))
    now = written(now.withColumn(v, F.when(F.col("least_").isNull(), 0.0).otherwise(value)).select(names), "fill")
    done = None
    while True:
        holes = now.groupBy(*by).agg(F.count_if(F.col(v).isNull()).alias("holes_"))
        left, whole = holes.agg(F.sum("holes_"), F.count_if(F.col("holes_") == 0)).first()
        if not left:
            break
        if by and whole:  # tiles without holes are done
            open_ = written(holes.filter("holes_ > 0").drop("holes_"), "open")
            rest, now = (now.join(open_, list(by), how) for how in ("left_anti", "left_semi"))
            done = rest if done is None else done.unionByName(rest)
        known = F.filter("near", lambda n: n.isNotNull())
        mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
        step = written(neighbours(now, v, by).withColumn(v, F.coalesce(F.col(v), mean)).select(names), "fill")
        stuck = step.filter(F.col(v).isNull()).count() == left
        if not by:
            discard(now)
        now = step
        if stuck:
            break
    out = now if done is None else done.unionByName(now)
    return out.withColumn(v, F.coalesce(F.col(v), F.col("least_"))).drop("least_")


def fill_in_place(raster: DataFrame, window: int = 3, by: str = "tile_id") -> DataFrame:
    """Holes filled in reading order, later ones seeing earlier fills; borders are skipped, then 0.

    Sequential by definition, so a tile (bounded in size) is one task's group.
    """
    if window <= 0 or window % 2 == 0:
        raise ValueError("window must be odd and positive")
    k = window // 2

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = frame["row"].min(), frame["col"].min()
        grid = np.full((frame["row"].max() - r0 + 1, frame["col"].max() - c0 + 1), np.nan)
        at = frame["row"] - r0, frame["col"] - c0
        grid[at] = frame["v"].to_numpy(float)
        for r, c in zip(*np.nonzero(np.isnan(grid)), strict=True):
            if k <= r < grid.shape[0] - k and k <= c < grid.shape[1] - k:
                seen = grid[r - k : r + k + 1, c - k : c + k + 1]
                seen = seen[~np.isnan(seen)]
                if seen.size:
                    grid[r, c] = seen.mean()
        return frame.assign(v=np.nan_to_num(grid[at]))

    return raster.select(by, "row", "col", F.col("v").cast("double").alias("v")).groupBy(by).applyInPandas(fill, f"{by} string, row int, col int, v double")
