"""Column expressions for map algebra; every one maps missing input (NULL) as its docstring says."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

VEGETATION_CLASSES = (3, 4, 5, 8)
NOT_TERRAIN = (1, 3, 4, 5, 8)
IGNORE = 255


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def clean(v, *nodata: float) -> Column:
    """NaN and the given nodata values as NULL; every operator expects input cleaned this way."""
    v = col(v)
    bad = F.isnan(v.cast("double"))
    for n in nodata:
        bad = bad | (v == F.lit(n))
    return F.when(~bad, v)


# --- array and map functions -----------------------------------------------------------------------------


def weight_array(weights: Mapping[int, float], n: int) -> list[float]:
    """One weight per band, 1.0 where none is given; a weight for a band that doesn't exist is an error."""
    missing = sorted(k for k in weights if not 0 <= k < n)
    if missing:
        raise ValueError(f"missing class band: {missing} of {n} bands")
    return [float(weights.get(k, 1.0)) for k in range(n)]


def reweight(probs, weights: Sequence[float]) -> Column:
    """Band by band product, in single precision."""
    return F.zip_with(col(probs), F.array(*(F.lit(w) for w in weights)), lambda p, w: (p * w).cast("float"))


def argmax(probs) -> Column:
    """Band of the largest value, the first on ties."""
    return F.array_position(col(probs), F.array_max(col(probs))).cast("int") - 1


def remap(v, mapping: Mapping[int, float], default=None) -> Column:
    """Values by a mapping of the source value, so that remaps never chain; others become the default."""
    if not mapping:
        return F.lit(default)
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    found = F.try_element_at(table, col(v).cast("int"))
    return found if default is None else F.coalesce(found, F.lit(default))


# --- predicates ------------------------------------------------------------------------------------------


def vegetation_mask(cls, classes: Sequence[int] = VEGETATION_CLASSES) -> Column:
    return F.coalesce(col(cls).isin(*classes), F.lit(False))


def class1_mask(cls, mask) -> Column:
    """Unclassified points where the image mask is set."""
    return F.coalesce((col(cls) == 1) & (col(mask) != IGNORE), F.lit(False))


def legacy_mask(cls, mask) -> Column:
    """High vegetation, or anything where the mask is set."""
    return F.coalesce(col(cls) == 5, F.lit(False)) | F.coalesce(col(mask) != IGNORE, F.lit(False))


def terrain(cls) -> Column:
    """Classes that count towards the ground: all but unclassified and vegetation."""
    return ~col(cls).isin(*NOT_TERRAIN)


def slope_band(s, low: float = 5.0, high: float = 50.0) -> Column:
    return col(s).between(low, high)


def daylight(altitude, annual: bool = False) -> Column:
    """Above the horizon; the annual table starts one degree below it."""
    return col(altitude) > (-1 if annual else 0)


# --- classification --------------------------------------------------------------------------------------


def height(top, ground) -> Column:
    """Top minus ground, whichever of the two is there, or 0."""
    return F.coalesce(col(top) - col(ground), col(top), col(ground), F.lit(0.0))


def classify_heights(h, mask, low: float, medium: float) -> Column:
    """0 below low, 1 below medium, 2 above, under the mask; a missing height has no class."""
    h = col(h)
    return F.when(col(mask), F.when(h < low, 0).when(h < medium, 1).when(h >= medium, 2))


def vegetation_map(cls, h, mask, image_map, lidar=(0.30, 5.0), image=(0.75, 5.0), modify_image_map: bool = True, keep_class1: bool = False) -> tuple[Column, Column]:
    """(LiDAR map, image map): heights classed under the points' vegetation, and under the image mask.

    Without modify_image_map the image map passes through unchanged.
    """
    points = vegetation_mask(cls)
    points = points | class1_mask(cls, mask) if keep_class1 else points
    masked = F.coalesce(col(mask) != IGNORE, F.lit(False))
    return classify_heights(h, points, *lidar), classify_heights(h, masked, *image) if modify_image_map else col(image_map)


def fuse(lidar, image_map, everywhere: bool = True) -> Column:
    """LiDAR where it has a stratum, else the image map: everywhere, or only where that is herbaceous."""
    rest = col(image_map) if everywhere else F.when(col(image_map) == 0, col(image_map))
    return F.when(col(lidar).isin(0, 1, 2), col(lidar)).otherwise(rest)


def three_to_two(v) -> Column:
    return F.when(col(v) == 3, 2).otherwise(col(v))


def legacy_height(top, ground, cls, mask) -> Column:
    return F.when(legacy_mask(cls, mask), col(top) - col(ground))


def legacy_class(h) -> Column:
    h = col(h)
    return F.when((h >= 0.5) & (h < 1.5), 1).when((h >= 1.5) & (h < 5), 2).when((h >= 5) & (h < 15), 3).when(h >= 15, 4)


def legacy_fuse(lidar, image_map) -> Column:
    return F.coalesce(remap(lidar, {1: 1, 2: 1, 3: 2, 4: 3}), remap(image_map, {0: 0, 1: 1, 2: 2, 3: 3}))


def zero_missing(v) -> Column:
    return F.coalesce(col(v), F.lit(0.0))


# --- indices ---------------------------------------------------------------------------------------------


def slope(dx, dy) -> Column:
    """Slope in radians of the gradient."""
    return F.atan(F.sqrt(col(dx) ** 2 + col(dy) ** 2))


def wetness(area, slope_rad) -> Column:
    """ln(area / tan(slope)); a flat pixel counts as 1e-6 radians."""
    s = F.when(col(slope_rad) == 0, 1e-6).otherwise(col(slope_rad))
    return F.ln(col(area) / F.tan(s))


def infiltration(imperviousness, normalized_slope, weight: float = 0.5) -> Column:
    return (1 - col(imperviousness)) * weight + (1 - col(normalized_slope)) * (1 - weight)


def index_class(v, classes: int = 20) -> Column:
    """The class of an index between 0 and 1, of equal width each, from 0; 1 itself is in the last."""
    return F.least(F.floor(col(v) * classes), F.lit(classes - 1)).cast("int")


def percent(mean) -> Column:
    return F.coalesce(col(mean), F.lit(0.0)) / 100


def rounded(x, digits: int) -> Column:
    """x to so many decimals, by the exact value of the double, halves to even; NULL stays NULL.

    F.round takes halves of the shortest decimal text upwards, which differs: 0.0625 is 0.062 here, 2.675 is 2.67.
    Twice the scaled value is compared with the odd number in the middle, in two parts that are each exact.
    """
    x, scale = col(x).cast("double"), 10.0**digits
    size = F.abs(x)
    high = size * 134217729.0 - (size * 134217729.0 - size)
    low, k = size - high, F.floor(size * scale).cast("double")
    over = lambda whole: (high * (2 * scale) - whole) + low * (2 * scale)
    k = F.when(over(2 * k) < 0, k - 1).when(over(2 * k + 2) >= 0, k + 1).otherwise(k)
    half = over(2 * k + 1)
    up = (half > 0) | ((half == 0) & (k % 2 == 1))
    out = (k + up.cast("int")) / scale
    return F.when(F.signum(x) < 0, -out).otherwise(out)


def round_half_up(x, digits: int) -> Column:
    """F.round of a double, which goes through its decimal text, at a fraction of the cost.

    Where the scaled value is well off a half, rounding it and dividing gives the same double; elsewhere F.round is asked.
    """
    x, scale = col(x), 10.0**digits
    scaled = x * scale
    plain = (F.abs(scaled) < 1e12) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(plain, F.floor(scaled + 0.5) / scale).otherwise(F.round(x, digits))


# --- georeference and names ------------------------------------------------------------------------------


def pixel_center(row, column, x0: float, y1: float, res: float) -> tuple[Column, Column]:
    return x0 + (col(column) + 0.5) * res, y1 - (col(row) + 0.5) * res


def url_basename(url) -> Column:
    return F.element_at(F.split(F.trim(col(url)), "/"), -1)


def with_resolution(name, suffix: str = "_0p5m.tif") -> Column:
    return F.regexp_replace(col(name), r"\.[^.]*$", suffix)


def tile_id(uri) -> Column:
    """Number of a .b3dm uri, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(col(uri), r"(\d+)\.b3dm$", 1), F.lit("")).cast("int"), F.lit(0))
