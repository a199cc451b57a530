"""Sun position as column arithmetic.

The low-precision series of the Astronomical Almanac and Meeus (Astronomical Algorithms, ch. 25), good to
about 0.01 degrees between 1900 and 2100, with parallax and the usual refraction formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.pixels import daylight, rounded


def _sin(c: Column) -> Column:
    return F.sin(F.radians(c))


def _cos(c: Column) -> Column:
    return F.cos(F.radians(c))


def position(ts, latitude: float, longitude: float, pressure: float = 1013.25, temperature: float = 14.6) -> tuple[Column, Column]:
    """(altitude, azimuth from north) in degrees at a UTC timestamp."""
    if not -90 <= latitude <= 90 or not -180 <= longitude <= 180:
        raise ValueError("latitude or longitude out of range")
    ts = F.col(ts) if isinstance(ts, str) else ts
    d = (F.unix_micros(ts) / 1e6 - 946728000.0) / 86400.0
    t = d / 36525.0
    mean = 280.46646 + t * (36000.76983 + t * 0.0003032)
    anomaly = 357.52911 + t * (35999.05029 - t * 0.0001537)
    centre = _sin(anomaly) * (1.914602 - t * (0.004817 + t * 0.000014)) + _sin(anomaly * 2) * (0.019993 - t * 0.000101) + _sin(anomaly * 3) * 0.000289
    node = 125.04 - t * 1934.136
    longitude_ = mean + centre - 0.00569 - _sin(node) * 0.00478
    tilt = 23.439291 - t * 0.0130042 + _cos(node) * 0.00256
    declination = F.degrees(F.asin(_sin(tilt) * _sin(longitude_)))
    ascension = F.degrees(F.atan2(_cos(tilt) * _sin(longitude_), _cos(longitude_)))
    sidereal = 280.46061837 + d * 360.98564736629 + t * t * 0.000387933
    hour = sidereal + longitude - ascension
    lat = F.lit(float(latitude))
    true = F.degrees(F.asin(_sin(lat) * _sin(declination) + _cos(lat) * _cos(declination) * _cos(hour)))
    seen = true - _cos(true) * (8.794 / 3600)
    bend = (pressure / 1010.0) * (283.0 / (273.0 + temperature)) * 1.02 / (F.tan(F.radians(seen + F.lit(10.3) / (seen + 5.11))) * 60)
    altitude = seen + F.when(seen >= -0.8333, bend).otherwise(0.0)
    azimuth = F.degrees(F.atan2(_sin(hour), _cos(hour) * _sin(lat) - F.tan(F.radians(declination)) * _cos(lat))) + 180
    return altitude, azimuth


def ephemeris(hours: DataFrame, latitude: float, longitude: float, annual: bool = True) -> DataFrame:
    """hours with elevation and azimuth, NULL when the sun is down."""
    altitude, azimuth = position("ts", latitude, longitude)
    out = hours.withColumn("elevation", altitude).withColumn("azimuth", azimuth)
    up = daylight("elevation", annual)
    return out.withColumns({"azimuth": F.when(up, F.col("azimuth")), "elevation": F.when(up, F.col("elevation"))})


def day_lines(sun: DataFrame) -> DataFrame:
    """(hour, line): an hour, elevation and azimuth as written, or `--` twice where the sun isn't above the horizon."""
    up = daylight("elevation")
    text = lambda c: F.when(up, F.col(c).cast("string")).otherwise("--")
    return sun.select("hour", F.concat_ws(",", F.col("hour").cast("string"), *(F.coalesce(text(c), F.lit("--")) for c in ("elevation", "azimuth"))).alias("line"))


#: What ends a line of the annual file.
LINE_END = ";\r\n"


def annual_header(latitude: float, longitude: float) -> str:
    """The annual file's first line: the site, then elevation and azimuth of every hour."""
    return ";".join([str(latitude), str(longitude), *(f"{c} {hour:02d}:00:00" for hour in range(24) for c in "EA")])


def annual_file(sun: DataFrame, latitude: float, longitude: float, compat: bool = True) -> DataFrame:
    """(line) in order, in one partition: the header and a line a day, as the annual file holds them.

    Write it with `.write.option("lineSep", LINE_END).text(path)`. A day is one row of about 400 characters.
    """
    header = sun.sparkSession.createDataFrame([("", annual_header(latitude, longitude))], "date string, line string")
    return header.unionByName(annual_lines(sun, compat)).repartition(1).sortWithinPartitions("date").select("line")


def annual_lines(sun: DataFrame, compat: bool = False) -> DataFrame:
    """(date, line): the wide day lines, `;` between and `--` where there is no sun.

    compat adds the two placeholders that put the reference's rows one column over its header.
    """
    text = lambda c: F.when(F.col(c).isNull(), "--").otherwise(rounded(c, 2).cast("string"))
    hours = F.array_sort(F.collect_list(F.struct("hour", F.concat_ws(";", text("elevation"), text("azimuth")).alias("t"))))
    days = sun.groupBy("date").agg(F.concat_ws(";", F.transform(hours, lambda h: h["t"])).alias("t"))
    return days.select("date", F.concat_ws(";", "date", *([F.lit("--"), F.lit("--")] if compat else []), "t").alias("line"))
