"""Snapshots, hourly calendars and fan-out over time."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = ("days", "hours", "minutes", "seconds", "weeks")


def snapshots(spark: SparkSession, start: datetime, end: datetime, delta: int, unit: str = "hours") -> DataFrame:
    """(snapshot) from start to end, both included, `delta` units apart."""
    if unit not in UNITS or delta <= 0:
        raise ValueError(f"delta must be positive and its unit one of {UNITS}")
    step = int(timedelta(**{unit: delta}).total_seconds())
    first, last = (F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz") for t in (start, end))
    # A range of numbers is dealt over tasks; an exploded sequence would be one row's.
    n = max(0, int((end - start).total_seconds()) // step + 1)
    return spark.range(n).select((first + F.make_dt_interval(secs=F.col("id") * step)).alias("snapshot")).filter(F.col("snapshot") <= last)


def calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(ts, date, hour): every hour of the years, leap days included."""
    if not 1 <= first_year <= last_year <= 9999:
        raise ValueError("years must be ordered and within 1..9999")
    hours = (datetime(last_year, 12, 31) - datetime(first_year, 1, 1)).days * 24 + 24
    start = F.lit(f"{first_year:04d}-01-01 00:00:00").cast("timestamp")
    ts = spark.range(hours).select((start + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"))
    return ts.select("ts", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.hour("ts").alias("hour"))


def fan_out(tasks: DataFrame, times: DataFrame, most: int = 100_000) -> DataFrame:
    """One row for each task and snapshot, all of them wanted; up to `most` snapshots are broadcast, more are shuffled."""
    return tasks.crossJoin(F.broadcast(times) if times.count() <= most else times)


def snapshot_json(times: DataFrame) -> DataFrame:
    """(json): the list of snapshots in order, one document."""
    text = F.date_format("snapshot", "yyyy-MM-dd'T'HH:mm:ss")
    return times.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("snapshot", text.alias("t")))), lambda x: x["t"])).alias("json"))
