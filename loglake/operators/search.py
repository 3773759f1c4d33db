"""Search over stored logs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucket_of
from ..sources import grams

SEARCHED = ("message", "host", "app", "user_id")


def _in_range(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Time filter; on day-partitioned tables also on `dt`, so that days are pruned."""
    df = df.where((F.col("ts") > start) & (F.col("ts") <= end))
    if "dt" in df.columns:
        df = df.where((F.col("dt") >= F.to_date(start)) & (F.col("dt") <= F.to_date(end)))
    return df


def _searched(df: DataFrame) -> Column:
    """The text that searches look into, in lower case."""
    parts = [
        F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
        for c in SEARCHED
    ]
    return F.lower(F.concat_ws(" ", *parts))


def _matches(df: DataFrame, q: str) -> Column:
    """Case-insensitive substring; the text is taken as it is, `%` and `_` included."""
    return F.contains(_searched(df), F.lit(q.lower()))


def _hits(df: DataFrame, q: str, start: Column, now: Column, severity: str) -> DataFrame:
    if not q:
        raise ValueError("empty search text")
    df = _in_range(df, start, now)
    if severity:
        df = df.where(F.lower("severity") == severity.lower())
    return df.where(_matches(df, q))


def _newest(df: DataFrame) -> list:
    return [F.desc("ts")] + ([F.desc("event_id")] if "event_id" in df.columns else [])


def search_logs(
    df: DataFrame, q: str, now: Column, hours: int = 6, severity: str = "", limit: int = 100
) -> DataFrame:
    """Newest log events of the last hours whose text contains q."""
    start = now - F.make_dt_interval(hours=F.lit(hours))
    return _hits(df, q, start, now, severity).orderBy(*_newest(df)).limit(limit)


def index_events(events: DataFrame, index: str) -> int:
    """Bring the gram index of a stored events table up to date; returns the files added."""
    return grams.index_files(events, _searched(events), index)


def narrowed(events: DataFrame, index: str, q: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The stored table without the files that cannot hold q between two times; no match is lost."""
    spark = events.sparkSession
    if not q:
        raise ValueError("empty search text")
    files, _ = grams.files_to_read(spark, events, index, q, start, end)
    if not files:
        return events.where(F.lit(False))
    return spark.read.schema(events.schema).option("basePath", files[0].rsplit("/", grams.PLACE)[0]).parquet(*files)


def search_indexed(
    events: DataFrame, index: str, q: str, now: Column, hours: int = 6, severity: str = "", limit: int = 100
) -> DataFrame:
    """`search_logs` of a stored table, reading only files whose grams and times allow a match."""
    start = now - F.make_dt_interval(hours=F.lit(hours))
    return search_logs(narrowed(events, index, q, start, now), q, now, hours, severity, limit)


def search_stats(
    df: DataFrame, q: str, now: Column, hours: int = 6, severity: str = "", limit: int = 100
) -> DataFrame:
    """One row: hits returned, all matches, minutes searched, range."""
    start = now - F.make_dt_interval(hours=F.lit(hours))
    hit = _matches(df, q)
    if severity:
        hit = hit & (F.lower("severity") == severity.lower())
    per_minute = (
        _in_range(df, start, now)
        .groupBy(bucket_of(F.col("ts"), "minute").alias("minute"))
        .agg(F.count_if(hit).alias("hits"))
    )
    return per_minute.agg(
        F.least(F.coalesce(F.sum("hits"), F.lit(0)), F.lit(limit)).cast("long").alias("total"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("matches"),
        F.count(F.lit(1)).alias("searched_minutes"),
    ).withColumn("time_range_hours", F.lit(hours))


def recent_logs(df: DataFrame, minutes: int, now: Column, limit: int = 500) -> DataFrame:
    """Newest events of the last minutes, 500 at most."""
    hours = math.ceil(minutes / 60)
    start = now - F.make_dt_interval(hours=F.lit(hours))
    since = now - F.make_dt_interval(mins=F.lit(minutes))
    window = _in_range(df, start, now)
    return window.where(F.col("ts") >= since).orderBy(*_newest(df)).limit(limit)


def match_window(insights: DataFrame, hourly: DataFrame) -> DataFrame:
    """Hourly reports that belong to error windows, by start and end."""
    return insights.join(hourly, ["window_start", "window_end"])
