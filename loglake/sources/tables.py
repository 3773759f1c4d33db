"""Rolling stored tables forward: minutes, hours and days that are still missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bucket_of
from ..operators import issues, rollup
from . import storage


def _windows(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Windows a stored table has."""
    if not storage._exists(spark, path):
        return spark.createDataFrame([], "window_start timestamp_ntz")
    return spark.read.parquet(path).select(F.col(key).alias("window_start")).distinct()


def roll_forward(events: DataFrame, root: str, start: Column, end: Column) -> None:
    """Fill the gaps of the stored tables below `root` for the hours and days in [start, end).

    Only events of missing hours are counted; days are summed from stored
    minutes once the range covers them.  The tables `minutes`, `hours` and
    `days` are partitioned by day, and windows already stored stay as they
    are, so the job can run again at any time.
    """
    spark = events.sparkSession
    hour = bucket_of(F.col("ts"), "hour")
    missing = storage.missing_windows(_windows(spark, f"{root}/hours", "hour"), start, end)
    todo = events.where((F.col("ts") >= bucket_of(start, "hour")) & (F.col("ts") < end)).join(
        missing, hour == F.col("window_start"), "left_semi"
    )
    storage.write_report(rollup.minute_stats(todo), f"{root}/minutes", "bucket")
    if not storage._exists(spark, f"{root}/minutes"):
        return
    minutes = spark.read.parquet(f"{root}/minutes")
    new = minutes.join(missing, bucket_of(F.col("bucket"), "hour") == F.col("window_start"), "left_semi").drop("dt")
    storage.write_report(rollup.hourly_stats(new), f"{root}/hours", "hour")
    days = storage.missing_windows(_windows(spark, f"{root}/days", "day"), start, end, "day")
    whole = minutes.join(days, bucket_of(F.col("bucket"), "day") == F.col("window_start"), "left_semi").drop("dt")
    storage.write_report(rollup.daily_stats(whole), f"{root}/days", "day")


def roll_issues(events: DataFrame, root: str, day: Column) -> DataFrame:
    """Bring the stored issue table one day further and return it."""
    spark = events.sparkSession
    today = issues.daily_error_patterns_of_events(events.where(bucket_of(F.col("ts"), "day") == day))
    state = storage.read_version(spark, root)
    if state is None:
        state = spark.createDataFrame(
            [], "pattern_id string, first_seen timestamp_ntz, last_seen timestamp_ntz, status string, severity string, sample_message string"
        )
    after = issues.resolve_missing(issues.upsert_issues(state, today), today, day)
    storage.write_version(after.select(*state.columns), root)
    return storage.read_version(spark, root)
