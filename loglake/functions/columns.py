"""Small column helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def case_of(col: Column, mapping: dict, default) -> Column:
    """CASE over a small fixed mapping; stays inside generated code."""
    out = None
    by_value: dict = {}
    for key, value in mapping.items():
        by_value.setdefault(value, []).append(key)
    for value, keys in by_value.items():
        out = (F if out is None else out).when(col.isin(keys), F.lit(value))
    return out.otherwise(default)


def bucket_of(ts: Column, unit: str) -> Column:
    """Start of the minute / hour / day, as TIMESTAMP_NTZ."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def in_zone(ts: Column, tz: str) -> Column:
    """Wall-clock time of a UTC timestamp in a time zone."""
    return ts if tz.upper() == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def filled(col: Column, default: str) -> Column:
    """Empty or missing text becomes `default`."""
    return F.when(F.length(col) > 0, col).otherwise(F.lit(default))


LIMIT_IN_PLAN = 1000  # spark.sql.optimizer.windowGroupLimitThreshold
NO_LIMIT = 2**31 - 1
SALTS = 64


def top_k(df: DataFrame, by: list, order: list, k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group.

    Spark cuts every map partition to k rows per group before the shuffle
    (WindowGroupLimit), so a hot group does not reach one task whole.  It does
    so up to k = 1000 only; beyond, the group is cut in salted parts first.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    if LIMIT_IN_PLAN < k < NO_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        parts = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(parts)).where(F.col("_r") <= k).drop("_salt", "_r")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def ntz(text: str) -> Column:
    """Literal TIMESTAMP_NTZ."""
    return F.lit(text).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds as double, microseconds kept; for NTZ or LTZ columns."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def plus_seconds(ts: Column, secs: Column) -> Column:
    """Timestamp moved by a whole or fractional number of seconds."""
    return ts + F.make_dt_interval(secs=F.round(secs, 6).cast("decimal(18,6)"))
