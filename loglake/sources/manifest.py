"""What the files of a stored events table hold, so that counts need no events.

One row per file and hour: events, first and last time, the minutes of the hour
that have events (a bit each), and a sketch of the tenants.  Rows of all files add
up to the table's figures.  Files that are not in the manifest yet are read for
theirs, and files that are gone no longer count, so results are always those of the
files the table has now.  Spark's file names are never used twice, so a known name
needs no second look.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bucket_of, in_zone
from . import storage
from .grams import PLACE, _file, _place

SCHEMA = "file string, size_bytes long, hour timestamp_ntz, n long, first timestamp_ntz, last timestamp_ntz, minutes long, tenants binary"


def _rows(spark: SparkSession, events: DataFrame, files: list[str], tenant: str) -> DataFrame:
    """Manifest rows of some files; only the time and the tenant are read."""
    root = files[0].rsplit("/", PLACE)[0]
    ts = F.col("ts").cast("timestamp_ntz")
    return spark.read.schema(events.schema).option("basePath", root).parquet(*files).select(
        _file(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_size").alias("size_bytes"),
        ts.alias("ts"), F.col(tenant).cast("string").alias("tenant"),
    ).groupBy("file", "size_bytes", bucket_of(F.col("ts"), "hour").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.bit_or(F.expr("shiftleft(1L, minute(ts))")).alias("minutes"), F.hll_sketch_agg("tenant").alias("tenants"),
    )


def _known(spark: SparkSession, path: str) -> DataFrame:
    if not storage._exists(spark, f"{path}/_SUCCESS"):
        return spark.createDataFrame([], SCHEMA)
    # A file that two jobs have added at a time counts once.
    return spark.read.schema(SCHEMA).parquet(path).dropDuplicates(["file", "hour"])


def _names(rows: DataFrame) -> set[str]:
    return {r.file for r in rows.select("file").distinct().collect()}


def update(events: DataFrame, path: str, tenant: str = "tenant_id") -> int:
    """Add the files of a stored events table that the manifest does not have; returns how many."""
    spark = events.sparkSession
    known = _names(_known(spark, path))
    new = [p for p in events.inputFiles() if _place(p) not in known]
    if new:
        _rows(spark, events, new, tenant).write.mode("append").parquet(path)
    return len(new)


def facts(events: DataFrame, path: str, tenant: str = "tenant_id") -> DataFrame:
    """Manifest rows of the files that the table has now.

    The names of files are listed at the driver, as in Spark's own file listing.
    """
    spark = events.sparkSession
    rows = _known(spark, path)
    files, known = {_place(p): p for p in events.inputFiles()}, _names(rows)
    gone = sorted(known - set(files))
    if gone:
        rows = rows.join(spark.createDataFrame([(f,) for f in gone], "file string"), "file", "left_anti").select(rows.columns)
    new = sorted(p for name, p in files.items() if name not in known)
    return rows.unionByName(_rows(spark, events, new, tenant)) if new else rows


def table_stats(rows: DataFrame) -> DataFrame:
    """Rows, first and last time, number of tenants, as `sql_surface.table_stats` gives them."""
    return rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.min("first").alias("min_ts"), F.max("last").alias("max_ts"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("tenants")), F.lit(0)).alias("tenant_count"),
    )


def table_size(rows: DataFrame) -> DataFrame:
    """Files, rows and bytes."""
    return rows.groupBy("file").agg(F.sum("n").alias("n"), F.max("size_bytes").alias("size")).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"),
    )


def hourly_counts(rows: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Events per hour, of the hours in [start, end)."""
    if start is not None:
        rows = rows.where(F.col("hour") >= start)
    if end is not None:
        rows = rows.where(F.col("hour") < end)
    return rows.groupBy("hour").agg(F.sum("n").alias("event_count"))


def minutes_with_events(rows: DataFrame) -> DataFrame:
    """The minutes that have events, once each; null if events without a time are there."""
    whole = rows.groupBy("hour").agg(F.bit_or("minutes").alias("minutes"))
    at = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda m: F.when(
        F.getbit("minutes", m) == 1, F.col("hour") + F.make_dt_interval(mins=m)
    ))
    none = F.array(F.lit(None).cast("timestamp_ntz"))
    return whole.select(F.explode(F.when(F.col("hour").isNull(), none).otherwise(F.array_compact(at))).alias("bucket"))


def missing_rollups(rows: DataFrame, stats: DataFrame, tz: str = "UTC") -> DataFrame:
    """Minutes that have events but no rollup, as `storage.missing_rollups` gives them."""
    seen = minutes_with_events(rows).select(bucket_of(in_zone(F.col("bucket"), tz), "minute").alias("bucket")).distinct()
    return seen.join(stats.select("bucket").distinct(), "bucket", "left_anti")
