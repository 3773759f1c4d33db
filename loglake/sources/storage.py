"""Stored tables: raw lines, minute buckets, events, reports, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bucket_of, in_zone
from ..schemas import STORED_EVENT


def read_raw_lines(
    spark: SparkSession, path: str | None = None, stream: bool = False, source: str = "text",
    options: dict | None = None, sender: str = "0.0.0.0", transport: str = "udp",
) -> DataFrame:
    """Raw lines `(value, sender, transport)` as a table or stream.

    `text` reads files a collector wrote; folders named `sender=...` and
    `transport=...` fill those columns.  `kafka` takes the message key as the
    sender (its connector must be on the class path), `socket` is for trials.
    """
    reader = (spark.readStream if stream else spark.read).format(source).options(**(options or {}))
    df = reader.load(path) if path else reader.load()
    if source == "kafka":
        return df.select(
            F.col("value").cast("string").alias("value"),
            F.coalesce(F.col("key").cast("string"), F.lit(sender)).alias("sender"),
            F.lit(transport).alias("transport"),
            F.col("timestamp").cast("timestamp_ntz").alias("received_at"),
        )
    for name, value in (("sender", sender), ("transport", transport)):
        df = df.withColumn(name, F.col(name).cast("string") if name in df.columns else F.lit(value))
    keep = [c for c in ("received_at",) if c in df.columns]
    return df.where(F.length(F.trim("value")) > 0).select("value", "sender", "transport", *keep)


# Both layouts of a minute bucket: 2024/01/05/10/14.ndjson and y=2024/m=01/d=05/h=10/mi=14/...
_BUCKET_PATH = r"(?:y=)?(\d{4})/(?:m=)?(\d{2})/(?:d=)?(\d{2})/(?:h=)?(\d{2})/(?:mi=)?(\d{2})(?:\.[^/]*|/[^/]*)$"


def _path_time(path: Column) -> Column:
    """Wall-clock minute of a bucket path, null for other files."""
    text = F.regexp_replace(F.regexp_extract(path, _BUCKET_PATH, 0), "[a-z]+=", "")
    stamp = F.regexp_extract(text, r"^\d{4}/\d{2}/\d{2}/\d{2}/\d{2}", 0)
    return F.try_to_timestamp(stamp, F.lit("yyyy/MM/dd/HH/mm")).cast("timestamp_ntz")


def bucket_time_from_path(df: DataFrame, out: str = "bucket") -> DataFrame:
    """Add the minute that the path of the file a row comes from stands for."""
    return df.withColumn(out, _path_time(F.col("_metadata.file_path")))


def read_buckets(
    spark: SparkSession, root: str, start: Column | None = None, end: Column | None = None, tz: str = "UTC",
    pattern: str = "*.{ndjson,json}",
) -> DataFrame:
    """Stored events of the minute buckets in [start, end) (UTC); lines that are no JSON are skipped.

    With both ends given only the folders of those days are listed; the range
    is a condition on the file path, so files outside are not opened.
    """
    lower = None if start is None else bucket_of(in_zone(start, tz), "minute")
    upper = None if end is None else in_zone(end, tz)
    paths = [root] if start is None or end is None else _day_folders(spark, root, lower, upper)
    reader = (
        spark.read.schema(STORED_EVENT).option("mode", "DROPMALFORMED")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    )
    if not paths:
        return spark.createDataFrame([], STORED_EVENT).withColumn("bucket", F.lit(None).cast("timestamp_ntz"))
    df = reader.json(paths)
    at = _path_time(F.col("_metadata.file_path"))
    df = df.where(at.isNotNull())
    if start is not None:
        df = df.where(at >= lower)
    if end is not None:
        df = df.where(at < upper)
    return df.withColumn("bucket", at)


def _day_folders(spark: SparkSession, root: str, lower: Column, upper: Column) -> list[str]:
    """Folders of the days in [lower, upper), of either layout, that are there."""
    days = spark.range(1).select(F.explode(F.sequence(
        bucket_of(lower, "day"), bucket_of(upper, "day"), F.expr("INTERVAL 1 DAY")
    )).alias("d")).select(F.date_format("d", "yyyy/MM/dd").alias("a"), F.date_format("d", "'y='yyyy/'m='MM/'d='dd").alias("b"))
    return [f"{root}/{folder}" for row in days.collect() for folder in row if _exists(spark, f"{root}/{folder}")]


def bucket_files(spark: SparkSession, root: str, pattern: str = "*.{ndjson,json}") -> DataFrame:
    """`(bucket, path, size, lines)` of every bucket file."""
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    )
    return (
        lines.groupBy("path").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("lines"))
        .withColumn("bucket", _path_time(F.col("path"))).where("bucket IS NOT NULL")
    )


def write_buckets(df: DataFrame, root: str, bucket: Column) -> None:
    """Append stored events as JSON lines, one folder per minute."""
    parts = {"y": "yyyy", "m": "MM", "d": "dd", "h": "HH", "mi": "mm"}
    for name, fmt in parts.items():
        df = df.withColumn(name, F.date_format(bucket, fmt))
    df.hint("rebalance", *parts).write.partitionBy(*parts).mode("append").json(root)


def with_partitions(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """Add `dt` and `hr` of the receive time (event time where none is known)."""
    at = F.coalesce("received_at", "ts") if "received_at" in df.columns else F.col("ts")
    local = in_zone(at.cast("timestamp_ntz"), tz)
    return df.withColumn("dt", F.to_date(local)).withColumn("hr", F.hour(local))


def write_events(df: DataFrame, root: str, tz: str = "UTC", fmt: str = "parquet") -> None:
    """Append unique events to storage partitioned by day and hour.

    The rebalance hint lets Spark split an hour with many events over several
    files and join small ones; rows are sorted by time inside a file so that
    time filters skip row groups.
    """
    out = with_partitions(df, tz).hint("rebalance", "dt", "hr").sortWithinPartitions("dt", "hr", "ts")
    out.write.partitionBy("dt", "hr").mode("append").format(fmt).save(root)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_report(df: DataFrame, root: str, key: str = "hour") -> None:
    """Append report rows of windows that are not stored yet, partitioned by day.

    Only the days being written are looked up in what is stored.
    """
    spark = df.sparkSession
    df = df.withColumn("dt", F.to_date(key))
    if _exists(spark, root):
        stored = spark.read.parquet(root).select(key, "dt").join(df.select("dt").distinct(), "dt", "left_semi")
        df = df.join(stored.select(key).distinct(), key, "left_anti")
    df.write.partitionBy("dt").mode("append").parquet(root)


def latest_reports(reports: DataFrame, limit: int, key: str = "hour") -> DataFrame:
    """Rows of the newest windows."""
    newest = reports.select(key).distinct().orderBy(F.desc(key)).limit(limit)
    return reports.join(newest, key, "left_semi")


def apply_retention(df: DataFrame, days: int, now: Column, tz: str = "UTC") -> DataFrame:
    """Rows of days whose start is not older than `days` before now.

    On a table partitioned by `dt` this prunes partitions.
    """
    cutoff = in_zone(now, tz) - F.make_dt_interval(F.lit(days))
    if "dt" in df.columns:
        return df.where(F.col("dt").cast("timestamp_ntz") >= cutoff)
    day = bucket_of(cutoff, "day")
    first = F.when(day < cutoff, day + F.expr("INTERVAL 1 DAY")).otherwise(day)
    # A plain comparison with a constant, so that it reaches the file scan.
    return df.where(F.col("ts") >= (first if tz.upper() == "UTC" else F.convert_timezone(F.lit(tz), F.lit("UTC"), first)))


def drop_expired_partitions(spark: SparkSession, root: str, days: int, now: str, tz: str = "UTC") -> list[str]:
    """Delete the folders of days older than the retention; returns the days deleted.

    Only folder names are read; the data is not.
    """
    cutoff = spark.range(1).select(
        (in_zone(F.lit(now).cast("timestamp_ntz"), tz) - F.make_dt_interval(F.lit(days))).cast("string").alias("c")
    ).first()["c"]
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = []
    for status in fs.listStatus(base):
        name = status.getPath().getName()
        if name.startswith("dt=") and name[3:] + " 00:00:00" < cutoff:
            fs.delete(status.getPath(), True)
            dropped.append(name[3:])
    return sorted(dropped)


def missing_rollups(events: DataFrame, stats: DataFrame, bucket: str = "minute", tz: str = "UTC") -> DataFrame:
    """Buckets that have events but no rollup."""
    seen = events.select(bucket_of(in_zone(F.col("ts"), tz), bucket).alias("bucket")).distinct()
    return seen.join(stats.select("bucket").distinct(), "bucket", "left_anti")


def missing_windows(reports: DataFrame, start: Column, end: Column, step: str = "hour", key: str = "window_start") -> DataFrame:
    """Hours or days from start up to (not including) end that have no report."""
    spark = reports.sparkSession
    every = F.expr(f"INTERVAL 1 {step.upper()}")
    first, last = bucket_of(start, step), bucket_of(end, step)
    wanted = spark.range(1).select(F.explode(F.sequence(first, last, every)).alias(key)).where(
        F.col(key) + every <= end
    )
    return wanted.join(reports.select(key).distinct(), key, "left_anti")


def read_version(spark: SparkSession, root: str) -> DataFrame | None:
    """Newest complete version of a table kept by `write_version`; None if there is none."""
    versions = _versions(spark, root)
    return spark.read.parquet(f"{root}/version={versions[-1]:09d}") if versions else None


def write_version(df: DataFrame, root: str, keep: int = 2) -> None:
    """Replace a table safely: a new version beside the old one, which may be what `df` reads.

    Spark's success mark makes a version visible, so a lost job leaves the old
    one in place; older versions than the newest `keep` are deleted.
    """
    spark = df.sparkSession
    versions = _versions(spark, root)
    df.write.mode("overwrite").parquet(f"{root}/version={(versions[-1] + 1 if versions else 0):09d}")
    for old in _versions(spark, root)[:-keep]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version={old:09d}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _versions(spark: SparkSession, root: str) -> list[int]:
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(base)]
    found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return sorted(v for v in found if _exists(spark, f"{root}/version={v:09d}/_SUCCESS"))


def export_table(df: DataFrame, fmt: str, path: str) -> None:
    """Write a result as csv (with header), json or parquet; times keep their microseconds."""
    writer = (
        df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    )
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"Unsupported format: {fmt}. Use csv, json or parquet.")


def page_table(
    df: DataFrame, select: str = "", filter: str = "", orderby: str = "", top: int = 100, skip: int = 0
) -> DataFrame:
    """A page of a table: predicate, order, projection, offset and limit.

    `filter` is an expression; the words `eq` and `ne` may stand for = and !=.
    """
    if filter:
        df = df.where(filter.replace(" eq ", " = ").replace(" ne ", " != "))
    if orderby:
        parts = orderby.split(" ")
        down = len(parts) > 1 and parts[1].lower() == "desc"
        df = df.orderBy(F.desc(parts[0]) if down else F.asc(parts[0]))
    if select:
        df = df.select(*[c.strip() for c in select.split(",")])
    return (df.offset(skip) if skip else df).limit(top)
