"""Checked queries: stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ntz
from ..operators import dedupe, parse, rollup, usage
from ..session import scratch
from ..sources import manifest, storage, tables, views
from .oracle_views import LOGS, PATTERNS, typed
from .parsing import patterned
from .rollups import HSTATS, MSTATS, hours, minutes

NOW = "2024-01-31 00:00:00"


def raw_folder(spark, d):
    """The raw lines of the log view as files, one folder per transport."""
    path = scratch(spark, "raw")
    raw = views.with_raw(views.logs(spark, d))
    raw.select(F.col("raw").alias("value"), "transport").write.partitionBy("transport").text(path)
    return path


def a1_read_raw_lines(spark, d):
    lines = storage.read_raw_lines(spark, raw_folder(spark, d), sender="10.9.9.9")
    return parse.parse_logs(lines, year=2024, now=NOW).select("ts", "host", "app", "severity", "facility", "message", "transport")


def bucket_folder(spark, d):
    """De-duplicated events as JSON lines, one folder per day bucket."""
    path = scratch(spark, "buckets")
    first = dedupe.dedupe_bucket(patterned(spark, d), "day")
    stored = first.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "host", "app", "severity", "facility",
        "message", "transport", "pattern_id", "occurrences", F.col("bucket").alias("_b"),
    )
    storage.write_buckets(stored, path, F.col("_b"))
    return path


def a2_read_buckets(spark, d):
    df = storage.read_buckets(
        spark, bucket_folder(spark, d), ntz("2024-01-10 00:00:00"), ntz("2024-01-12 00:00:00")
    )
    return df.select("bucket", "pattern_id", "host", "occurrences", "timestamp")


def a3_bucket_time(spark, d):
    df = storage.bucket_time_from_path(spark.read.option("recursiveFileLookup", "true").text(bucket_folder(spark, d)))
    return df.groupBy("bucket").agg(F.count(F.lit(1)).alias("lines"))


def a4_write_events(spark, d):
    root = scratch(spark, "events")
    storage.write_events(views.logs(spark, d), root)
    return spark.read.parquet(root).select("event_id", "host", "dt", "hr")


def a5_write_report(spark, d):
    root = scratch(spark, "reports")
    h = hours(spark, d).where("dim IN ('total', 'unique')")
    storage.write_report(h.where(F.col("hour") < ntz("2024-01-20 00:00:00")), root)
    storage.write_report(h.withColumn("cnt", F.col("cnt") + 1000), root)
    return spark.read.parquet(root).select("hour", "dim", "cnt")


def a6_latest_reports(spark, d):
    return storage.latest_reports(hours(spark, d), 5)


def a7_apply_retention(spark, d):
    return storage.apply_retention(views.logs(spark, d), 7, ntz("2024-01-30 12:00:00"), "Asia/Tehran").select("event_id", "ts")


def a7_drop_expired(spark, d):
    root = scratch(spark, "events")
    storage.with_partitions(views.logs(spark, d)).write.partitionBy("dt").parquet(root)
    storage.drop_expired_partitions(spark, root, 7, "2024-01-30 12:00:00")
    return spark.read.parquet(root).groupBy("dt").agg(F.count(F.lit(1)).alias("events"))


def a8_missing_rollups(spark, d):
    stats = minutes(spark, d).where(F.minute("bucket") % 7 != 0)
    return storage.missing_rollups(views.logs(spark, d), stats)


def _manifest(spark, d):
    """Stored logs and a manifest that knows the files of the first part of the month."""
    root, path = scratch(spark, "events"), scratch(spark, "manifest")
    logs = views.logs(spark, d)
    cut = ntz("2024-01-21 00:00:00")
    storage.write_events(logs.where(F.col("ts") < cut), root)
    manifest.update(spark.read.parquet(root), path)
    storage.write_events(logs.where(F.col("ts") >= cut), root)
    return manifest.facts(spark.read.parquet(root), path)


def a8_missing_rollups_manifest(spark, d):
    stats = minutes(spark, d).where(F.minute("bucket") % 7 != 0)
    return manifest.missing_rollups(_manifest(spark, d), stats)


def d14_hourly_counts_manifest(spark, d):
    return manifest.hourly_counts(_manifest(spark, d))


def g2_table_size_manifest(spark, d):
    return manifest.table_size(_manifest(spark, d)).select("row_count", (F.col("size_bytes") > 0).alias("has_bytes"))


def g3_table_stats_manifest(spark, d):
    return manifest.table_stats(_manifest(spark, d))


def a9_missing_hours(spark, d):
    ev = views.logs(spark, d).where("severity = 'crit'")
    reports = ev.select(F.date_trunc("hour", "ts").alias("window_start"))
    return storage.missing_windows(reports, ntz("2024-01-29 13:20:00"), ntz("2024-01-30 13:20:00"))


def a9_missing_days(spark, d):
    ev = views.logs(spark, d).where("severity = 'crit' AND event_id % 40 = 1")
    reports = ev.select(F.date_trunc("day", "ts").alias("window_start"))
    return storage.missing_windows(reports, ntz("2024-01-01 00:00:00"), ntz("2024-01-31 00:00:00"), "day")


def _export(fmt):
    def query(spark, d):
        path = scratch(spark, "export")
        storage.export_table(views.logs(spark, d).select("event_id", "ts", "host", "severity", "message"), fmt, path)
        reader = spark.read.schema("event_id long, ts timestamp_ntz, host string, severity string, message string")
        return (reader.option("header", "true") if fmt == "csv" else reader).format(fmt).load(path)
    query.__name__ = f"a10_export_{fmt}"
    return query


def a11_page_table(spark, d):
    return storage.page_table(
        views.table(spark, d, "orders"), "o_orderkey, o_totalprice, o_orderdate",
        "o_orderstatus eq 'P' and o_totalprice > 1000", "o_orderkey desc", 25, 50,
    )


def k6_bucket_usage(spark, d):
    files = storage.bucket_files(spark, bucket_folder(spark, d)).groupBy("bucket").agg(
        F.sum("size").alias("size"), F.sum("lines").alias("lines")
    )
    totals = rollup.minute_stats(patterned(spark, d), bucket="day").where(
        "dim = 'total' AND day(bucket) % 2 = 0"
    ).select("bucket", F.col("cnt").alias("total"))
    return usage.bucket_usage(files, totals, "day").select("day", "events", (F.col("bytes") > 0).alias("has_bytes"))


def a9_roll_forward(spark, d):
    """Two runs over ranges that overlap: each hour and day is counted once."""
    root, logs = scratch(spark, "tables"), patterned(spark, d)
    tables.roll_forward(logs, root, ntz("2024-01-05 00:00:00"), ntz("2024-01-07 12:00:00"))
    tables.roll_forward(logs, root, ntz("2024-01-06 00:00:00"), ntz("2024-01-09 00:00:00"))
    read = lambda name, key: spark.read.parquet(f"{root}/{name}").select(
        F.lit(name).alias("name"), F.col(key).alias("window"), "dim", "key", "cnt")
    return read("hours", "hour").unionByName(read("days", "day"))


def e2_stored_issues(spark, d):
    """The stored issue table after six days, one at a time."""
    root, logs = scratch(spark, "issues"), patterned(spark, d)
    for day in range(10, 16):
        out = tables.roll_issues(logs, root, ntz(f"2024-01-{day} 00:00:00"))
    return out


QUERIES = {f.__name__: f for f in (
    a1_read_raw_lines, a2_read_buckets, a3_bucket_time, a4_write_events, a5_write_report, a6_latest_reports,
    a7_apply_retention, a7_drop_expired, a8_missing_rollups, a8_missing_rollups_manifest, d14_hourly_counts_manifest,
    g2_table_size_manifest, g3_table_stats_manifest, a9_missing_hours, a9_missing_days,
    *[_export(f) for f in ("csv", "json", "parquet")], a11_page_table, k6_bucket_usage,
    a9_roll_forward, e2_stored_issues,
)}

_FIRST = PATTERNS + """,
fi AS (SELECT *, date_trunc('day', ts) AS bucket, count(*) OVER (PARTITION BY date_trunc('day', ts), pattern_id) AS occurrences
  FROM pat QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts), pattern_id ORDER BY ts, event_id) = 1)"""
_EXPORTED = f"WITH {LOGS} SELECT event_id, ts, host, severity, message FROM logs"

_ISSUE_DAYS = """d AS (SELECT date_trunc('day', ts) AS day, pattern_id, arg_min(severity, {'t': ts, 'e': event_id}) AS severity,
    arg_min(message, {'t': ts, 'e': event_id}) AS sample_message FROM pat
  WHERE severity IN ('err', 'crit') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-16' GROUP BY ALL)"""

ORACLES = {
    "a9_roll_forward": f"""WITH {HSTATS}, h AS (SELECT * FROM hstats WHERE hour >= TIMESTAMP '2024-01-05' AND hour < TIMESTAMP '2024-01-09'),
        ds AS (SELECT date_trunc('day', bucket) AS day, dim, key, cast(sum(cnt) AS BIGINT) AS cnt FROM mstats
          WHERE dim IN ('severity', 'host', 'app', 'total', 'unique') AND bucket >= TIMESTAMP '2024-01-05' AND bucket < TIMESTAMP '2024-01-09' GROUP BY ALL),
        dr AS (SELECT *, row_number() OVER (PARTITION BY day, dim ORDER BY cnt DESC, key) AS r FROM ds)
        SELECT 'hours' AS name, hour AS "window", dim, key, cnt FROM h
        UNION ALL SELECT 'days', day, dim, key, cnt FROM dr WHERE r <= 10 OR dim = 'severity'""",
    "e2_stored_issues": f"""WITH {PATTERNS}, {_ISSUE_DAYS}
        SELECT pattern_id, min(day) AS first_seen, max(day) AS last_seen,
          CASE WHEN max(day) = TIMESTAMP '2024-01-15' THEN 'active' ELSE 'resolved' END AS status,
          arg_max(severity, day) AS severity, arg_max(sample_message, day) AS sample_message FROM d GROUP BY pattern_id""",
    "a1_read_raw_lines": f"WITH {LOGS} SELECT date_trunc('second', ts) AS ts, host, app, severity, facility, message, transport FROM logs",
    "a2_read_buckets": f"""WITH {_FIRST} SELECT bucket, pattern_id, host, occurrences, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp
        FROM fi WHERE bucket >= TIMESTAMP '2024-01-10' AND bucket < TIMESTAMP '2024-01-12'""",
    "a3_bucket_time": f"WITH {_FIRST} SELECT bucket, count(*) AS lines FROM fi GROUP BY 1",
    "a4_write_events": f"""WITH {LOGS} SELECT event_id, host, cast(ts AS DATE) AS dt, cast(hour(ts) AS INTEGER) AS hr FROM logs""",
    "a5_write_report": f"""WITH {HSTATS} SELECT hour, dim, CASE WHEN hour < TIMESTAMP '2024-01-20' THEN cnt ELSE cnt + 1000 END AS cnt
        FROM hstats WHERE dim IN ('total', 'unique')""",
    "a6_latest_reports": f"""WITH {HSTATS} SELECT hour, dim, key, cnt, rank FROM hstats
        WHERE hour IN (SELECT DISTINCT hour FROM hstats ORDER BY hour DESC LIMIT 5)""",
    "a7_apply_retention": f"""WITH {LOGS} SELECT event_id, ts FROM logs
        WHERE date_trunc('day', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tehran')
          >= (TIMESTAMP '2024-01-30 12:00:00' AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tehran' - INTERVAL 7 DAY""",
    "a7_drop_expired": """SELECT cast(ts AS DATE) AS dt, count(*) AS events FROM events
        WHERE cast(ts AS DATE) >= DATE '2024-01-24' GROUP BY 1""",
    "a8_missing_rollups": "SELECT DISTINCT date_trunc('minute', ts) AS bucket FROM events WHERE minute(ts) % 7 = 0",
    "d14_hourly_counts_manifest": "SELECT date_trunc('hour', ts) AS hour, count(*) AS event_count FROM events GROUP BY 1",
    "g2_table_size_manifest": "SELECT count(*) AS row_count, true AS has_bytes FROM events",
    "g3_table_stats_manifest": f"""WITH {LOGS} SELECT count(*) AS row_count, min(ts) AS min_ts, max(ts) AS max_ts,
        count(DISTINCT tenant_id) AS tenant_count FROM logs""",
    "a9_missing_hours": f"""WITH {LOGS} SELECT h AS window_start FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-29 13:00:00',
          TIMESTAMP '2024-01-30 12:00:00', INTERVAL 1 HOUR)) AS h)
        WHERE h NOT IN (SELECT date_trunc('hour', ts) FROM logs WHERE severity = 'crit')""",
    "a9_missing_days": f"""WITH {LOGS} SELECT h AS window_start FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01',
          TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS h)
        WHERE h NOT IN (SELECT date_trunc('day', ts) FROM logs WHERE severity = 'crit' AND event_id % 40 = 1)""",
    **{f"a10_export_{f}": _EXPORTED for f in ("csv", "json", "parquet")},
    "a11_page_table": """SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 1000
        ORDER BY o_orderkey DESC LIMIT 25 OFFSET 50""",
    "k6_bucket_usage": f"""WITH {_FIRST}, b AS (SELECT bucket, count(*) AS lines, cast(sum(occurrences) AS BIGINT) AS total FROM fi GROUP BY 1)
        SELECT bucket AS day, cast(sum(CASE WHEN day(bucket) % 2 = 0 THEN total ELSE lines END) AS BIGINT) AS events,
          true AS has_bytes FROM b GROUP BY 1""",
}

ORACLES["a8_missing_rollups_manifest"] = ORACLES["a8_missing_rollups"]

# Column types as Spark has them.
for _name, _types in {
    "a6_latest_reports": {'rank': 'INTEGER'},
}.items():
    ORACLES[_name] = typed(ORACLES[_name], **_types)
