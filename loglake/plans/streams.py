"""Checked queries: streaming jobs, each run once over the events file.

Results are read back from the sinks.  Windows that the watermark has not
closed yet are not in the result; the SQL leaves them out as well.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as usage_ops
from ..operators.parse import with_pattern_id
from ..schemas import DAILY_ERRORS
from ..session import scratch
from ..sources import storage, views
from ..streaming import admission, jobs, samples
from .oracle_views import LOGS, PATTERNS, typed
from .reports import ALERT_STATS, APP_ERRORS, WIDE
from .rollups import HH, HSTATS
from .storage import raw_folder
from .usage import ORACLES as USAGE
from .usage import PJ, _COLOUR, _plans, _projects


def log_stream(spark, d):
    """The log view as a stream over the events file, with pattern ids."""
    schema = views.table(spark, d, "events").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return jobs.event_time(with_pattern_id(views.logs_from_events(ev)))


def _done(query):
    query.awaitTermination()
    return query


def _sink(spark, df, **kw):
    path = scratch(spark, "stream")
    _done(jobs.start(df, path, scratch(spark, "checkpoint"), **kw))
    return spark.read.parquet(path)


def _batches(spark, starter, *args, **kw):
    path = scratch(spark, "stream")
    _done(starter(*args[:1], path, scratch(spark, "checkpoint"), *args[1:], **kw))
    return path


def _in_parts(spark, d, starter, *args, patterns=True, **kw):
    """Events arrive in three parts by time; after each the job catches up, stops, and starts again from its checkpoint.

    A job that knows nothing of patterns can go without their ids.
    """
    events = views.table(spark, d, "events")
    arrived, path, checkpoint = (scratch(spark, name) for name in ("arrived", "stream", "checkpoint"))
    cuts = [F.lit(c).cast("timestamp_ntz") for c in ("2024-01-10 13:30:00", "2024-01-20 05:45:00")]
    parts = [F.col("ts") < cuts[0], (F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1]), F.col("ts") >= cuts[1]]
    for part in parts:
        events.where(part).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(events.schema).parquet(arrived)
        logs = views.logs_from_events(stream)
        logs = jobs.event_time(with_pattern_id(logs) if patterns else logs)
        _done(starter(logs, path, checkpoint, *args, **kw))
    return path


def _plain(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def n1_stream_parse(spark, d):
    lines = storage.read_raw_lines(spark, raw_folder(spark, d), stream=True)
    return _sink(spark, jobs.stream_parse(lines, year=2024, now="2024-01-31 00:00:00")).select(
        "ts", "host", "app", "severity", "facility", "message", "pattern_id"
    )


def n2_stream_dedupe(spark, d):
    out = _sink(spark, jobs.stream_dedupe(log_stream(spark, d), "1 hour"))
    return out.select(F.col("bucket.start").cast("timestamp_ntz").alias("bucket"), "pattern_id")


def n2_stream_dedupe_counted(spark, d):
    out = _sink(spark, jobs.stream_dedupe_counted(log_stream(spark, d), "1 hour", "1 minute"))
    return _plain(out, "bucket", "ts").select("bucket", "pattern_id", "event_id", "ts", "host", "occurrences")


def n3_stream_minute_stats(spark, d):
    path = _batches(spark, jobs.start_minute_stats, log_stream(spark, d))
    return _plain(spark.read.parquet(path), "bucket").select("bucket", "dim", "key", "cnt")


def n4_stream_hourly_stats(spark, d):
    path = _batches(spark, jobs.start_hourly_stats, log_stream(spark, d))
    return _plain(spark.read.parquet(path), "hour").select("hour", "dim", "key", "cnt", "rank")


def n5_stream_sample(spark, d):
    path = _batches(spark, jobs.stream_sample, log_stream(spark, d), n=5, seed=7)
    batches = spark.read.parquet(path)
    last = batches.agg(F.max("batch").alias("batch"))
    return batches.join(last, "batch", "left_semi").select("host", "severity", "app", "event_id")


def n6_stream_issue_state(spark, d):
    """Two jobs: pattern days to a table, their lifecycle from it."""
    days = scratch(spark, "days")
    _done(jobs.start(jobs.error_pattern_days(log_stream(spark, d), DAILY_ERRORS), days, scratch(spark, "checkpoint")))
    stream = spark.readStream.schema(spark.read.parquet(days).schema).parquet(days)
    out = _sink(spark, jobs.stream_issue_state(stream))
    return _plain(out, "day")


def n7_stream_usage_quota(spark, d):
    path = _batches(spark, jobs.start_usage_quota, log_stream(spark, d), _projects(spark, d), _plans(spark))
    rows = spark.read.parquet(f"{path}/quota")
    newest = rows.groupBy("project_id", "date").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["project_id", "date", "batch"], "left_semi").select(
        "project_id", "date", "quota_status", "usage_count", "limit", F.round("usage_percent", 4).alias("usage_percent"), "exceeded"
    )


def n5_stream_sample_state(spark, d):
    """The sample from the marks in the state store; the job stops and goes on between the parts."""
    path = _in_parts(spark, d, samples.start_sample, n=5, seed=7, partitions=8)
    return samples.current_sample(spark, path, n=5, seed=7).select("host", "severity", "app", "event_id")


def n7_stream_admission(spark, d):
    """Quotas enforced on events that come in three parts, cut within days."""
    limits = _projects(spark, d).join(_plans(spark), "plan_id").select(
        "project_id", F.coalesce("custom_quota_per_day", "events_per_day_limit").alias("limit")
    )
    path = _in_parts(spark, d, admission.start_admission, limits, patterns=False)
    return _plain(spark.read.parquet(f"{path}/events"), "ts").select("event_id", "ts", "tenant_id", "admitted")


def n8_stream_alerts(spark, d):
    path = _batches(spark, jobs.start_alerts, log_stream(spark, d), 5)
    return _plain(spark.read.parquet(path), "hour").select("hour", "total_events", "total_errors", "body")


def n8_stream_text_alerts(spark, d):
    path = _batches(spark, jobs.start_text_alerts, log_stream(spark, d), 5)
    return spark.read.parquet(path).select("hour", "total_events", "total_errors", "body")


def n8_stream_anomaly_alerts(spark, d):
    """Hours with an anomaly text, made from their own highlights."""
    def texts(hours, highlights):
        return hours.where("dim = 'total'").select("hour", F.when(
            F.hour("hour") == 3, "  \n Spike of logins seen \nmore"
        ).when(F.hour("hour") == 4, "No anomalies detected in this hour").alias("anomalies"))

    path = _batches(spark, jobs.start_text_alerts, log_stream(spark, d), None, anomalies=texts)
    return spark.read.parquet(path).select("hour", "total_events", "total_errors", "body")


def f4_tail_stream(spark, d):
    root = scratch(spark, "ndjson")
    logs = views.logs(spark, d)
    lines = F.when(F.col("event_id") % 10 == 0, F.lit('{"broken": ')).otherwise(
        F.to_json(F.struct(F.col("ts").cast("string").alias("timestamp"), "host", "app", "severity", "facility", "message", "transport"))
    )
    logs.select(lines.alias("value")).write.text(root)
    return _sink(spark, jobs.tail_stream(spark, root)).select("host", "app", "severity", "message")


def a12_forward_events(spark, d):
    out = scratch(spark, "forward")
    _done(jobs.start_forward_files(log_stream(spark, d), out, scratch(spark, "checkpoint")))
    return spark.read.schema("event_id long, host string, pattern_id string").json(out)


def a12_forward_failing_sink(spark, d):
    """Two writers of which one always fails: its rows come from the dead letters."""
    good, dead = scratch(spark, "forward"), scratch(spark, "dead")

    def fails(batch):
        raise OSError("receiver is down")

    _done(jobs.forward_events(
        log_stream(spark, d), {"good": lambda b: b.write.mode("append").json(good), "bad": fails},
        scratch(spark, "checkpoint"), dead,
    ))
    sent = spark.read.schema("event_id long, host string, pattern_id string").json(good).withColumn("sink", F.lit("good"))
    return sent.unionByName(spark.read.parquet(dead).select("event_id", "host", "pattern_id", "sink"))


QUERIES = {f.__name__: f for f in (
    n1_stream_parse, n2_stream_dedupe, n2_stream_dedupe_counted, n3_stream_minute_stats, n4_stream_hourly_stats,
    n5_stream_sample, n5_stream_sample_state, n6_stream_issue_state, n7_stream_usage_quota, n7_stream_admission, n8_stream_alerts,
    n8_stream_text_alerts, n8_stream_anomaly_alerts, f4_tail_stream, a12_forward_events, a12_forward_failing_sink,
)}


def _closed(start, length, delay):
    return f"{start} + INTERVAL {length} <= (SELECT max(ts) FROM events) - INTERVAL {delay}"


def _stats(unit):
    return PATTERNS + f""",
facts AS (SELECT date_trunc('{unit}', ts) AS bucket, pattern_id, severity, host, app, count(*) AS n FROM pat GROUP BY ALL),
st AS (SELECT bucket, 'severity' AS dim, severity AS key, cast(sum(n) AS BIGINT) AS cnt FROM facts GROUP BY ALL
  UNION ALL SELECT bucket, 'host', host, cast(sum(n) AS BIGINT) FROM facts GROUP BY ALL
  UNION ALL SELECT bucket, 'app', app, cast(sum(n) AS BIGINT) FROM facts GROUP BY ALL
  UNION ALL SELECT bucket, 'host_app', concat(host, '/', app), cast(sum(n) AS BIGINT) FROM facts GROUP BY ALL
  UNION ALL SELECT bucket, 'pattern', pattern_id, cast(sum(n) AS BIGINT) FROM facts GROUP BY ALL
  UNION ALL SELECT bucket, 'total', '', cast(sum(n) AS BIGINT) FROM facts GROUP BY ALL
  UNION ALL SELECT bucket, 'unique', '', count(DISTINCT pattern_id) FROM facts GROUP BY ALL)"""


ORACLES = {
    "n1_stream_parse": f"WITH {PATTERNS} SELECT date_trunc('second', ts) AS ts, host, app, severity, facility, message, pattern_id FROM pat",
    "n2_stream_dedupe": f"WITH {PATTERNS} SELECT DISTINCT date_trunc('hour', ts) AS bucket, pattern_id FROM pat",
    "n2_stream_dedupe_counted": f"""WITH {PATTERNS}, r AS (SELECT date_trunc('hour', ts) AS bucket, pattern_id, event_id, ts, host,
          count(*) OVER (PARTITION BY date_trunc('hour', ts), pattern_id) AS occurrences,
          row_number() OVER (PARTITION BY date_trunc('hour', ts), pattern_id ORDER BY ts, event_id) AS rn FROM pat)
        SELECT bucket, pattern_id, event_id, ts, host, occurrences FROM r WHERE rn = 1 AND {_closed('bucket', '1 HOUR', '1 MINUTE')}""",
    "n3_stream_minute_stats": f"WITH {_stats('minute')} SELECT * FROM st WHERE {_closed('bucket', '1 MINUTE', '1 MINUTE')}",
    "n4_stream_hourly_stats": f"""WITH {_stats('hour')} SELECT bucket AS hour, dim, key, cnt,
        row_number() OVER (PARTITION BY bucket, dim ORDER BY cnt DESC, key) AS rank FROM st
        WHERE dim <> 'pattern' AND {_closed('bucket', '1 HOUR', '10 MINUTE')} QUALIFY rank <= 5 OR dim = 'severity'""",
    "n5_stream_sample": f"""WITH {LOGS} SELECT host, severity, app, event_id FROM logs
        QUALIFY row_number() OVER (PARTITION BY host, severity, app ORDER BY md5(concat(event_id, '|7')), event_id) <= 5""",
    "n6_stream_issue_state": f"""WITH {PATTERNS},
        days AS (SELECT date_trunc('day', ts) AS day, pattern_id, max(severity) AS severity FROM pat
          WHERE severity IN ('emerg', 'alert', 'crit', 'err') AND {_closed("date_trunc('day', ts)", '1 DAY', '1 HOUR')} GROUP BY 1, 2),
        w AS (SELECT *, lag(day) OVER p AS pd, lead(day) OVER p AS nd, (SELECT max(day) FROM days) AS md FROM days
          WINDOW p AS (PARTITION BY pattern_id ORDER BY day))
        SELECT pattern_id, day, CASE WHEN pd IS NULL THEN 'new' WHEN pd = day - INTERVAL 1 DAY THEN 'ongoing' ELSE 'reopened' END AS state,
          severity FROM w
        UNION ALL SELECT pattern_id, day + INTERVAL 1 DAY, 'resolved', severity FROM w
        WHERE nd > day + INTERVAL 1 DAY OR (nd IS NULL AND day + INTERVAL 2 DAY < md - INTERVAL 1 DAY)""",
    "n7_stream_usage_quota": f"""WITH {PJ}, dd AS (SELECT project_id, date_trunc('day', timestamp_hour) AS date,
          cast(sum(event_count) AS BIGINT) AS used FROM hu WHERE {_closed('timestamp_hour', '1 HOUR', '10 MINUTE')} GROUP BY 1, 2),
        q AS (SELECT project_id, date, CASE WHEN status = 'active' THEN used ELSE 0 END AS u,
          CASE WHEN status = 'active' THEN lim ELSE 0 END AS l, status = 'active' AS act FROM dd JOIN pp USING (project_id)),
        r AS (SELECT *, CASE WHEN act THEN u / l * 100 ELSE 100.0 END AS p FROM q)
        SELECT project_id, date, {_COLOUR.format(p='p')} AS quota_status, u AS usage_count, l AS "limit",
          round(p, 4) AS usage_percent, p >= 100 AS exceeded FROM r""",
    "n8_stream_alerts": f"""WITH {HSTATS}, {WIDE} SELECT hour, total_events, total_errors,
        concat_ws(chr(10) || chr(10), concat('High Error Count: ', total_errors, ' errors'), {ALERT_STATS}) AS body
        FROM wide WHERE total_errors >= 5 AND {_closed('hour', '1 HOUR', '10 MINUTE')}""",
    "n8_stream_text_alerts": f"""WITH {HSTATS}{HH}, {WIDE}, {APP_ERRORS}
        SELECT hour, total_events, total_errors, concat_ws(chr(10) || chr(10), concat('High Error Count: ', total_errors, ' errors'),
          app_errors, {ALERT_STATS}) AS body FROM wide LEFT JOIN ae USING (hour)
        WHERE total_errors >= 5 AND {_closed('hour', '1 HOUR', '10 MINUTE')}""",
    "n8_stream_anomaly_alerts": f"""WITH {HSTATS}{HH}, {WIDE}, {APP_ERRORS}
        SELECT hour, total_events, total_errors, concat_ws(chr(10) || chr(10), 'Anomaly: Spike of logins seen', app_errors, {ALERT_STATS}) AS body
        FROM wide LEFT JOIN ae USING (hour) WHERE hour(hour) = 3 AND {_closed('hour', '1 HOUR', '10 MINUTE')}""",
    "f4_tail_stream": f"WITH {LOGS} SELECT host, app, severity, message FROM logs WHERE event_id % 10 <> 0",
    "a12_forward_events": f"WITH {PATTERNS} SELECT event_id, host, pattern_id FROM pat",
    "a12_forward_failing_sink": f"WITH {PATTERNS} SELECT event_id, host, pattern_id, unnest(['good', 'bad']) AS sink FROM pat",
}

ORACLES["n5_stream_sample_state"] = ORACLES["n5_stream_sample"]
ORACLES["n7_stream_admission"] = USAGE["k10_admit_events"]

# Column types as Spark has them.
for _name, _types in {
    "n4_stream_hourly_stats": {'rank': 'INTEGER'},
}.items():
    ORACLES[_name] = typed(ORACLES[_name], **_types)
