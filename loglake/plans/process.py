"""Checked queries: process mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ntz
from ..operators import process
from ..session import scratch, stored
from ..sources import views
from .oracle_views import LOGS, typed

START, END = "2024-01-05 00:00:00", "2024-01-20 00:00:00"


def _events(spark, d):
    return views.process_events(spark, d)


def i1_prepared_events(spark, d):
    out = process.process_events(_events(spark, d), views.logs(spark, d), "t1", ntz(START), ntz(END))
    return out.select("tenant_id", "case_id", "activity", "ts", "event_id", "resource")


def i1_events_from_logs(spark, d):
    none = _events(spark, d).where(F.col("tenant_id") == "nobody")
    out = process.process_events(none, views.logs(spark, d), "t1", ntz(START), ntz(END))
    return out.select(
        "case_id", "activity", "ts", "event_id", "resource",
        F.col("attributes")["severity"].alias("severity"), F.col("attributes")["message"].alias("message"),
    )


def _joined(c):
    return F.array_join(c, ">")


def i2_traces(spark, d):
    return process.traces(_events(spark, d)).withColumn("activities", _joined("activities"))


def i2_traces_in_parts(spark, d):
    """Users as cases, parts of 40 events: the way long cases go."""
    ev = _events(spark, d).withColumn("case_id", F.col("resource"))
    return process.traces(ev, part=40).select("case_id", "part", _joined("activities").alias("activities"), "event_count")


def i3_variants(spark, d):
    t = stored(process.traces(_events(spark, d)), "traces")
    return process.variants(t, 50).select(
        _joined("activities").alias("activities"), "case_count",
        F.round("avg_duration_ms", 3).alias("avg_duration_ms"),
        F.array_join("example_case_ids", ",").alias("example_case_ids"),
    )


def i4_activity_frequency(spark, d):
    return process.activity_frequency(_events(spark, d))


def i5_process_summary(spark, d):
    ev = _events(spark, d)
    return process.process_summary(ev, process.traces(ev))


def i6_export_xes(spark, d):
    path = scratch(spark, "xes")
    process.export_xes(_events(spark, d), path, "orders & events")
    lines = spark.read.text(path)
    v = F.col("value")
    return lines.where(v.startswith("<event>")).groupBy(
        F.regexp_extract("value", 'concept:name" value="([^"]*)"', 1).alias("activity"),
        F.regexp_extract("value", 'org:resource" value="([^"]*)"', 1).alias("resource"),
    ).agg(F.count(F.lit(1)).alias("events"), F.min(F.regexp_extract("value", 'time:timestamp" value="([^"]*)"', 1)).alias("first"))


def i7_directly_follows(spark, d):
    return process.directly_follows(_events(spark, d)).withColumn("mean_gap_s", F.round("mean_gap_s", 3))


def i7_directly_follows_in_parts(spark, d):
    ev = _events(spark, d).withColumn("case_id", F.col("resource"))
    return process.directly_follows(ev, part=40).withColumn("mean_gap_s", F.round("mean_gap_s", 3))


QUERIES = {f.__name__: f for f in (
    i1_prepared_events, i1_events_from_logs, i2_traces, i2_traces_in_parts, i3_variants,
    i4_activity_frequency, i5_process_summary, i6_export_xes, i7_directly_follows,
    i7_directly_follows_in_parts,
)}

PE = """
pe AS (SELECT concat('t', user_id % 4) AS tenant_id, concat(user_id, '-', cast(ts AS DATE)) AS case_id, event_type AS activity,
       ts, event_id, concat('host-', user_id % 20) AS resource FROM events)"""
_RANGE = f"tenant_id = 't1' AND ts >= TIMESTAMP '{START}' AND ts <= TIMESTAMP '{END}'"
TR = """
tr AS (SELECT case_id, string_agg(activity, '>' ORDER BY ts, event_id) AS activities, count(*) AS event_count,
       min(ts) AS start_ts, max(ts) AS end_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS duration_ms FROM pe GROUP BY case_id)"""


def _follows(case):
    return f"""WITH {PE}, n AS (SELECT activity, ts, lead(activity) OVER w AS na, lead(ts) OVER w AS nt FROM pe
        WINDOW w AS (PARTITION BY {case} ORDER BY ts, event_id))
      SELECT activity AS from_activity, na AS to_activity, count(*) AS count,
        round(avg((epoch_us(nt) - epoch_us(ts)) / 1e6), 3) AS mean_gap_s FROM n WHERE na IS NOT NULL GROUP BY 1, 2"""


ORACLES = {
    "i1_prepared_events": f"WITH {PE} SELECT * FROM pe WHERE {_RANGE}",
    "i1_events_from_logs": f"""WITH {LOGS} SELECT regexp_extract(message, 'request_id=([a-z0-9]+)', 1) AS case_id, app AS activity,
        ts, event_id, host AS resource, severity, left(message, 200) AS message FROM logs WHERE {_RANGE}""",
    "i2_traces": f"WITH {PE}, {TR} SELECT *, 0 AS part FROM tr",
    "i2_traces_in_parts": f"""WITH {PE}, o AS (SELECT resource AS case_id, activity,
          row_number() OVER (PARTITION BY resource ORDER BY ts, event_id) - 1 AS seq, count(*) OVER (PARTITION BY resource) AS n FROM pe)
        SELECT case_id, seq // 40 AS part, string_agg(activity, '>' ORDER BY seq) AS activities, any_value(n) AS event_count
        FROM o GROUP BY 1, 2""",
    "i3_variants": f"""WITH {PE}, {TR}, r AS (SELECT *, row_number() OVER (PARTITION BY activities ORDER BY case_id) AS rn FROM tr)
        SELECT activities, count(*) AS case_count, round(avg(duration_ms), 3) AS avg_duration_ms,
          string_agg(case_id, ',' ORDER BY rn) FILTER (rn <= 5) AS example_case_ids FROM r
        GROUP BY activities ORDER BY case_count DESC, min(case_id) LIMIT 50""",
    "i4_activity_frequency": f"WITH {PE} SELECT activity, count(*) AS count FROM pe GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "i5_process_summary": f"""WITH {PE}, {TR} SELECT count(*) AS total_cases, cast(sum(event_count) AS BIGINT) AS total_events,
        count(DISTINCT activities) AS variant_count, (SELECT count(DISTINCT activity) FROM pe) AS unique_activities FROM tr""",
    "i6_export_xes": f"""WITH {PE} SELECT activity, resource, count(*) AS events,
        min(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')) AS first FROM pe GROUP BY 1, 2""",
    "i7_directly_follows": _follows("case_id"),
    "i7_directly_follows_in_parts": _follows("resource"),
}

# Column types as Spark has them.
for _name, _types in {
    "i2_traces": {'part': 'BIGINT'},
}.items():
    ORACLES[_name] = typed(ORACLES[_name], **_types)
