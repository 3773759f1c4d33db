"""Checked queries: minute, hour and day rollups, highlights, dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ntz
from ..operators import dedupe, rollup
from ..schemas import PRI_SEVERITIES
from ..session import stored
from ..sources import views
from .oracle_views import LOGS, PATTERNS, typed
from .parsing import patterned

NOW = "2024-01-31 00:00:00"


def minutes(spark, d):
    return rollup.minute_stats(patterned(spark, d))


def hours(spark, d):
    """The hourly table, written once since dashboards read it several times."""
    return stored(rollup.hourly_stats(minutes(spark, d)), "hourly_stats")


def highlights(spark, d, k=15):
    return stored(rollup.hourly_highlights(rollup.minute_highlights(patterned(spark, d)), k), "highlights")


def pairs(col):
    """Array of (key, cnt) as `key:cnt,...` text."""
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["key"], s["cnt"].cast("string"))), ",")


def d1_minute_stats(spark, d):
    return minutes(spark, d)


def d2_pattern_sources(spark, d):
    return rollup.pattern_sources(rollup.event_facts(patterned(spark, d), "hour"))


def d3_minute_highlights(spark, d):
    h = rollup.minute_highlights(patterned(spark, d), k=10, bucket="hour")
    return h.withColumn("source_hosts", pairs("source_hosts")).withColumn("source_apps", pairs("source_apps"))


def d4_rebuild_stats(spark, d):
    stored = dedupe.dedupe_bucket(patterned(spark, d), "hour").select(
        "bucket", "severity", "host", "app", "pattern_id",
        F.when(F.col("event_id") % 5 != 0, F.col("occurrences")).alias("occurrences"),
    )
    return rollup.rebuild_minute_stats(stored)


def d5_hourly_stats(spark, d):
    return hours(spark, d)


def d6_minute_rollup(spark, d):
    return rollup.minute_rollup(minutes(spark, d))


def d7_hourly_highlights(spark, d):
    return highlights(spark, d).withColumn("source_hosts", pairs("source_hosts")).withColumn(
        "source_apps", pairs("source_apps")
    )


def d8_analysis_levels(spark, d):
    return rollup.filter_analysis_levels(highlights(spark, d, None), ["ERROR", "CRITICAL"], 5).select(
        "hour", "level_rank", "rank", "pattern_id", "severity", "occurrences"
    )


def health(spark, d):
    return rollup.service_health(highlights(spark, d, None))


def d9_service_health(spark, d):
    return health(spark, d).select(
        "hour", "app", "anomalies",
        F.array_join(F.transform(F.map_entries("severities"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("severities"),
        F.array_join(F.transform("top_issues", lambda i: F.concat_ws("|", i["severity"], i["count"].cast("string"), i["message"])), ";").alias("top_issues"),
    )


def d10_daily_exact(spark, d):
    return rollup.daily_stats(minutes(spark, d))


def d10_daily_of_top_lists(spark, d):
    return rollup.daily_stats(hours(spark, d), exact=False)


def _texts(df):
    return df.withColumn(
        "severity_breakdown",
        F.array_join(F.transform("severity_breakdown", lambda s: F.concat_ws(":", s["severity"], s["count"].cast("string"))), ","),
    ).withColumn(
        "highlights",
        F.array_join(F.transform("highlights", lambda h: F.concat_ws(
            "|", h["severity"], h["host"], h["app"], h["occurrences"].cast("string"), h["message"])), ";"),
    )


def d11_notable_incidents(spark, d):
    return _texts(rollup.notable_incidents(hours(spark, d), highlights(spark, d)))


def d12_daily_highlights(spark, d):
    return rollup.daily_highlights(highlights(spark, d))


def d12_condensed(spark, d):
    return rollup.daily_highlights(highlights(spark, d), condensed=True)


def d13_error_insights(spark, d):
    out = _texts(rollup.error_insights(hours(spark, d), highlights(spark, d)))
    for c in ("top_hosts", "top_apps"):
        out = out.withColumn(c, F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["key"], s["count"].cast("string"))), ","))
    return out


def d14_hourly_counts(spark, d):
    return rollup.hourly_counts(hours(spark, d), 7, ntz(NOW))


def d15_kpis(spark, d):
    return rollup.kpis_24h(hours(spark, d))


def d16_top_severities(spark, d):
    return rollup.top_share(hours(spark, d), "severity", 6)


def d16_top_hosts(spark, d):
    return rollup.top_share(hours(spark, d), "host", 6)


def d16_top_apps(spark, d):
    return rollup.top_share(hours(spark, d), "app", 8)


def d17_error_trend(spark, d):
    return rollup.error_trend(hours(spark, d))


def d18_service_status(spark, d):
    return rollup.service_status(health(spark, d))


def d19_recent_issues(spark, d):
    return rollup.recent_issues(health(spark, d))


def all_severities(spark, d):
    """The log view with all eight severities, one for each event by its number."""
    names = F.array(*[F.lit(x) for x in PRI_SEVERITIES])
    return patterned(spark, d).withColumn("severity", F.element_at(names, (F.col("event_id") % 8 + 1).cast("int")))


def _eight_minutes(spark, d):
    return rollup.minute_stats(all_severities(spark, d))


def d5_hourly_exact(spark, d):
    return rollup.hourly_stats(_eight_minutes(spark, d))


def d5_hourly_cut(spark, d):
    return rollup.hourly_stats(_eight_minutes(spark, d), cut_severities=True)


def _eight_hours(spark, d):
    return stored(rollup.hourly_stats(_eight_minutes(spark, d)), "hourly_stats")


def _no_highlights(spark, d):
    """The columns of the highlights without a row; nothing is computed for it."""
    return rollup.hourly_highlights(rollup.minute_highlights(patterned(spark, d))).where(F.lit(False))


def d11_notable_incidents_exact(spark, d):
    none = _no_highlights(spark, d)
    return _texts(rollup.notable_incidents(_eight_hours(spark, d), none)).drop("highlights")


def d13_error_insights_exact(spark, d):
    none = _no_highlights(spark, d)
    return _texts(rollup.error_insights(_eight_hours(spark, d), none)).select("hour", "total_errors", "severity_breakdown")


def _eight_sums(spark, d):
    return stored(rollup.hourly_sums(_eight_minutes(spark, d)), "hourly_sums")


def d15_kpis_exact(spark, d):
    return rollup.kpis_24h(_eight_sums(spark, d))


def d16_top_hosts_exact(spark, d):
    return rollup.top_share(_eight_sums(spark, d), "host", 6)


def d16_top_severities_exact(spark, d):
    return rollup.top_share(_eight_sums(spark, d), "severity", 6)


def d17_error_trend_exact(spark, d):
    return rollup.error_trend(_eight_sums(spark, d))


def full_highlights(spark, d):
    """Every pattern of each hour, from uncut minutes."""
    return stored(rollup.hourly_highlights(rollup.minute_highlights(patterned(spark, d), None), None), "highlights")


def d9_service_health_exact(spark, d):
    return rollup.service_health(full_highlights(spark, d)).select("hour", "app", "anomalies")


def d18_service_status_exact(spark, d):
    return rollup.service_status(rollup.service_health(full_highlights(spark, d)))


def _chart_input(spark, d):
    return views.logs(spark, d).select("event_id", "ts", "host", "severity", F.to_date("ts").alias("day"))


def _chart(agg):
    def query(spark, d):
        return rollup.chart_points(_chart_input(spark, d), "day", "event_id", "severity", agg, "event_id").withColumn(
            "y", F.round(F.col("y").cast("double"), 4)
        )
    query.__name__ = f"d20_chart_{agg}"
    return query


def d20_chart_plain(spark, d):
    return rollup.chart_points(_chart_input(spark, d), "ts", "event_id", "host")


def d21_log_volume(spark, d):
    return rollup.chart_log_volume(views.logs(spark, d))


def d21_error_rate(spark, d):
    return rollup.chart_error_rate(views.logs(spark, d))


def d21_top_hosts(spark, d):
    return rollup.chart_top_hosts(views.logs(spark, d))


def d21_severity_dist(spark, d):
    return rollup.chart_severity_dist(views.logs(spark, d))


def d21_activity_frequency(spark, d):
    return rollup.chart_activity_frequency(views.process_events(spark, d))


QUERIES = {f.__name__: f for f in (
    d1_minute_stats, d2_pattern_sources, d3_minute_highlights, d4_rebuild_stats, d5_hourly_stats,
    d6_minute_rollup, d7_hourly_highlights, d8_analysis_levels, d9_service_health, d10_daily_exact,
    d10_daily_of_top_lists, d11_notable_incidents, d12_daily_highlights, d12_condensed,
    d13_error_insights, d14_hourly_counts, d15_kpis, d16_top_severities, d16_top_hosts,
    d16_top_apps, d17_error_trend, d18_service_status, d19_recent_issues, d5_hourly_exact, d5_hourly_cut,
    d11_notable_incidents_exact, d13_error_insights_exact, d15_kpis_exact, d16_top_hosts_exact, d16_top_severities_exact,
    d17_error_trend_exact, d9_service_health_exact, d18_service_status_exact,
    *[_chart(a) for a in ("sum", "avg", "count", "min", "max", "last")], d20_chart_plain,
    d21_log_volume, d21_error_rate, d21_top_hosts, d21_severity_dist, d21_activity_frequency,
)}

# --- the same in SQL --------------------------------------------------------

MSTATS = PATTERNS + """,
facts AS (SELECT date_trunc('minute', ts) AS bucket, pattern_id, severity, host, app, count(*) AS n
          FROM pat GROUP BY ALL),
mstats AS (
  SELECT bucket, 'severity' AS dim, severity AS key, cast(sum(n) AS BIGINT) AS cnt FROM facts GROUP BY ALL
  UNION ALL SELECT bucket, 'host', host, cast(sum(n) AS BIGINT) FROM facts GROUP BY ALL
  UNION ALL SELECT bucket, 'app', app, cast(sum(n) AS BIGINT) FROM facts GROUP BY ALL
  UNION ALL SELECT bucket, 'host_app', concat(host, '/', app), cast(sum(n) AS BIGINT) FROM facts GROUP BY ALL
  UNION ALL SELECT bucket, 'pattern', pattern_id, cast(sum(n) AS BIGINT) FROM facts GROUP BY ALL
  UNION ALL SELECT bucket, 'total', '', cast(sum(n) AS BIGINT) FROM facts GROUP BY ALL
  UNION ALL SELECT bucket, 'unique', '', count(DISTINCT pattern_id) FROM facts GROUP BY ALL)"""

HSTATS = MSTATS + """,
hsum AS (SELECT date_trunc('hour', bucket) AS hour, dim, key, cast(sum(cnt) AS BIGINT) AS cnt
         FROM mstats WHERE dim <> 'pattern' GROUP BY ALL),
hstats AS (SELECT *, row_number() OVER (PARTITION BY hour, dim ORDER BY cnt DESC, key) AS rank FROM hsum
           QUALIFY rank <= 5 OR dim = 'severity')"""


def highlight_ctes(unit: str, k: int) -> str:
    return f""",
hf AS (SELECT date_trunc('{unit}', ts) AS bucket, pattern_id, severity, host, app, message, ts, event_id,
   count(*) OVER (PARTITION BY date_trunc('{unit}', ts), pattern_id) AS occurrences,
   row_number() OVER (PARTITION BY date_trunc('{unit}', ts), pattern_id ORDER BY ts, event_id) AS rn FROM pat),
mh AS (SELECT bucket, pattern_id, severity, host, app, message, occurrences,
   row_number() OVER (PARTITION BY bucket ORDER BY occurrences DESC, ts, event_id) AS rank
   FROM hf WHERE rn = 1 QUALIFY rank <= {k}),
sf AS (SELECT date_trunc('{unit}', ts) AS bucket, pattern_id, kind, key, count(*) AS cnt FROM (
   SELECT ts, pattern_id, 'host' AS kind, host AS key FROM pat
   UNION ALL SELECT ts, pattern_id, 'app', app FROM pat) GROUP BY ALL),
ms AS (SELECT *, row_number() OVER (PARTITION BY bucket, pattern_id, kind ORDER BY cnt DESC, key) AS rank FROM sf
   QUALIFY rank <= 5)"""


PRIO = """CASE lower(severity) WHEN 'err' THEN 0 WHEN 'error' THEN 0 WHEN 'warn' THEN 1 WHEN 'warning' THEN 1
  WHEN 'crit' THEN 2 WHEN 'critical' THEN 2 WHEN 'alert' THEN 3 WHEN 'emerg' THEN 4 WHEN 'emergency' THEN 4
  WHEN 'notice' THEN 5 WHEN 'info' THEN 6 WHEN 'debug' THEN 7 ELSE 6 END"""

HH = highlight_ctes("minute", 50) + f""",
hm AS (SELECT date_trunc('hour', bucket) AS hour, pattern_id, cast(sum(occurrences) AS BIGINT) AS occurrences,
   arg_min(severity, bucket) AS severity, arg_min(host, bucket) AS host, arg_min(app, bucket) AS app,
   arg_min(message, bucket) AS message, min(bucket) AS fb, arg_min(rank, bucket) AS fr FROM mh GROUP BY ALL),
hh AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY {PRIO}, occurrences DESC, fb, fr) AS rank FROM hm),
hs0 AS (SELECT date_trunc('hour', bucket) AS hour, pattern_id, kind, key, cast(sum(ms.cnt) AS BIGINT) AS cnt
   FROM ms JOIN mh USING (bucket, pattern_id) GROUP BY ALL),
hs AS (SELECT *, row_number() OVER (PARTITION BY hour, pattern_id, kind ORDER BY cnt DESC, key) AS rank FROM hs0
   QUALIFY rank <= 5)"""

DAILY_ERR = "('emerg', 'alert', 'crit', 'err')"
SH = """,
sh AS (SELECT hour, CASE WHEN app = '-' THEN 'unknown' ELSE app END AS app, severity, message, occurrences, rank FROM hh)"""
RECENT = """, recent AS (SELECT hour FROM hstats WHERE dim = 'total' ORDER BY hour DESC LIMIT 24),
prev AS (SELECT hour FROM hstats WHERE dim = 'total' ORDER BY hour DESC LIMIT 24 OFFSET 24)"""
CLEAN = "left(message, 500)"
INCIDENT = f""",
inc AS (SELECT hour, cast(sum(cnt) AS BIGINT) AS total_errors,
   string_agg(concat(key, ':', cnt), ',' ORDER BY CASE key WHEN 'emerg' THEN 0 WHEN 'alert' THEN 1 WHEN 'crit' THEN 2 ELSE 3 END)
     AS severity_breakdown
   FROM hstats WHERE dim = 'severity' AND key IN {DAILY_ERR} GROUP BY hour),
eh AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY rank) AS er FROM hh WHERE rank <= 15 AND severity IN {DAILY_ERR}),
ehs AS (SELECT hour, string_agg(concat(severity, '|', host, '|', app, '|', occurrences, '|', message), ';' ORDER BY er)
   AS highlights FROM eh WHERE er <= 4 GROUP BY hour)"""


def _daily(src, col):
    return f"""SELECT day, dim, key, cnt, rank FROM (
      SELECT day, dim, key, cnt, row_number() OVER (PARTITION BY day, dim ORDER BY cnt DESC, key) AS rank FROM (
        SELECT date_trunc('day', {col}) AS day, dim, key, cast(sum(cnt) AS BIGINT) AS cnt FROM {src}
        WHERE dim IN ('severity', 'host', 'app', 'total', 'unique') GROUP BY ALL))
      WHERE dim = 'severity' OR rank <= 10"""


def _day_highlights(k, message):
    return f"""WITH {PATTERNS}{HH}, r AS (SELECT date_trunc('day', hour) AS day, hour, pattern_id, severity, host, app,
        occurrences, {message} AS message,
        row_number() OVER (PARTITION BY date_trunc('day', hour) ORDER BY {PRIO}, occurrences DESC, hour, rank) AS rank
        FROM hh WHERE rank <= 15)
      SELECT day, rank, hour, pattern_id, severity, host, app, occurrences, message FROM r WHERE rank <= {k}"""


def _pair_text(cte, kind, window):
    return f"""(SELECT string_agg(concat(s.key, ':', s.cnt), ',' ORDER BY s.rank) FROM {cte} s
      WHERE s.{window} = h.{window} AND s.pattern_id = h.pattern_id AND s.kind = '{kind}')"""


def _share(dim, k):
    return f"""WITH {HSTATS}{RECENT} SELECT key, cast(sum(cnt) AS BIGINT) AS count FROM hstats JOIN recent USING (hour)
      WHERE dim = '{dim}' GROUP BY key ORDER BY count DESC, key LIMIT {k}"""


_CHART = {"sum": "sum(event_id)", "avg": "avg(event_id)", "count": "count(event_id)", "min": "min(event_id)",
          "max": "max(event_id)", "last": "max(event_id)"}

ORACLES = {
    "d1_minute_stats": f"WITH {MSTATS} SELECT bucket, dim, key, cnt FROM mstats",
    "d2_pattern_sources": f"WITH {PATTERNS}{highlight_ctes('hour', 50)} SELECT bucket, pattern_id, kind, key, cnt, rank FROM ms",
    "d3_minute_highlights": f"""WITH {PATTERNS}{highlight_ctes('hour', 10)} SELECT h.*,
        {_pair_text('ms', 'host', 'bucket')} AS source_hosts, {_pair_text('ms', 'app', 'bucket')} AS source_apps FROM mh h""",
    "d4_rebuild_stats": f"""WITH {PATTERNS}{highlight_ctes('hour', 50)},
        st AS (SELECT bucket, severity, host, app, pattern_id,
                 CASE WHEN event_id % 5 <> 0 THEN occurrences ELSE 1 END AS w FROM hf WHERE rn = 1)
        SELECT bucket, 'severity' AS dim, severity AS key, cast(sum(w) AS BIGINT) AS cnt FROM st GROUP BY ALL
        UNION ALL SELECT bucket, 'host', host, cast(sum(w) AS BIGINT) FROM st GROUP BY ALL
        UNION ALL SELECT bucket, 'app', app, cast(sum(w) AS BIGINT) FROM st GROUP BY ALL
        UNION ALL SELECT bucket, 'pattern', pattern_id, cast(sum(w) AS BIGINT) FROM st GROUP BY ALL
        UNION ALL SELECT bucket, 'total', '', cast(sum(w) AS BIGINT) FROM st GROUP BY ALL
        UNION ALL SELECT bucket, 'unique', '', count(*) FROM st GROUP BY ALL""",
    "d5_hourly_stats": f"WITH {HSTATS} SELECT hour, dim, key, cnt, rank FROM hstats",
    "d6_minute_rollup": f"""WITH {PATTERNS} SELECT date_trunc('hour', ts) AS hour, date_trunc('minute', ts) AS minute,
        count(*) AS total, count(DISTINCT pattern_id) AS "unique" FROM pat GROUP BY ALL""",
    "d7_hourly_highlights": f"""WITH {PATTERNS}{HH} SELECT hour, pattern_id, rank, severity, host, app, message, occurrences,
        {_pair_text('hs', 'host', 'hour')} AS source_hosts, {_pair_text('hs', 'app', 'hour')} AS source_apps
        FROM hh h WHERE rank <= 15""",
    "d8_analysis_levels": f"""WITH {PATTERNS}{HH} SELECT hour, rank, pattern_id, severity, occurrences,
        row_number() OVER (PARTITION BY hour ORDER BY rank) AS level_rank FROM hh
        WHERE severity IN ('err', 'crit', 'alert', 'emerg') QUALIFY level_rank <= 5""",
    "d9_service_health": f"""WITH {PATTERNS}{HH}{SH},
        sv AS (SELECT hour, app, severity, sum(occurrences) AS n FROM sh GROUP BY ALL),
        sv2 AS (SELECT hour, app, cast(sum(n) AS BIGINT) AS anomalies,
            string_agg(concat(severity, ':', cast(n AS BIGINT)), ',' ORDER BY severity) AS severities FROM sv GROUP BY ALL),
        ti AS (SELECT hour, app, string_agg(concat(severity, '|', occurrences, '|', {CLEAN}), ';' ORDER BY rank) AS top_issues
            FROM (SELECT *, row_number() OVER (PARTITION BY hour, app ORDER BY rank) AS ir FROM sh) WHERE ir <= 3 GROUP BY ALL)
        SELECT * FROM sv2 JOIN ti USING (hour, app)""",
    "d10_daily_exact": f"WITH {MSTATS} {_daily('mstats', 'bucket')}",
    "d10_daily_of_top_lists": f"WITH {HSTATS} {_daily('hstats', 'hour')}",
    "d11_notable_incidents": f"""WITH {HSTATS}{HH}{INCIDENT} SELECT hour, total_errors, severity_breakdown,
        highlights, date_trunc('day', hour) AS day FROM inc LEFT JOIN ehs USING (hour)""",
    "d12_daily_highlights": _day_highlights(50, "message"),
    "d12_condensed": _day_highlights(15, "left(message, 500)"),
    "d13_error_insights": f"""WITH {HSTATS}{HH}{INCIDENT},
        seen AS (SELECT hour FROM hstats WHERE dim = 'total' ORDER BY hour DESC LIMIT 24),
        base AS (SELECT inc.* FROM inc JOIN seen USING (hour) ORDER BY hour DESC LIMIT 8),
        th0 AS (SELECT eh.hour, hs.key, sum(hs.cnt) AS c FROM eh JOIN hs ON hs.hour = eh.hour AND hs.pattern_id = eh.pattern_id
                AND hs.kind = 'host' GROUP BY ALL),
        th AS (SELECT hour, string_agg(concat(key, ':', cast(c AS BIGINT)), ',' ORDER BY c DESC, key) AS top_hosts FROM (
                SELECT *, row_number() OVER (PARTITION BY hour ORDER BY c DESC, key) AS r FROM th0) WHERE r <= 5 GROUP BY hour),
        ta0 AS (SELECT hour, app AS key, sum(occurrences) AS c FROM eh GROUP BY ALL),
        ta AS (SELECT hour, string_agg(concat(key, ':', cast(c AS BIGINT)), ',' ORDER BY c DESC, key) AS top_apps FROM (
                SELECT *, row_number() OVER (PARTITION BY hour ORDER BY c DESC, key) AS r FROM ta0) WHERE r <= 3 GROUP BY hour)
        SELECT * FROM base LEFT JOIN th USING (hour) LEFT JOIN ta USING (hour) LEFT JOIN ehs USING (hour)""",
    "d14_hourly_counts": f"""WITH {LOGS} SELECT date_trunc('hour', ts) AS hour, count(*) AS count FROM logs
        WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY 1""",
    "d15_kpis": f"""WITH {HSTATS}{RECENT},
        ph AS (SELECT hour, sum(CASE WHEN dim = 'total' THEN cnt END) AS events,
            coalesce(sum(CASE WHEN dim = 'severity' AND key IN ('emerg','alert','crit','err','error') THEN cnt END), 0) AS errors
            FROM hstats JOIN recent USING (hour) GROUP BY hour),
        t AS (SELECT cast(sum(events) AS BIGINT) AS total_events, cast(sum(errors) AS BIGINT) AS total_errors,
            count(*) FILTER (events > 0 AND errors / events > 0.1) AS anomaly_hours FROM ph),
        h AS (SELECT count(DISTINCT key) AS unique_hosts FROM hstats JOIN recent USING (hour) WHERE dim = 'host'),
        p AS (SELECT cast(sum(cnt) AS BIGINT) AS previous_events FROM hstats JOIN prev USING (hour) WHERE dim = 'total')
        SELECT *, round(total_errors / total_events * 100, 2) AS error_rate,
          round((total_events - previous_events) / previous_events * 100, 1) AS events_change FROM t, h, p""",
    "d16_top_severities": _share("severity", 6),
    "d16_top_hosts": _share("host", 6),
    "d16_top_apps": _share("app", 8),
    "d17_error_trend": f"""WITH {HSTATS}{RECENT} SELECT hour, cast(coalesce(sum(CASE WHEN dim = 'severity'
        AND key IN ('emerg','alert','crit','err','error') THEN cnt END), 0) AS BIGINT) AS errors
        FROM hstats JOIN recent USING (hour) GROUP BY hour""",
    "d18_service_status": f"""WITH {PATTERNS}{HH}{SH}, rh AS (SELECT DISTINCT hour FROM sh ORDER BY hour DESC LIMIT 24)
        SELECT app, cast(sum(occurrences) AS BIGINT) AS anomalies,
          CASE WHEN sum(occurrences) > 10 THEN 'critical' WHEN sum(occurrences) > 0 THEN 'warning' ELSE 'healthy' END AS status
        FROM sh JOIN rh USING (hour) GROUP BY app""",
    "d19_recent_issues": f"""WITH {PATTERNS}{HH}{SH}, rh AS (SELECT DISTINCT hour FROM sh ORDER BY hour DESC LIMIT 24),
        i AS (SELECT *, row_number() OVER (PARTITION BY hour, app ORDER BY rank) AS issue_rank FROM sh JOIN rh USING (hour))
        SELECT hour, app, severity, {CLEAN} AS message, occurrences AS count, issue_rank FROM i WHERE issue_rank <= 3
        ORDER BY CASE severity WHEN 'emerg' THEN 0 WHEN 'alert' THEN 1 WHEN 'crit' THEN 2 WHEN 'err' THEN 3 WHEN 'error' THEN 3
          WHEN 'warn' THEN 4 WHEN 'info' THEN 5 ELSE 9 END, hour DESC, app, issue_rank LIMIT 15""",
    **{f"d20_chart_{a}": f"""WITH {LOGS} SELECT cast(ts AS DATE) AS x, severity AS "group",
        round(cast({e} AS DOUBLE), 4) AS y FROM logs GROUP BY ALL""" for a, e in _CHART.items()},
    "d20_chart_plain": f'WITH {LOGS} SELECT ts AS x, event_id AS y, host AS "group" FROM logs',
    "d21_log_volume": f"WITH {LOGS} SELECT date_trunc('hour', ts) AS hour, count(*) AS count FROM logs GROUP BY 1",
    "d21_error_rate": f"""WITH {LOGS} SELECT date_trunc('hour', ts) AS hour,
        round(count(*) FILTER (severity IN ('err', 'crit', 'emerg')) / count(*) * 100, 6) AS error_rate FROM logs GROUP BY 1""",
    "d21_top_hosts": f"WITH {LOGS} SELECT host, count(*) AS count FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "d21_severity_dist": f"WITH {LOGS} SELECT severity, count(*) AS count FROM logs GROUP BY 1",
    "d21_activity_frequency": """SELECT event_type AS activity, count(*) AS count FROM events
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
}

# The same over all eight severities; `sums` stands in for the cut lists.
_EIGHT = (
    PATTERNS + f""",
pat8 AS (SELECT * REPLACE ({PRI_SEVERITIES}[event_id % 8 + 1] AS severity) FROM pat)"""
    + HSTATS[len(PATTERNS):].replace("FROM pat GROUP BY ALL", "FROM pat8 GROUP BY ALL")
)
_SUMS = _EIGHT[:_EIGHT.index(",\nhstats AS")] + ",\nhstats AS (SELECT * FROM hsum)"
ORACLES |= {
    "d5_hourly_exact": f"WITH {_EIGHT} SELECT hour, dim, key, cnt, rank FROM hstats",
    "d5_hourly_cut": f"WITH {_EIGHT} SELECT hour, dim, key, cnt, rank FROM hstats WHERE rank <= 5",
    "d11_notable_incidents_exact": f"""WITH {_EIGHT}{HH}{INCIDENT}
        SELECT hour, total_errors, severity_breakdown, date_trunc('day', hour) AS day FROM inc""",
    "d13_error_insights_exact": f"""WITH {_EIGHT}{HH}{INCIDENT}, seen AS (SELECT hour FROM hstats WHERE dim = 'total' ORDER BY hour DESC LIMIT 24)
        SELECT hour, total_errors, severity_breakdown FROM inc JOIN seen USING (hour) ORDER BY hour DESC LIMIT 8""",
    "d15_kpis_exact": ORACLES["d15_kpis"].replace(HSTATS, _SUMS),
    "d16_top_hosts_exact": _share("host", 6).replace(HSTATS, _SUMS),
    "d16_top_severities_exact": _share("severity", 6).replace(HSTATS, _SUMS),
    "d17_error_trend_exact": ORACLES["d17_error_trend"].replace(HSTATS, _SUMS),
    "d9_service_health_exact": f"""WITH {PATTERNS} SELECT hour, app, count(*) AS anomalies FROM (SELECT date_trunc('hour', ts) AS hour,
          first_value(app) OVER (PARTITION BY date_trunc('hour', ts), pattern_id ORDER BY ts, event_id) AS app FROM pat) GROUP BY ALL""",
    "d18_service_status_exact": f"""WITH {PATTERNS}, sh AS (SELECT date_trunc('hour', ts) AS hour,
          first_value(app) OVER (PARTITION BY date_trunc('hour', ts), pattern_id ORDER BY ts, event_id) AS app FROM pat),
        rh AS (SELECT DISTINCT hour FROM sh ORDER BY hour DESC LIMIT 24)
        SELECT app, count(*) AS anomalies, CASE WHEN count(*) > 10 THEN 'critical' ELSE 'warning' END AS status
        FROM sh JOIN rh USING (hour) GROUP BY app""",
}
# Column types as Spark has them.
for _name, _types in {
    "d2_pattern_sources": {'rank': 'INTEGER'},
    "d3_minute_highlights": {'rank': 'INTEGER'},
    "d5_hourly_stats": {'rank': 'INTEGER'},
    "d7_hourly_highlights": {'rank': 'INTEGER'},
    "d10_daily_exact": {'rank': 'INTEGER'},
    "d5_hourly_exact": {'rank': 'INTEGER'},
    "d5_hourly_cut": {'rank': 'INTEGER'},
    "d10_daily_of_top_lists": {'rank': 'INTEGER'},
    "d12_daily_highlights": {'rank': 'INTEGER'},
    "d12_condensed": {'rank': 'INTEGER'},
    "d8_analysis_levels": {'rank': 'INTEGER', 'level_rank': 'INTEGER'},
    "d19_recent_issues": {'issue_rank': 'INTEGER'},
}.items():
    ORACLES[_name] = typed(ORACLES[_name], **_types)
