"""Checked queries: usage, quotas, billing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import bucket_of, ntz
from ..operators import usage
from ..sources import views
from .oracle_views import LOGS, typed

NOW = "2024-01-20 13:30:00"
DAY = "2024-01-20 00:00:00"
LIMITS = {"starter": 60, "professional": 80, "business": 100, "enterprise": 120}


def _hourly(spark, d):
    return usage.hourly_usage(views.logs(spark, d))


def _daily(spark, d):
    return usage.with_storage(usage.daily_usage(_hourly(spark, d)))


def _projects(spark, d):
    return views.projects(views.logs(spark, d))


def _plans(spark):
    return views.plans(spark, LIMITS).withColumn("events_per_month_limit", F.lit(2000).cast("long"))


def k1_hourly_usage(spark, d):
    return _hourly(spark, d)


def _merged(mode):
    def query(spark, d):
        h = _hourly(spark, d)
        old = h.where(F.col("timestamp_hour") < ntz(DAY))
        delta = h.where(F.col("timestamp_hour") >= ntz("2024-01-15 00:00:00"))
        return usage.merge_usage(old, delta, mode)
    query.__name__ = f"k2_merge_{mode}"
    return query


def _host_checked(rows, events, at):
    """Estimated hosts against the exact ones of the same events: within the sketch's error, or one off."""
    unit = "hour" if at == "timestamp_hour" else at
    exact = events.groupBy(F.col("tenant_id").alias("project_id"), bucket_of(F.col("ts"), unit).alias(at)).agg(
        F.count_distinct("host").alias("hosts_exact")
    )
    off = F.abs(F.col("unique_hosts") - F.col("hosts_exact"))
    return rows.join(exact, ["project_id", at]).select(
        "project_id", at, "event_count", "error_count", "hosts_exact",
        (off <= F.greatest(F.lit(1), F.col("hosts_exact") * usage.HOST_ERROR)).alias("within"),
    )


def _many_hosts(spark, d):
    """Logs with more hosts than the view has."""
    return views.logs(spark, d).withColumn("host", F.concat("host", F.lit("-"), F.col("event_id") % 997))


def k2_add_hosts(spark, d):
    """Every day comes in two parts that share hosts."""
    logs = _many_hosts(spark, d)
    one, two = (usage.hourly_usage_mergeable(logs.where(F.col("event_id") % 2 == k)) for k in (0, 1))
    return _host_checked(usage.merge_usage_hosts(one, two), logs, "timestamp_hour")


def k2_replace_hosts(spark, d):
    """A backfill of half the range over counts of another project split."""
    logs = _many_hosts(spark, d)
    since = ntz("2024-01-15 00:00:00")
    old = usage.hourly_usage_mergeable(logs.where((F.col("ts") < since) | (F.col("event_id") % 3 == 0)))
    new = usage.hourly_usage_mergeable(logs.where(F.col("ts") >= since))
    return _host_checked(usage.merge_usage_hosts(old, new, "replace"), logs, "timestamp_hour")


def k3_daily_hosts(spark, d):
    logs = _many_hosts(spark, d)
    return _host_checked(usage.hosts_per(usage.hourly_usage_mergeable(logs), "day"), logs, "day")


def k3_monthly_hosts(spark, d):
    """Months from days from hours: the events are read once."""
    logs = _many_hosts(spark, d)
    days = usage.hosts_per(usage.hourly_usage_mergeable(logs), "day")
    return _host_checked(usage.hosts_per(days, "month"), logs, "month")


def k3_daily_usage(spark, d):
    return usage.daily_usage(_hourly(spark, d))


def k3_daily_usage_tz(spark, d):
    return usage.daily_usage(_hourly(spark, d), "Asia/Tehran")


def k4_hourly_history(spark, d):
    return usage.usage_history(_hourly(spark, d), "t1", ntz("2024-01-24 00:00:00"))


def k4_daily_history(spark, d):
    return usage.usage_history(usage.daily_usage(_hourly(spark, d)), "t1", ntz("2024-01-10 00:00:00"))


def k4_usage_range(spark, d):
    return usage.usage_range(_hourly(spark, d), "t2", ntz("2024-01-05 00:00:00"), ntz(DAY))


def k5_current_usage(spark, d):
    return usage.current_usage(_hourly(spark, d), ntz(NOW))


def k5_current_usage_tz(spark, d):
    return usage.current_usage(_hourly(spark, d), ntz(NOW), "Asia/Tehran")


def k7_last_event_at(spark, d):
    return usage.last_event_at(_hourly(spark, d))


def k8_quota_status(spark, d):
    out = usage.quota_status(_daily(spark, d), _projects(spark, d), _plans(spark), ntz(DAY))
    return out.withColumn("usage_percent", F.round("usage_percent", 4))


def k9_quota_actions(spark, d):
    return usage.quota_actions(_daily(spark, d), _projects(spark, d), _plans(spark), ntz(DAY))


def k10_admit_events(spark, d):
    p = _projects(spark, d).join(_plans(spark), "plan_id").select(
        "project_id", F.coalesce("custom_quota_per_day", "events_per_day_limit").alias("limit")
    )
    return usage.admit_events(views.logs(spark, d).select("event_id", "ts", "tenant_id"), p)


def _view(spark, d):
    return usage.projects_view(_projects(spark, d), _plans(spark), _hourly(spark, d), _daily(spark, d), ntz(NOW))


def _rounded(df):
    return df.withColumn("usage_percent", F.round("usage_percent", 4)).withColumn("storage_mb", F.round("storage_mb", 6))


def k11_projects_view(spark, d):
    return _rounded(_view(spark, d))


def k12_overview(spark, d):
    return usage.overview(_projects(spark, d), _plans(spark), _daily(spark, d), ntz(NOW))


def k13_fleet_summary(spark, d):
    return usage.fleet_summary(_view(spark, d)).withColumn(
        "mean_usage_percent", F.round("mean_usage_percent", 4)
    ).withColumn("total_storage_mb", F.round("total_storage_mb", 6))


def k13_fleet_top(spark, d):
    return usage.fleet_top(_view(spark, d)).withColumn("usage_percent", F.round("usage_percent", 4))


def k14_invoices(spark, d):
    out = usage.invoices(_projects(spark, d), _plans(spark), _daily(spark, d), 0.01)
    return out.withColumn("overage_charge", F.round("overage_charge", 4)).withColumn("total_amount", F.round("total_amount", 4))


QUERIES = {f.__name__: f for f in (
    k1_hourly_usage, _merged("add"), _merged("replace"), k3_daily_usage, k3_daily_usage_tz, k4_hourly_history,
    k4_daily_history, k4_usage_range, k5_current_usage, k5_current_usage_tz, k7_last_event_at, k8_quota_status,
    k9_quota_actions, k10_admit_events, k11_projects_view, k12_overview, k13_fleet_summary, k13_fleet_top,
    k14_invoices, k2_add_hosts, k2_replace_hosts, k3_daily_hosts, k3_monthly_hosts,
)}

HU = LOGS + """,
hu AS (SELECT tenant_id AS project_id, date_trunc('hour', ts) AS timestamp_hour, count(*) AS event_count,
  count(*) FILTER (severity IN ('err', 'crit')) AS error_count, count(DISTINCT host) AS unique_hosts,
  cast(sum(strlen(message)) AS BIGINT) AS data_size_bytes FROM logs GROUP BY 1, 2),
du AS (SELECT project_id, date_trunc('day', timestamp_hour) AS date, cast(sum(event_count) AS BIGINT) AS event_count,
  cast(sum(error_count) AS BIGINT) AS error_count, max(event_count) AS peak_events_per_hour,
  cast(sum(data_size_bytes) AS BIGINT) AS total_data_size_bytes FROM hu GROUP BY 1, 2)"""
PJ = HU + """,
pj AS (SELECT DISTINCT tenant_id AS project_id, concat('Project ', tenant_id) AS name,
  CASE tenant_id WHEN 't0' THEN 'starter' WHEN 't1' THEN 'professional' WHEN 't2' THEN 'business' ELSE 'starter' END AS plan_id,
  CASE WHEN tenant_id = 't3' THEN 'suspended' ELSE 'active' END AS status,
  CASE WHEN tenant_id = 't2' THEN 90 END AS custom FROM logs),
pl(plan_id, plan_name, price, day_limit) AS (VALUES ('starter', 'Starter', 29.0::DOUBLE, 60), ('professional', 'Professional', 99.0, 80),
  ('business', 'Business', 299.0, 100), ('enterprise', 'Enterprise', 999.0, 120)),
pp AS (SELECT *, cast(coalesce(custom, day_limit) AS BIGINT) AS lim FROM pj JOIN pl USING (plan_id))"""
_COLOUR = "CASE WHEN {p} >= 100 THEN 'red' WHEN {p} >= 90 THEN 'orange' WHEN {p} >= 80 THEN 'yellow' ELSE 'green' END"


def _merge_sql(value, hosts):
    return f"""WITH {HU}, a AS (SELECT * FROM hu WHERE timestamp_hour < TIMESTAMP '{DAY}'),
      b AS (SELECT * FROM hu WHERE timestamp_hour >= TIMESTAMP '2024-01-15')
      SELECT project_id, timestamp_hour, {value.format(c='event_count')} AS event_count, {value.format(c='error_count')} AS error_count,
        {hosts} AS unique_hosts, {value.format(c='data_size_bytes')} AS data_size_bytes
      FROM a FULL OUTER JOIN b USING (project_id, timestamp_hour)"""


_CUR = """SELECT project_id, coalesce(cast(sum(event_count) FILTER (date_trunc('hour', {l}) = date_trunc('hour', {n})) AS BIGINT), 0)
    AS current_hour, cast(sum(event_count) AS BIGINT) AS current_day FROM hu
    WHERE {l} >= date_trunc('day', {n}) AND {l} <= {n} GROUP BY 1"""
_TEH = "(({x} AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tehran')"
_NOW = f"TIMESTAMP '{NOW}'"
VIEW = PJ + f""",
cur AS ({_CUR.format(l='timestamp_hour', n=_NOW)}),
pv AS (SELECT project_id, name, plan_id, plan_name, status, coalesce(current_day, 0) AS current_day_events,
  coalesce(current_hour, 0) AS current_hour_events, lim AS daily_limit, coalesce(current_day, 0) / lim * 100 AS up,
  coalesce((SELECT arg_max(stored, date) / 1048576 FROM (
    SELECT *, sum(total_data_size_bytes) OVER (PARTITION BY project_id ORDER BY date) AS stored FROM du) du WHERE du.project_id = pp.project_id
    AND date >= TIMESTAMP '{DAY}' - INTERVAL 2 DAY), 0.0) AS sm,
  (SELECT max(timestamp_hour) FROM hu WHERE hu.project_id = pp.project_id) AS last_event_at
  FROM pp LEFT JOIN cur USING (project_id))"""
_USED = f"LEFT JOIN (SELECT project_id, event_count AS used FROM du WHERE date = TIMESTAMP '{DAY}') USING (project_id)"

ORACLES = {
    "k1_hourly_usage": f"WITH {HU} SELECT * FROM hu",
    "k2_merge_add": _merge_sql("coalesce(a.{c}, 0) + coalesce(b.{c}, 0)", "greatest(a.unique_hosts, b.unique_hosts)"),
    "k2_merge_replace": _merge_sql("coalesce(b.{c}, a.{c})", "coalesce(b.unique_hosts, a.unique_hosts)"),
    "k3_daily_usage": f"WITH {HU} SELECT * FROM du",
    "k3_daily_usage_tz": f"""WITH {HU} SELECT project_id, date_trunc('day', {_TEH.format(x='timestamp_hour')}) AS date,
        cast(sum(event_count) AS BIGINT) AS event_count, cast(sum(error_count) AS BIGINT) AS error_count,
        max(event_count) AS peak_events_per_hour, cast(sum(data_size_bytes) AS BIGINT) AS total_data_size_bytes FROM hu GROUP BY 1, 2""",
    "k4_hourly_history": f"WITH {HU} SELECT * FROM hu WHERE project_id = 't1' AND timestamp_hour >= TIMESTAMP '2024-01-24'",
    "k4_daily_history": f"WITH {HU} SELECT * FROM du WHERE project_id = 't1' AND date >= TIMESTAMP '2024-01-10'",
    "k4_usage_range": f"""WITH {HU} SELECT cast(sum(event_count) AS BIGINT) AS event_count FROM hu WHERE project_id = 't2'
        AND timestamp_hour BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '{DAY}'""",
    "k5_current_usage": f"WITH {HU} {_CUR.format(l='timestamp_hour', n=_NOW)}",
    "k5_current_usage_tz": f"WITH {HU} {_CUR.format(l=_TEH.format(x='timestamp_hour'), n=_TEH.format(x=_NOW))}",
    "k7_last_event_at": f"WITH {HU} SELECT project_id, max(timestamp_hour) AS last_event_at FROM hu GROUP BY 1",
    "k8_quota_status": f"""WITH {PJ}, q AS (SELECT project_id, status = 'active' AS act,
          CASE WHEN status = 'active' THEN coalesce(used, 0) ELSE 0 END AS u, CASE WHEN status = 'active' THEN lim ELSE 0 END AS l
          FROM pp {_USED}),
        r AS (SELECT *, CASE WHEN act THEN u / l * 100 ELSE 100.0 END AS p FROM q)
        SELECT project_id, {_COLOUR.format(p='p')} AS quota_status, u AS usage_count, l AS "limit", round(p, 4) AS usage_percent,
          p >= 100 AS exceeded, act AND p >= 80 AND p < 90 AS should_warn, act AND p >= 90 AS should_alert FROM r""",
    "k9_quota_actions": f"""WITH {PJ}, q AS (SELECT *, coalesce(used, 0) AS u FROM pp {_USED}),
        a AS (SELECT project_id, CASE WHEN status = 'active' AND u >= lim THEN 'suspend' WHEN status = 'suspended' AND u < lim
          THEN 'resume' END AS action, u AS usage_count, lim AS "limit" FROM q) SELECT * FROM a WHERE action IS NOT NULL""",
    "k10_admit_events": f"""WITH {PJ} SELECT event_id, ts, tenant_id, row_number() OVER (PARTITION BY tenant_id, cast(ts AS DATE)
        ORDER BY ts, event_id) <= lim AS admitted FROM logs JOIN pp ON tenant_id = project_id""",
    "k11_projects_view": f"""WITH {VIEW} SELECT * EXCLUDE (up, sm), round(up, 4) AS usage_percent, round(sm, 6) AS storage_mb,
        {_COLOUR.format(p='up')} AS quota_status FROM pv""",
    "k12_overview": f"""WITH {PJ} SELECT count(*) AS total_projects, count(*) FILTER (status = 'active') AS active_projects,
        count(*) FILTER (status = 'suspended') AS suspended_projects,
        sum(price) FILTER (status = 'active') AS monthly_recurring_revenue,
        (SELECT cast(sum(event_count) AS BIGINT) FROM du WHERE date = TIMESTAMP '{DAY}') AS events_today,
        (SELECT cast(sum(event_count) AS BIGINT) FROM du WHERE date >= TIMESTAMP '2024-01-01') AS events_this_month FROM pp""",
    "k13_fleet_summary": f"""WITH {VIEW} SELECT cast(sum(current_day_events) AS BIGINT) AS total_events,
        cast(sum(daily_limit) AS BIGINT) AS total_limit, round(sum(sm), 6) AS total_storage_mb, round(avg(up), 4) AS mean_usage_percent,
        count(*) FILTER (status = 'active') AS active_projects, count(*) FILTER (status = 'suspended') AS suspended_projects FROM pv""",
    "k13_fleet_top": f"""WITH {VIEW} SELECT project_id, current_day_events, round(up, 4) AS usage_percent FROM pv
        ORDER BY current_day_events DESC, project_id LIMIT 5""",
    "k14_invoices": f"""WITH {PJ}, m AS (SELECT project_id, date_trunc('month', date) AS ps, sum(event_count) AS ev FROM du GROUP BY 1, 2),
        i AS (SELECT *, cast(greatest(ev - 2000, 0) AS BIGINT) AS oe FROM m JOIN pp USING (project_id))
        SELECT concat('invoice_', strftime(ps, '%Y%m'), '_', project_id) AS invoice_id, project_id, cast(ps AS TIMESTAMP) AS period_start,
          cast(ps + INTERVAL 1 MONTH AS TIMESTAMP) AS period_end, price AS base_amount, oe AS overage_events,
          round(oe * 0.01, 4) AS overage_charge, round(price + oe * 0.01, 4) AS total_amount, 'pending' AS status FROM i""",
}

# Column types as Spark has them.
for _name, _types in {
    "k14_invoices": {'overage_charge': 'DOUBLE'},
}.items():
    ORACLES[_name] = typed(ORACLES[_name], **_types)


def _hosts(unit, at):
    return f"""WITH {LOGS} SELECT tenant_id AS project_id, date_trunc('{unit}', ts) AS {at}, count(*) AS event_count,
        count(*) FILTER (severity IN ('err', 'crit')) AS error_count,
        count(DISTINCT concat(host, '-', event_id % 997)) AS hosts_exact, true AS "within" FROM logs GROUP BY 1, 2"""


ORACLES["k2_add_hosts"] = ORACLES["k2_replace_hosts"] = _hosts("hour", "timestamp_hour")
ORACLES["k3_daily_hosts"], ORACLES["k3_monthly_hosts"] = _hosts("day", "day"), _hosts("month", "month")
