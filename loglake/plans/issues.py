"""Checked queries: issue lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ntz
from ..operators import issues, rollup
from ..session import scratch, stored
from ..sources import keyed
from .oracle_views import PATTERNS
from .parsing import patterned
from .rollups import HH, PRIO, highlights

DAY = "2024-01-15 00:00:00"
LAST = "2024-01-30 00:00:00"


def listed_patterns(spark, d):
    """Error patterns that made the daily top lists: the form the reports use."""
    return stored(issues.daily_error_patterns(rollup.daily_highlights(highlights(spark, d))), "daily_patterns")


def all_patterns(spark, d):
    """Every error pattern of each day, from the events."""
    return stored(issues.daily_error_patterns_of_events(patterned(spark, d)), "daily_patterns")


daily_patterns = listed_patterns


def _today(daily):
    return daily.where(F.col("day") == ntz(DAY))


def _before(daily):
    return issues.issue_state_as_of(daily, ntz("2024-01-14 00:00:00"))


def e1_daily_error_patterns(spark, d):
    return issues.daily_error_patterns(rollup.daily_highlights(highlights(spark, d)))


def e2_upsert_issues(spark, d):
    daily = daily_patterns(spark, d)
    return issues.upsert_issues(_before(daily), _today(daily))


def e3_resolve_missing(spark, d):
    daily = daily_patterns(spark, d)
    state = issues.upsert_issues(_before(daily), _today(daily))
    return issues.resolve_missing(state, _today(daily), ntz(DAY))


def e4_active_issues(spark, d):
    return issues.active_issues(issues.issue_state_as_of(daily_patterns(spark, d), ntz(DAY)))


def e4_resolved_issues(spark, d):
    return issues.resolved_issues(
        issues.issue_state_as_of(daily_patterns(spark, d), ntz(DAY)), ntz("2024-01-13 00:00:00")
    )


def e5_trend_report(spark, d):
    return issues.trend_report(issues.issue_state_as_of(daily_patterns(spark, d), ntz(DAY)), ntz(DAY))


def e5_trend_details(spark, d):
    return issues.trend_details(issues.issue_state_as_of(daily_patterns(spark, d), ntz(DAY)), ntz(DAY))


def e6_issue_timeline(spark, d):
    return issues.issue_timeline(daily_patterns(spark, d), ntz(LAST))


def e2_keyed_issues(spark, d):
    """The stored issue table after all days, one commit each; buckets are compacted on the way."""
    daily, root = all_patterns(spark, d), scratch(spark, "issues")
    for day in range(1, 31):
        at = ntz(f"2024-01-{day:02d} 00:00:00")
        issues.advance_stored(daily.where(F.col("day") == at), root, at, buckets=4, most=6)
    return keyed.read_rows(spark, root, issues.KEY)


def _on(source, query):
    """The query over another source of daily patterns."""
    def run(spark, d):
        return query(source(spark, d))
    return run


_EXACT = {
    "e1_daily_error_patterns_exact": lambda x: x,
    "e2_upsert_issues_exact": lambda x: issues.upsert_issues(_before(x), _today(x)),
    "e3_resolve_missing_exact": lambda x: issues.resolve_missing(
        issues.upsert_issues(_before(x), _today(x)), _today(x), ntz(DAY)),
    "e4_active_issues_exact": lambda x: issues.active_issues(issues.issue_state_as_of(x, ntz(DAY))),
    "e4_resolved_issues_exact": lambda x: issues.resolved_issues(
        issues.issue_state_as_of(x, ntz(DAY)), ntz("2024-01-13 00:00:00")),
    "e5_trend_report_exact": lambda x: issues.trend_report(issues.issue_state_as_of(x, ntz(DAY)), ntz(DAY)),
    "e5_trend_details_exact": lambda x: issues.trend_details(issues.issue_state_as_of(x, ntz(DAY)), ntz(DAY)),
    "e6_issue_timeline_exact": lambda x: issues.issue_timeline(x, ntz(LAST)),
}

QUERIES = {f.__name__: f for f in (
    e1_daily_error_patterns, e2_upsert_issues, e3_resolve_missing, e4_active_issues,
    e4_resolved_issues, e5_trend_report, e5_trend_details, e6_issue_timeline, e2_keyed_issues,
)} | {name: _on(all_patterns, query) for name, query in _EXACT.items()}

DAILY = PATTERNS + HH + f""",
dh AS (SELECT date_trunc('day', hour) AS day, pattern_id, severity, message,
   row_number() OVER (PARTITION BY date_trunc('day', hour) ORDER BY {PRIO}, occurrences DESC, hour, rank) AS rank
   FROM hh WHERE rank <= 15),
daily AS (SELECT day, pattern_id, arg_max(severity, rank) AS severity, arg_max(message, rank) AS sample_message
   FROM dh WHERE rank <= 50 AND lower(severity) IN ('err','error','crit','critical','alert','emerg','emergency')
   GROUP BY day, pattern_id)"""


def _state(day):
    return f"""(SELECT pattern_id, min(day) AS first_seen, max(day) AS last_seen,
      CASE WHEN max(day) = TIMESTAMP '{day}' THEN 'active' ELSE 'resolved' END AS status,
      arg_max(severity, day) AS severity, arg_max(sample_message, day) AS sample_message
      FROM daily WHERE day <= TIMESTAMP '{day}' GROUP BY pattern_id)"""


_UPSERT = f"""(SELECT pattern_id, coalesce(s.first_seen, t.day) AS first_seen, coalesce(t.day, s.last_seen) AS last_seen,
    CASE WHEN t.day IS NOT NULL THEN 'active' ELSE s.status END AS status,
    CASE WHEN t.day IS NOT NULL THEN t.severity ELSE s.severity END AS severity,
    CASE WHEN t.day IS NOT NULL THEN t.sample_message ELSE s.sample_message END AS sample_message
  FROM {_state('2024-01-14 00:00:00')} s FULL OUTER JOIN (SELECT * FROM daily WHERE day = TIMESTAMP '{DAY}') t
  USING (pattern_id))"""

_CLASS = f"""CASE WHEN status = 'active' AND first_seen >= TIMESTAMP '{DAY}' THEN 'new' WHEN status = 'active' THEN 'ongoing'
   WHEN last_seen >= TIMESTAMP '{DAY}' - INTERVAL 1 DAY THEN 'resolved' END"""

ORACLES = {
    "e1_daily_error_patterns": f"WITH {DAILY} SELECT * FROM daily",
    "e2_upsert_issues": f"WITH {DAILY} SELECT * FROM {_UPSERT}",
    "e3_resolve_missing": f"""WITH {DAILY}, u AS (SELECT * FROM {_UPSERT}),
        g AS (SELECT *, status = 'active' AND last_seen < TIMESTAMP '{DAY}'
          AND pattern_id NOT IN (SELECT pattern_id FROM daily WHERE day = TIMESTAMP '{DAY}') AS newly_resolved FROM u)
        SELECT * REPLACE (CASE WHEN newly_resolved THEN 'resolved' ELSE status END AS status) FROM g""",
    "e4_active_issues": f"WITH {DAILY} SELECT * FROM {_state(DAY)} WHERE status = 'active'",
    "e4_resolved_issues": f"""WITH {DAILY} SELECT * FROM {_state(DAY)}
        WHERE status = 'resolved' AND last_seen >= TIMESTAMP '2024-01-13 00:00:00'""",
    "e5_trend_report": f"""WITH {DAILY}, c AS (SELECT {_CLASS} AS class FROM {_state(DAY)})
        SELECT TIMESTAMP '{DAY}' AS day, count(*) FILTER (class = 'new') AS new_count,
          count(*) FILTER (class = 'ongoing') AS ongoing_count, count(*) FILTER (class = 'resolved') AS resolved_count FROM c""",
    "e5_trend_details": f"""WITH {DAILY} SELECT *, {_CLASS} AS class FROM {_state(DAY)} WHERE {_CLASS} IS NOT NULL""",
    "e6_issue_timeline": f"""WITH {DAILY}, w AS (SELECT pattern_id, day, severity,
          min(day) OVER (PARTITION BY pattern_id) AS first_day,
          lag(day) OVER (PARTITION BY pattern_id ORDER BY day) AS previous_day,
          lead(day) OVER (PARTITION BY pattern_id ORDER BY day) AS nx FROM daily)
        SELECT pattern_id, day, severity, first_day, previous_day,
          CASE WHEN previous_day IS NULL THEN 'new' WHEN previous_day = day - INTERVAL 1 DAY THEN 'ongoing' ELSE 'reopened' END AS state,
          CASE WHEN (nx IS NULL OR nx > day + INTERVAL 1 DAY) AND day < TIMESTAMP '{LAST}' THEN day + INTERVAL 1 DAY END AS resolved_day
        FROM w""",
}

# The same over all error patterns of the events.
_ALL = PATTERNS + """,
daily AS (SELECT date_trunc('day', ts) AS day, pattern_id, arg_min(severity, {'t': ts, 'e': event_id}) AS severity,
    arg_min(message, {'t': ts, 'e': event_id}) AS sample_message FROM pat
  WHERE lower(severity) IN ('err','error','crit','critical','alert','emerg','emergency') GROUP BY ALL)"""
ORACLES |= {name: ORACLES[name.removesuffix("_exact")].replace(DAILY, _ALL) for name in _EXACT}
ORACLES["e2_keyed_issues"] = f"WITH {_ALL} SELECT * FROM {_state(LAST)}"
