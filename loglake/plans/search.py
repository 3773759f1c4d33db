"""Checked queries: search, ad-hoc SQL, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ntz
from ..operators import rollup, search, sql_surface
from ..session import scratch
from ..sources import storage, views
from .oracle_views import LOGS, typed
from .rollups import HSTATS, hours

NOW = "2024-01-31 00:00:00"


def f1_search(spark, d):
    return search.search_logs(views.logs(spark, d), "Request_ID=r1", ntz(NOW), hours=24, limit=100)


def f1_search_severity(spark, d):
    return search.search_logs(views.logs(spark, d), "host-7", ntz(NOW), hours=24, severity="ERR", limit=50)


def f1_search_literal(spark, d):
    logs = views.logs(spark, d).withColumn(
        "message", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("Disk 95%_full "), "message")).otherwise(F.col("message"))
    )
    return search.search_logs(logs, "5%_FULL", ntz(NOW), hours=24, limit=500)


def _indexed(spark, d):
    """The logs as a stored table with its gram index."""
    root, index = scratch(spark, "events"), scratch(spark, "grams")
    storage.write_events(views.logs(spark, d), root)
    events = spark.read.parquet(root)
    search.index_events(events, index)
    return events, index


def f1_indexed_search(spark, d):
    return search.search_indexed(*_indexed(spark, d), "Request_ID=r1", ntz(NOW), hours=24).drop("dt", "hr")


def f1_indexed_rare(spark, d):
    """A text that few of all files hold."""
    return search.search_indexed(*_indexed(spark, d), "REQUEST_ID=r1234", ntz(NOW), hours=24 * 31, limit=500).drop("dt", "hr")


def f2_search_stats(spark, d):
    return search.search_stats(views.logs(spark, d), "request_id=r1", ntz(NOW), hours=24)


def f3_recent_logs(spark, d):
    return search.recent_logs(views.logs(spark, d), 90, ntz(NOW))


def f5_match_window(spark, d):
    hourly = hours(spark, d)
    end = F.col("hour") + F.expr("INTERVAL 1 HOUR")
    insights = rollup.error_trend(hourly, 24).where("errors > 5").select(
        F.col("hour").alias("window_start"), end.alias("window_end"), "errors"
    )
    reports = hourly.where("dim = 'total'").select(
        F.col("hour").alias("window_start"), end.alias("window_end"), F.col("cnt").alias("total_events")
    )
    return search.match_window(insights, reports)


_SQL = """WITH busy AS (SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS total FROM orders
  WHERE o_orderdate >= :since GROUP BY o_custkey)
SELECT c_mktsegment, n_name, count(*) AS customers, sum(orders) AS orders, round(sum(total), 2) AS total
FROM busy JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE orders >= :least GROUP BY c_mktsegment, n_name"""


def g1_run_query(spark, d):
    import datetime

    names = ("orders", "customer", "nation")
    return sql_surface.run_query(
        spark, _SQL, {"since": datetime.datetime(1995, 1, 1), "least": 2},
        tables={n: views.table(spark, d, n) for n in names},
    )


def g2_describe_tables(spark, d):
    names = ("events", "documents", "nation", "region")
    return sql_surface.describe_tables(spark, {n: views.table(spark, d, n) for n in names}).select(
        "table", "position", "column", "type", "row_count"
    )


def g3_table_stats(spark, d):
    return sql_surface.table_stats(views.logs(spark, d), exact=True)


def _nullable_logs(spark, d):
    return views.logs(spark, d).select(
        "tenant_id", "host", "app", "severity", "facility",
        F.when(F.col("event_id") % 9 != 0, F.col("message")).alias("message"),
    )


def g4_profile_column(spark, d):
    p = sql_surface.profile_column(_nullable_logs(spark, d), "message", exact=True)
    return p.withColumn("null_percent", F.round("null_percent", 6))


def g4_top_values(spark, d):
    return sql_surface.top_values(_nullable_logs(spark, d), "message", 100)


def g4_frequent_values(spark, d):
    found = sql_surface.frequent_values(_nullable_logs(spark, d), ["message"], 100)
    return found.select("value", "count")


def g5_frequent_values(spark, d):
    return sql_surface.frequent_values(_nullable_logs(spark, d), k=10)


def g5_frequent_values_small(spark, d):
    """Summaries too small to prove every column: those are counted in full."""
    return sql_surface.frequent_values(_nullable_logs(spark, d), k=10, tracked=16)


def g5_profile_table(spark, d):
    p = sql_surface.profile_table(_nullable_logs(spark, d), exact=True)
    return p.withColumn("null_percent", F.round("null_percent", 6))


def g5_profile_table_top(spark, d):
    return sql_surface.profile_table_top(_nullable_logs(spark, d), 10)


QUERIES = {f.__name__: f for f in (
    f1_search, f1_search_severity, f1_search_literal, f1_indexed_search, f1_indexed_rare, f2_search_stats, f3_recent_logs, f5_match_window,
    g1_run_query, g2_describe_tables, g3_table_stats, g4_profile_column, g4_top_values,
    g5_profile_table, g5_profile_table_top, g4_frequent_values, g5_frequent_values, g5_frequent_values_small,
)}

_TEXT = "lower(concat(message, ' ', host, ' ', app, ' '))"
_DAY = f"ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{NOW}'"
_NULLABLE = LOGS + """,
nl AS (SELECT tenant_id, host, app, severity, facility, CASE WHEN event_id % 9 <> 0 THEN message END AS message FROM logs),
cells AS (SELECT 'tenant_id' AS "column", tenant_id AS value FROM nl UNION ALL SELECT 'host', host FROM nl
  UNION ALL SELECT 'app', app FROM nl UNION ALL SELECT 'severity', severity FROM nl
  UNION ALL SELECT 'facility', facility FROM nl UNION ALL SELECT 'message', message FROM nl)"""
_PROFILE = """count(DISTINCT value) AS cardinality, count(*) AS total_count, count(*) FILTER (value IS NULL) AS null_count,
  round(count(*) FILTER (value IS NULL) / count(*) * 100, 6) AS null_percent"""

ORACLES = {
    "f1_search": f"""WITH {LOGS} SELECT * FROM logs WHERE {_DAY} AND contains({_TEXT}, 'request_id=r1')
        ORDER BY ts DESC, event_id DESC LIMIT 100""",
    "f1_search_severity": f"""WITH {LOGS} SELECT * FROM logs WHERE {_DAY} AND severity = 'err' AND contains({_TEXT}, 'host-7')
        ORDER BY ts DESC, event_id DESC LIMIT 50""",
    "f1_search_literal": f"""WITH {LOGS} SELECT * REPLACE (concat('Disk 95%_full ', message) AS message) FROM logs
        WHERE {_DAY} AND event_id % 7 = 0 ORDER BY ts DESC, event_id DESC LIMIT 500""",
    "f2_search_stats": f"""WITH {LOGS}, r AS (SELECT ts, contains({_TEXT}, 'request_id=r1') AS hit FROM logs WHERE {_DAY})
        SELECT least(count(*) FILTER (hit), 100) AS total, count(*) FILTER (hit) AS matches,
          count(DISTINCT date_trunc('minute', ts)) AS searched_minutes, 24 AS time_range_hours FROM r""",
    "f3_recent_logs": f"""WITH {LOGS} SELECT * FROM logs WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 90 MINUTE
        ORDER BY ts DESC, event_id DESC LIMIT 500""",
    "f5_match_window": f"""WITH {HSTATS}, t AS (SELECT hour, cnt FROM hstats WHERE dim = 'total' ORDER BY hour DESC LIMIT 24),
        e AS (SELECT hour, cast(sum(cnt) AS BIGINT) AS errors FROM hstats WHERE dim = 'severity'
              AND key IN ('emerg','alert','crit','err','error') GROUP BY hour)
        SELECT hour AS window_start, hour + INTERVAL 1 HOUR AS window_end, errors, cnt AS total_events
        FROM t JOIN e USING (hour) WHERE errors > 5""",
    "g1_run_query": _SQL.replace(":since", "TIMESTAMP '1995-01-01'").replace(":least", "2").replace(
        "sum(orders)", "cast(sum(orders) AS BIGINT)"),
    "g2_describe_tables": """WITH c AS (SELECT table_name AS "table", cast(column_index AS INTEGER) AS position,
          column_name AS "column", CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
          WHEN 'INTEGER' THEN 'int' ELSE lower(data_type) END AS "type" FROM duckdb_columns() WHERE table_name IN ('events', 'documents', 'nation', 'region')),
        n AS (SELECT 'events' AS "table", count(*) AS row_count FROM events UNION ALL SELECT 'documents', count(*) FROM documents
          UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region)
        SELECT "table", position - (SELECT min(position) FROM c) AS position, "column", "type", row_count FROM c JOIN n USING ("table")""",
    "g3_table_stats": f"""WITH {LOGS} SELECT count(*) AS row_count, min(ts) AS min_ts, max(ts) AS max_ts,
        count(DISTINCT tenant_id) AS tenant_count FROM logs""",
    "g4_profile_column": f"""WITH {_NULLABLE} SELECT 'message' AS "column", {_PROFILE} FROM cells WHERE "column" = 'message'""",
    "g4_top_values": f"""WITH {_NULLABLE} SELECT message AS value, count(*) AS count FROM nl WHERE message IS NOT NULL
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""",
    "g5_profile_table": f"""WITH {_NULLABLE} SELECT "column", {_PROFILE} FROM cells GROUP BY 1""",
    "g5_profile_table_top": f"""WITH {_NULLABLE}, v AS (SELECT "column", value, count(*) AS count FROM cells
          WHERE value IS NOT NULL GROUP BY ALL)
        SELECT "column", value, count, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM v
        QUALIFY rank <= 10""",
}

ORACLES["f1_indexed_search"] = ORACLES["f1_search"]
ORACLES["f1_indexed_rare"] = f"""WITH {LOGS} SELECT * FROM logs WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 744 HOUR
    AND ts <= TIMESTAMP '{NOW}' AND contains({_TEXT}, 'request_id=r1234') ORDER BY ts DESC, event_id DESC LIMIT 500"""
ORACLES["g4_frequent_values"] = ORACLES["g4_top_values"]
ORACLES["g5_frequent_values"] = ORACLES["g5_frequent_values_small"] = ORACLES["g5_profile_table_top"]

# Column types as Spark has them.
for _name, _types in {
    "g5_profile_table_top": {'rank': 'INTEGER'},
    "g5_frequent_values": {'rank': 'INTEGER'},
    "g5_frequent_values_small": {'rank': 'INTEGER'},
}.items():
    ORACLES[_name] = typed(ORACLES[_name], **_types)
