"""Checked queries: governance plans, audit log, task boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ntz
from ..operators import governance as g
from ..sources import views

NOW = "2024-01-31 00:00:00"


def m1_plan_expiry(spark, d):
    return g.plan_expiry(views.governance_plans(spark, d), ntz(NOW)).select("plan_id", "status", "just_expired", "updated_at")


def _entries(col):
    return F.array_join(F.transform(F.map_entries(col), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")


def m2_governance_summary(spark, d):
    out = g.governance_summary(views.governance_plans(spark, d), ntz(NOW))
    return out.withColumn("by_status", _entries("by_status")).withColumn("by_classification", _entries("by_classification"))


def m2_governance_issues(spark, d):
    return g.governance_issues(views.governance_plans(spark, d), ntz(NOW))


def m3_audit_tail(spark, d):
    log = views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("entry_id"), F.col("o_orderdate").alias("at"),
        (F.col("o_custkey") % 100).alias("plan_id"), F.col("o_orderstatus").alias("action"),
    )
    return g.audit_tail(log, 7, 50)


def m4_kanban(spark, d):
    return g.kanban(views.tasks(spark, d)).select("board_id", "status", "task_id", "priority", "position")


def m5_timeline(spark, d):
    return g.timeline(views.tasks(spark, d), 3).select("task_id", "title", "status", "start_date", "due_date", "at", "priority_name")


def m6_board_stats(spark, d):
    out = g.board_stats(views.tasks(spark, d), F.lit("1998-01-01").cast("date"))
    for c in ("completion_rate", "total_estimated_hours", "total_actual_hours"):
        out = out.withColumn(c, F.round(c, 3))
    return out


def m6_board_counts(spark, d):
    return g.board_counts(views.tasks(spark, d))


def m7_list_tasks(spark, d):
    return g.list_tasks(views.tasks(spark, d), board=4, status="todo").select("task_id", "priority", "assignee", "updated_at")


def m7_list_plans(spark, d):
    return g.list_plans(views.governance_plans(spark, d), "n3", "approved").select("plan_id", "name", "updated_at")


QUERIES = {f.__name__: f for f in (
    m1_plan_expiry, m2_governance_summary, m2_governance_issues, m3_audit_tail, m4_kanban, m5_timeline,
    m6_board_stats, m6_board_counts, m7_list_tasks, m7_list_plans,
)}

GP = """
gp AS (SELECT c_custkey AS plan_id, concat('n', c_nationkey) AS tenant_id, c_name AS name,
  ['draft', 'pending_review', 'approved', 'approved', 'rejected', 'expired'][c_custkey % 6 + 1] AS status,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'public' WHEN 'BUILDING' THEN 'internal' WHEN 'FURNITURE' THEN 'confidential'
    WHEN 'HOUSEHOLD' THEN 'pii' ELSE 'restricted' END AS classification,
  CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (c_custkey % 90) END AS expires_at,
  TIMESTAMP '2023-06-01' + INTERVAL 1 DAY * (c_custkey % 200) AS updated_at FROM customer)"""
_DUE = f"(status = 'approved' AND coalesce(expires_at < TIMESTAMP '{NOW}', false))"
_SOON = f"(status = 'approved' AND date_diff('day', TIMESTAMP '{NOW}', expires_at) < 30)"
TK = """
tk AS (SELECT o_orderkey AS task_id, o_custkey % 10 AS board_id, concat('order ', o_orderkey) AS title,
  CASE o_orderstatus WHEN 'O' THEN 'todo' WHEN 'P' THEN 'in_progress' ELSE 'done' END AS status,
  cast(left(o_orderpriority, 1) AS INTEGER) AS priority, concat('c', o_custkey % 50) AS assignee,
  CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderdate AS DATE) END AS start_date,
  CASE WHEN o_orderkey % 5 <> 0 THEN cast(o_orderdate AS DATE) + 30 END AS due_date,
  o_totalprice / 1000 AS estimated_hours, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 800 END AS actual_hours,
  o_orderdate AS updated_at FROM orders)"""
_PNAME = "CASE priority WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'low' {e} END"

ORACLES = {
    "m1_plan_expiry": f"""WITH {GP} SELECT plan_id, CASE WHEN {_DUE} THEN 'expired' ELSE status END AS status, {_DUE} AS just_expired,
        CASE WHEN {_DUE} THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM gp""",
    "m2_governance_summary": f"""WITH {GP}, s AS (SELECT tenant_id, string_agg(concat(status, ':', n), ',' ORDER BY status) AS by_status
          FROM (SELECT tenant_id, status, count(*) AS n FROM gp GROUP BY 1, 2) GROUP BY 1),
        c AS (SELECT tenant_id, string_agg(concat(classification, ':', n), ',' ORDER BY classification) AS by_classification
          FROM (SELECT tenant_id, classification, count(*) AS n FROM gp GROUP BY 1, 2) GROUP BY 1),
        t AS (SELECT tenant_id, count(*) AS total_plans, count(*) FILTER (status = 'expired') AS expired,
          count(*) FILTER ({_SOON}) AS expiring FROM gp GROUP BY 1)
        SELECT *, expired + expiring = 0 AS compliant FROM t JOIN s USING (tenant_id) JOIN c USING (tenant_id)""",
    "m2_governance_issues": f"""WITH {GP} SELECT tenant_id, plan_id, CASE WHEN status = 'expired' THEN concat('Plan ''', name, ''' has expired')
        ELSE concat('Plan ''', name, ''' expires in ', date_diff('day', TIMESTAMP '{NOW}', expires_at), ' days') END AS issue
        FROM gp WHERE status = 'expired' OR {_SOON}""",
    "m3_audit_tail": """SELECT o_orderkey AS entry_id, o_orderdate AS "at", o_custkey % 100 AS plan_id, o_orderstatus AS action FROM orders
        WHERE o_custkey % 100 = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""",
    "m4_kanban": f"""WITH {TK} SELECT board_id, status, task_id, priority,
        row_number() OVER (PARTITION BY board_id, status ORDER BY priority, task_id) - 1 AS position FROM tk""",
    "m5_timeline": f"""WITH {TK} SELECT task_id, title, status, start_date, due_date, coalesce(start_date, due_date) AS at,
        {_PNAME.format(e='')} AS priority_name FROM tk WHERE board_id = 3 AND coalesce(start_date, due_date) IS NOT NULL""",
    "m6_board_stats": f"""WITH {TK} SELECT board_id, count(*) AS total_tasks,
        round(count(*) FILTER (status = 'done') / count(*) * 100, 3) AS completion_rate,
        count(*) FILTER (due_date < DATE '1998-01-01' AND status NOT IN ('done', 'cancelled')) AS overdue_count,
        round(sum(estimated_hours), 3) AS total_estimated_hours, round(coalesce(sum(actual_hours), 0), 3) AS total_actual_hours
        FROM tk GROUP BY 1""",
    "m6_board_counts": f"""WITH {TK} SELECT board_id, 'status' AS dim, status AS key, count(*) AS cnt FROM tk GROUP BY ALL
        UNION ALL SELECT board_id, 'priority', {_PNAME.format(e="ELSE 'other'")}, count(*) FROM tk GROUP BY ALL
        UNION ALL SELECT board_id, 'assignee', assignee, count(*) FROM tk GROUP BY ALL""",
    "m7_list_tasks": f"WITH {TK} SELECT task_id, priority, assignee, updated_at FROM tk WHERE board_id = 4 AND status = 'todo'",
    "m7_list_plans": f"WITH {GP} SELECT plan_id, name, updated_at FROM gp WHERE tenant_id = 'n3' AND status = 'approved'",
}
