"""Governance plans, audit log, task boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import case_of
from ..functions.skew import with_group_index

# Fixed board columns and priority names.
BOARD_COLUMNS = ["backlog", "todo", "in_progress", "in_review", "blocked", "done", "cancelled"]
PRIORITIES = {1: "critical", 2: "high", 3: "medium", 4: "low"}
CLOSED = ["done", "cancelled"]


def plan_expiry(plans: DataFrame, now: Column) -> DataFrame:
    """Approved plans past their date become expired; `just_expired` marks them."""
    due = (F.col("status") == "approved") & F.coalesce(F.col("expires_at") < now, F.lit(False))
    return (
        plans.withColumn("just_expired", due)
        .withColumn("updated_at", F.when(due, now).otherwise(F.col("updated_at")))
        .withColumn("status", F.when(due, "expired").otherwise(F.col("status")))
    )


def _days_left(now: Column) -> Column:
    micros = F.unix_micros(F.col("expires_at").cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000))


def governance_issues(plans: DataFrame, now: Column) -> DataFrame:
    """One row per issue: plans expired or about to."""
    days = _days_left(now)
    text = F.when(
        F.col("status") == "expired", F.concat(F.lit("Plan '"), "name", F.lit("' has expired"))
    ).when(
        (F.col("status") == "approved") & (days < 30),
        F.concat(F.lit("Plan '"), "name", F.lit("' expires in "), days.cast("string"), F.lit(" days")),
    )
    return plans.select("tenant_id", "plan_id", text.alias("issue")).where("issue IS NOT NULL")


def governance_summary(plans: DataFrame, now: Column) -> DataFrame:
    """Per tenant: plans, plans by status and classification, issues, compliance.

    Status and classification come from small fixed sets, so the maps stay small.
    """
    counts = plans.groupBy("tenant_id", "status", "classification").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "expired").alias("expired"),
        F.count_if((F.col("status") == "approved") & (_days_left(now) < 30)).alias("expiring"),
    )

    def by(col):
        per = F.aggregate(
            F.collect_list(F.struct(F.col(col).alias("k"), F.col("n").alias("n"))),
            F.create_map().cast("map<string,bigint>"),
            lambda m, x: F.map_concat(
                F.map_filter(m, lambda k, v: k != x["k"]),
                F.create_map(x["k"], F.coalesce(F.try_element_at(m, x["k"]), F.lit(0).cast("bigint")) + x["n"]),
            ),
        )
        return F.map_from_entries(F.array_sort(F.map_entries(per)))

    out = counts.groupBy("tenant_id").agg(
        F.sum("n").alias("total_plans"), by("status").alias("by_status"),
        by("classification").alias("by_classification"),
        F.sum("expired").alias("expired"), F.sum("expiring").alias("expiring"),
    )
    return out.withColumn("compliant", F.col("expired") + F.col("expiring") == 0)


def list_plans(plans: DataFrame, tenant: str | None = None, status: str | None = None) -> DataFrame:
    if tenant:
        plans = plans.where(F.col("tenant_id") == tenant)
    if status:
        plans = plans.where(F.col("status") == status)
    return plans.orderBy(F.desc("updated_at"), "plan_id")


def audit_tail(log: DataFrame, plan_id=None, n: int = 100) -> DataFrame:
    """Newest n audit entries, oldest of them first."""
    if plan_id is not None:
        log = log.where(F.col("plan_id") == plan_id)
    return log.orderBy(F.desc("at"), F.desc("entry_id")).limit(n).orderBy("at", "entry_id")


def kanban(tasks: DataFrame) -> DataFrame:
    """Place of every task in its board column, by priority.

    Numbered over many tasks of the cluster: one board may hold most cards.
    """
    cards = tasks.where(F.col("status").isin(BOARD_COLUMNS))
    return with_group_index(
        cards, ["board_id", "status"], [F.col("priority"), F.col("task_id")], "position"
    )


def timeline(tasks: DataFrame, board: int | None = None) -> DataFrame:
    """Tasks with a date, by start, else due date."""
    if board is not None:
        tasks = tasks.where(F.col("board_id") == board)
    at = F.coalesce("start_date", "due_date")
    return (
        tasks.where(at.isNotNull()).withColumn("at", at)
        .withColumn("priority_name", case_of(F.col("priority"), PRIORITIES, F.lit(None).cast("string")))
        .orderBy("board_id", "at", "task_id")
    )


def board_stats(tasks: DataFrame, today: Column) -> DataFrame:
    """One row per board: tasks, completion, overdue, hours."""
    overdue = (F.col("due_date") < today) & ~F.col("status").isin(CLOSED)
    return tasks.groupBy("board_id").agg(
        F.count(F.lit(1)).alias("total_tasks"),
        (F.count_if(F.col("status") == "done") / F.count(F.lit(1)) * 100).alias("completion_rate"),
        F.count_if(overdue).alias("overdue_count"),
        F.coalesce(F.sum("estimated_hours"), F.lit(0.0)).alias("total_estimated_hours"),
        F.coalesce(F.sum("actual_hours"), F.lit(0.0)).alias("total_actual_hours"),
    )


def board_counts(tasks: DataFrame) -> DataFrame:
    """Tasks by status, priority and assignee: `(board_id, dim, key, cnt)`, one pass by grouping sets."""
    named = tasks.select(
        "board_id", "status",
        case_of(F.col("priority"), PRIORITIES, F.lit("other")).alias("priority"), "assignee",
    )
    cols = [F.col(c) for c in ("board_id", "status", "priority", "assignee")]
    b = cols[0]
    g = named.groupingSets([[b, c] for c in cols[1:]], *cols).agg(
        F.count(F.lit(1)).alias("cnt"), F.grouping("status").alias("gs"), F.grouping("priority").alias("gp"),
    )
    dim = F.when(F.col("gs") == 0, "status").when(F.col("gp") == 0, "priority").otherwise("assignee")
    key = F.when(F.col("gs") == 0, F.col("status")).when(F.col("gp") == 0, F.col("priority")).otherwise(F.col("assignee"))
    return g.select("board_id", dim.alias("dim"), key.alias("key"), "cnt").where("length(key) > 0")


def list_tasks(
    tasks: DataFrame, board: int | None = None, status: str | None = None, assignee: str | None = None
) -> DataFrame:
    """Filtered tasks, by priority number and update time, both descending."""
    for column, value in (("board_id", board), ("status", status), ("assignee", assignee)):
        if value is not None:
            tasks = tasks.where(F.col(column) == value)
    return tasks.orderBy(F.desc("priority"), F.desc("updated_at"), "task_id")
