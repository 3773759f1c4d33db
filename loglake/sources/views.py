"""Views over the given tables: logs, process events, tasks and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PRI_SEVERITIES
from ..functions.columns import bucket_of, case_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def logs_from_events(events: DataFrame) -> DataFrame:
    """Product events as log events (batch or stream)."""
    user, eid = F.col("user_id"), F.col("event_id")
    severity = (
        F.when((F.col("event_type") == "error") & (F.col("value") >= 100), "crit")
        .when(F.col("event_type") == "error", "err")
        .when(F.col("event_type") == "signup", "warn")
        .when(F.col("event_type") == "purchase", "notice")
        .otherwise("info")
    )
    return events.select(
        "event_id",
        "ts",
        F.concat(F.lit("t"), user % 4).alias("tenant_id"),
        F.concat(F.lit("host-"), user % 20).alias("host"),
        F.col("event_type").alias("app"),
        severity.alias("severity"),
        (user % 24).cast("string").alias("facility"),
        F.concat(
            "event_type", F.lit(" request_id=r"), user, F.lit(" from 10.0."), user % 256,
            F.lit("."), eid % 256, F.lit(" props "), "props",
        ).alias("message"),
        F.when(eid % 2 == 0, "udp").otherwise("tcp").alias("transport"),
    )


def with_raw(logs: DataFrame) -> DataFrame:
    """The syslog line each log event would have arrived as."""
    code = case_of(F.col("severity"), {s: i for i, s in enumerate(PRI_SEVERITIES)}, 6)
    return logs.withColumn(
        "raw",
        F.concat(
            F.lit("<"), F.col("facility").cast("int") * 8 + code, F.lit(">"),
            F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" "), "host", F.lit(" "),
            "app", F.lit(": "), "message",
        ),
    )


def logs(spark: SparkSession, folder: str) -> DataFrame:
    return logs_from_events(table(spark, folder, "events"))


def process_events(spark: SparkSession, folder: str) -> DataFrame:
    ev = table(spark, folder, "events")
    return ev.select(
        F.concat(F.lit("t"), F.col("user_id") % 4).alias("tenant_id"),
        F.concat("user_id", F.lit("-"), F.to_date("ts")).alias("case_id"),
        F.col("event_type").alias("activity"),
        "ts",
        "event_id",
        F.concat(F.lit("host-"), F.col("user_id") % 20).alias("resource"),
    )


def metric_points(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly event counts per event type."""
    ev = table(spark, folder, "events")
    return ev.groupBy(
        F.col("event_type").alias("series"), bucket_of(F.col("ts"), "hour").alias("ts")
    ).agg(F.count(F.lit(1)).cast("double").alias("value"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    od = table(spark, folder, "orders")
    return od.select(
        F.col("o_orderkey").alias("task_id"),
        (F.col("o_custkey") % 10).alias("board_id"),
        F.concat(F.lit("order "), "o_orderkey").alias("title"),
        F.when(F.col("o_orderstatus") == "O", "todo")
        .when(F.col("o_orderstatus") == "P", "in_progress")
        .otherwise("done").alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("assignee"),
        F.when(F.col("o_orderkey") % 3 == 0, F.to_date("o_orderdate")).alias("start_date"),
        F.when(F.col("o_orderkey") % 5 != 0, F.date_add(F.to_date("o_orderdate"), 30)).alias("due_date"),
        (F.col("o_totalprice") / 1000).alias("estimated_hours"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 800).alias("actual_hours"),
        F.col("o_orderdate").alias("updated_at"),
    )


def governance_plans(spark: SparkSession, folder: str) -> DataFrame:
    cu = table(spark, folder, "customer")
    key = F.col("c_custkey")
    return cu.select(
        key.alias("plan_id"),
        F.concat(F.lit("n"), "c_nationkey").alias("tenant_id"),
        F.col("c_name").alias("name"),
        F.element_at(
            F.array(*[F.lit(s) for s in
                      ("draft", "pending_review", "approved", "approved", "rejected", "expired")]),
            (key % 6 + 1).cast("int"),
        ).alias("status"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "public")
        .when(F.col("c_mktsegment") == "BUILDING", "internal")
        .when(F.col("c_mktsegment") == "FURNITURE", "confidential")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "pii")
        .otherwise("restricted").alias("classification"),
        F.when(
            key % 7 != 0,
            F.lit("2024-01-01").cast("date") + (key % 90).cast("int"),
        ).cast("timestamp_ntz").alias("expires_at"),
        (F.lit("2023-06-01").cast("date") + (key % 200).cast("int")).cast("timestamp_ntz").alias("updated_at"),
    )


def projects(logs_df: DataFrame) -> DataFrame:
    """One project per tenant seen in the logs, with plan, status and custom quota."""
    tid = F.col("tenant_id")
    return logs_df.select("tenant_id").distinct().select(
        tid.alias("project_id"),
        F.concat(F.lit("Project "), tid).alias("name"),
        F.when(tid == "t0", "starter").when(tid == "t1", "professional")
        .when(tid == "t2", "business").otherwise("starter").alias("plan_id"),
        F.when(tid == "t3", "suspended").otherwise("active").alias("status"),
        F.when(tid == "t2", F.lit(90).cast("long")).alias("custom_quota_per_day"),
    )


def plans(spark: SparkSession, limits: dict[str, int] | None = None) -> DataFrame:
    """The plan table; `limits` overrides daily limits per plan id."""
    from ..schemas import PLANS

    limits = limits or {}
    rows = [(i, n, p, limits.get(i, d), m, r) for i, n, p, d, m, r in PLANS]
    return spark.createDataFrame(
        rows,
        "plan_id string, plan_name string, price_monthly double, "
        "events_per_day_limit long, events_per_month_limit long, retention_days int",
    )
