"""Usage, quotas and billing per project (tenant)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket_of, in_zone
from ..functions.skew import with_group_index
from ..session import stored

USAGE_ERRORS = ["err", "crit"]
HOST_BITS = 14
HOST_ERROR = 6 * 1.04 / 2 ** (HOST_BITS / 2)  # six standard errors of a host sketch, as a share
MB = 1024 * 1024


def hourly_usage(events: DataFrame, project: str = "tenant_id", errors=tuple(USAGE_ERRORS)) -> DataFrame:
    """`(project_id, timestamp_hour, event_count, error_count, unique_hosts, data_size_bytes)`.

    Bytes are those of the messages.
    """
    return events.groupBy(
        F.col(project).alias("project_id"), bucket_of(F.col("ts"), "hour").alias("timestamp_hour")
    ).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("severity").isin(list(errors))).alias("error_count"),
        F.count_distinct("host").alias("unique_hosts"),
        F.coalesce(F.sum(F.octet_length("message")), F.lit(0)).cast("long").alias("data_size_bytes"),
    )


def hourly_usage_mergeable(events: DataFrame, project: str = "tenant_id", errors=tuple(USAGE_ERRORS)) -> DataFrame:
    """As `hourly_usage`, with the hosts as a sketch `hosts` that can be merged and `unique_hosts` estimated from it.

    Nothing but the sketches, 16 kilobytes each at most, is shuffled, and
    sketches of hours add up to days and months without a look at the events.
    Estimates are within `HOST_ERROR` (4.9 %) of the exact number but for one
    in some hundred million, and exact for a handful of hosts.
    """
    return events.groupBy(
        F.col(project).alias("project_id"), bucket_of(F.col("ts"), "hour").alias("timestamp_hour")
    ).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("severity").isin(list(errors))).alias("error_count"),
        F.hll_sketch_agg("host", HOST_BITS).alias("hosts"),
        F.coalesce(F.sum(F.octet_length("message")), F.lit(0)).cast("long").alias("data_size_bytes"),
    ).withColumn("unique_hosts", F.hll_sketch_estimate("hosts"))


def merge_usage_hosts(old: DataFrame, delta: DataFrame, mode: str = "add") -> DataFrame:
    """`merge_usage` of mergeable rows: `add` unites the hosts of both, `replace` takes the new ones."""
    keys = ["project_id", "timestamp_hour"]
    counts = merge_usage(old.drop("unique_hosts"), delta.drop("unique_hosts"), mode)
    rows = old.select(*keys, "hosts")
    if mode == "replace":
        rows = rows.join(delta.select(*keys), keys, "left_anti")
    hosts = rows.unionByName(delta.select(*keys, "hosts")).groupBy(*keys).agg(F.hll_union_agg("hosts").alias("hosts"))
    return counts.join(hosts, keys).withColumn("unique_hosts", F.hll_sketch_estimate("hosts"))


def hosts_per(rows: DataFrame, unit: str, tz: str = "UTC") -> DataFrame:
    """`(project_id, <unit>, event_count, error_count, hosts, unique_hosts)` per day, month and so on.

    `rows` are mergeable rows of hours, or of this function for a smaller unit.
    """
    at = "timestamp_hour" if "timestamp_hour" in rows.columns else "day"
    local = in_zone(F.col(at), tz) if at == "timestamp_hour" else F.col(at)
    return rows.groupBy("project_id", bucket_of(local, unit).alias(unit)).agg(
        F.sum("event_count").alias("event_count"), F.sum("error_count").alias("error_count"),
        F.hll_union_agg("hosts").alias("hosts"),
    ).withColumn("unique_hosts", F.hll_sketch_estimate("hosts"))


def merge_usage(old: DataFrame, delta: DataFrame, mode: str = "add") -> DataFrame:
    """New hourly counts into the stored ones: `add` for live counts, `replace` for a backfill.

    From numbers alone added hosts cannot be told apart from known ones, so
    `unique_hosts` keeps the larger one there; `merge_usage_hosts` unites them.
    """
    if mode not in ("add", "replace"):
        raise ValueError(f"unknown mode {mode!r}")
    keys = ["project_id", "timestamp_hour"]
    counts = [c for c in ("event_count", "error_count", "unique_hosts", "data_size_bytes") if c in old.columns and c in delta.columns]
    new = delta.select(*keys, *[F.col(c).alias(f"_{c}") for c in counts])

    def merged(c):
        if mode == "replace":
            return F.coalesce(F.col(f"_{c}"), F.col(c))
        if c == "unique_hosts":
            return F.greatest(c, f"_{c}")
        return F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_{c}"), F.lit(0))

    return old.select(*keys, *counts).join(new, keys, "full_outer").select(
        *keys, *[merged(c).alias(c) for c in counts]
    )


def daily_usage(hourly: DataFrame, tz: str = "UTC") -> DataFrame:
    """`(project_id, date, event_count, error_count, peak_events_per_hour[, total_data_size_bytes])`."""
    size = [F.sum("data_size_bytes").alias("total_data_size_bytes")] if "data_size_bytes" in hourly.columns else []
    return hourly.groupBy(
        "project_id", bucket_of(in_zone(F.col("timestamp_hour"), tz), "day").alias("date")
    ).agg(
        F.sum("event_count").alias("event_count"), F.sum("error_count").alias("error_count"),
        F.max("event_count").alias("peak_events_per_hour"), *size,
    )


def with_storage(daily: DataFrame) -> DataFrame:
    """Add `storage_bytes`, the bytes received up to each day; one row per project and day."""
    so_far = Window.partitionBy("project_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("storage_bytes", F.sum("total_data_size_bytes").over(so_far))


def usage_history(df: DataFrame, project: str, since: Column) -> DataFrame:
    """Hourly or daily rows of a project from `since` on, in time order."""
    at = "timestamp_hour" if "timestamp_hour" in df.columns else "date"
    return df.where((F.col("project_id") == project) & (F.col(at) >= since)).orderBy(at)


def usage_range(df: DataFrame, project: str, start: Column, end: Column) -> DataFrame:
    """One row: events of a project between two times, both included."""
    at = "timestamp_hour" if "timestamp_hour" in df.columns else "date"
    return (
        df.where((F.col("project_id") == project) & (F.col(at) >= start) & (F.col(at) <= end))
        .agg(F.coalesce(F.sum("event_count"), F.lit(0)).alias("event_count"))
    )


def current_usage(hourly: DataFrame, now: Column, tz: str = "UTC") -> DataFrame:
    """Events of the current hour and day per project."""
    local_now, local = in_zone(now, tz), in_zone(F.col("timestamp_hour"), tz)
    today = bucket_of(local_now, "day")
    return (
        hourly.where((local >= today) & (local <= local_now))
        .groupBy("project_id")
        .agg(
            F.coalesce(
                F.sum(F.when(local == bucket_of(local_now, "hour"), F.col("event_count"))), F.lit(0)
            ).alias("current_hour"),
            F.sum("event_count").alias("current_day"),
        )
    )


def bucket_usage(files: DataFrame, totals: DataFrame, unit: str = "hour") -> DataFrame:
    """Events and bytes per hour or day from bucket files `(bucket, size, lines)`.

    The rollup total of a bucket `(bucket, total)` is preferred to its number
    of lines, since stored lines are already de-duplicated.
    """
    per_file = files.join(totals.select("bucket", "total"), "bucket", "left")
    return per_file.groupBy(bucket_of(F.col("bucket"), unit).alias(unit)).agg(
        F.sum(F.coalesce("total", "lines")).alias("events"), F.sum("size").alias("bytes"),
    )


def last_event_at(hourly: DataFrame) -> DataFrame:
    return hourly.where("event_count > 0").groupBy("project_id").agg(
        F.max("timestamp_hour").alias("last_event_at")
    )


# --- quotas -----------------------------------------------------------------


def _with_limits(projects: DataFrame, plans: DataFrame) -> DataFrame:
    """Projects with plan columns and the effective daily limit: custom quota, else plan."""
    return projects.join(plans, "plan_id", "left").withColumn(
        "daily_limit", F.coalesce("custom_quota_per_day", "events_per_day_limit")
    )


def _day_counts(daily: DataFrame, day: Column) -> DataFrame:
    return daily.where(F.col("date") == day).select("project_id", F.col("event_count").alias("usage_count"))


def _percent(usage: Column, limit: Column) -> Column:
    return F.when(limit > 0, usage / limit * 100).otherwise(0.0)


def _colour(percent: Column) -> Column:
    return (
        F.when(percent >= 100, "red").when(percent >= 90, "orange")
        .when(percent >= 80, "yellow").otherwise("green")
    )


def _judged(p: DataFrame) -> DataFrame:
    """Percent, colour and flags from status, daily_limit and usage_count."""
    active = F.col("status") == "active"
    p = p.withColumn(
        "usage_count", F.when(active, F.coalesce("usage_count", F.lit(0))).otherwise(0)
    ).withColumn(
        "daily_limit", F.when(active, F.col("daily_limit")).otherwise(0)
    ).withColumn(
        "usage_percent",
        F.when(active, _percent(F.col("usage_count"), F.col("daily_limit"))).otherwise(100.0),
    ).withColumn("quota_status", F.when(active, _colour(F.col("usage_percent"))).otherwise("red"))
    keys = ["project_id"] + (["date"] if "date" in p.columns else [])
    return p.select(
        *keys, "quota_status", "usage_count", F.col("daily_limit").alias("limit"), "usage_percent",
        (F.col("usage_percent") >= 100).alias("exceeded"),
        (active & (F.col("quota_status") == "yellow")).alias("should_warn"),
        (active & F.col("quota_status").isin("orange", "red")).alias("should_alert"),
    )


def quota_status(daily: DataFrame, projects: DataFrame, plans: DataFrame, day: Column) -> DataFrame:
    """Quota colour and flags per project on a day; projects that are not active are red."""
    return _judged(
        _with_limits(projects, plans).where("daily_limit IS NOT NULL")
        .join(_day_counts(daily, day), "project_id", "left")
    )


def quota_by_day(daily: DataFrame, projects: DataFrame, plans: DataFrame) -> DataFrame:
    """The same for every day that has usage: `(project_id, date, ...)`."""
    counts = daily.select("project_id", "date", F.col("event_count").alias("usage_count"))
    return _judged(
        counts.join(_with_limits(projects, plans).where("daily_limit IS NOT NULL"), "project_id")
    )


def quota_actions(daily: DataFrame, projects: DataFrame, plans: DataFrame, day: Column) -> DataFrame:
    """Projects to suspend (active, at the limit) or to resume (suspended, below it)."""
    p = _with_limits(projects, plans).where("daily_limit IS NOT NULL").join(
        _day_counts(daily, day), "project_id", "left"
    ).withColumn("usage_count", F.coalesce("usage_count", F.lit(0)))
    over = F.col("usage_count") >= F.col("daily_limit")
    action = F.when((F.col("status") == "active") & over, "suspend").when(
        (F.col("status") == "suspended") & ~over, "resume"
    )
    return p.withColumn("action", action).where("action IS NOT NULL").select(
        "project_id", "action", "usage_count", F.col("daily_limit").alias("limit")
    )


def admit_events(events: DataFrame, limits: DataFrame, project: str = "tenant_id") -> DataFrame:
    """Add `admitted`: the first events of each project and day, up to `(project, limit)`.

    Only days over their limit need numbering; there the events are numbered
    over many tasks, as one project may send most of them.
    """
    ev = events.withColumn("_day", F.to_date("ts"))
    lim = limits.select(F.col("project_id").alias(project), F.col("limit").alias("_limit"))
    over = (
        ev.groupBy(project, "_day").agg(F.count(F.lit(1)).alias("_n"))
        .join(lim, project).where("_n > _limit").select(project, "_day", "_limit")
    )
    # Written once: it is used three times, and its size is then known to the join.
    over = stored(over, "over_limit")
    if over.isEmpty():
        return events.withColumn("admitted", F.lit(True))
    marked = ev.join(over, [project, "_day"], "left")
    within = marked.where("_limit IS NULL").select(*events.columns, F.lit(True).alias("admitted"))
    numbered = with_group_index(
        marked.where("_limit IS NOT NULL"), [project, "_day"], [F.col("ts"), F.col("event_id")], "_idx"
    )
    return within.unionByName(
        numbered.select(*events.columns, (F.col("_idx") < F.col("_limit")).alias("admitted"))
    )


# --- overviews --------------------------------------------------------------


def projects_view(
    projects: DataFrame, plans: DataFrame, hourly: DataFrame, daily: DataFrame, now: Column, tz: str = "UTC"
) -> DataFrame:
    """Projects with plan, usage, quota colour, storage and last activity."""
    today = bucket_of(in_zone(now, tz), "day")
    storage = (
        daily.where(F.col("date") >= today - F.expr("INTERVAL 2 DAYS"))
        .groupBy("project_id").agg((F.max_by("storage_bytes", "date") / MB).alias("storage_mb"))
    )
    usage = current_usage(hourly, now, tz)
    out = (
        _with_limits(projects, plans)
        .join(usage, "project_id", "left")
        .join(storage, "project_id", "left")
        .join(last_event_at(hourly), "project_id", "left")
        .withColumn("current_day_events", F.coalesce("current_day", F.lit(0)))
        .withColumn("current_hour_events", F.coalesce("current_hour", F.lit(0)))
        .withColumn("daily_limit", F.coalesce("daily_limit", F.lit(0)))
    ).withColumn("usage_percent", _percent(F.col("current_day_events"), F.col("daily_limit")))
    return out.select(
        "project_id", "name", "plan_id", F.coalesce("plan_name", F.lit("N/A")).alias("plan_name"), "status",
        "current_day_events", "current_hour_events", "daily_limit", "usage_percent",
        _colour(F.col("usage_percent")).alias("quota_status"),
        F.coalesce("storage_mb", F.lit(0.0)).alias("storage_mb"), "last_event_at",
    )


def overview(projects: DataFrame, plans: DataFrame, daily: DataFrame, now: Column) -> DataFrame:
    """One row: projects by status, events today and this month, monthly revenue of active projects."""
    active = F.col("status") == "active"
    p = projects.join(plans, "plan_id", "left").agg(
        F.count(F.lit(1)).alias("total_projects"), F.count_if(active).alias("active_projects"),
        F.count_if(F.col("status") == "suspended").alias("suspended_projects"),
        F.coalesce(F.sum(F.when(active, F.col("price_monthly"))), F.lit(0.0)).alias("monthly_recurring_revenue"),
    )
    today, month = bucket_of(now, "day"), bucket_of(now, "month")
    u = daily.where(F.col("date") >= month).agg(
        F.coalesce(F.sum(F.when(F.col("date") == today, F.col("event_count"))), F.lit(0)).alias("events_today"),
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("events_this_month"),
    )
    one = F.lit(1).alias("_one")
    return p.select("*", one).join(u.select("*", one), "_one").drop("_one")


def fleet_summary(view: DataFrame) -> DataFrame:
    """One row over the projects view."""
    return view.agg(
        F.coalesce(F.sum("current_day_events"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("daily_limit"), F.lit(0)).alias("total_limit"),
        F.coalesce(F.sum("storage_mb"), F.lit(0.0)).alias("total_storage_mb"),
        F.coalesce(F.avg("usage_percent"), F.lit(0.0)).alias("mean_usage_percent"),
        F.count_if(F.col("status") == "active").alias("active_projects"),
        F.count_if(F.col("status") == "suspended").alias("suspended_projects"),
    )


def fleet_top(view: DataFrame, k: int = 5) -> DataFrame:
    """Projects with the most events today."""
    return view.orderBy(F.desc("current_day_events"), "project_id").limit(k).select(
        "project_id", "current_day_events", "usage_percent"
    )


def invoices(
    projects: DataFrame, plans: DataFrame, daily: DataFrame, rate_per_event: float = 0.0
) -> DataFrame:
    """Base price and overage per project and month."""
    month = bucket_of(F.col("date"), "month")
    used = daily.groupBy("project_id", month.alias("period_start")).agg(F.sum("event_count").alias("events"))
    limit = F.col("events_per_month_limit")
    if "custom_quota_per_month" in projects.columns:
        limit = F.coalesce("custom_quota_per_month", limit)
    over = F.greatest(F.col("events") - limit, F.lit(0))
    return (
        used.join(projects, "project_id").join(plans, "plan_id")
        .withColumn("overage_events", over)
        .withColumn("overage_charge", F.col("overage_events") * F.lit(float(rate_per_event)))
        .select(
            F.concat(F.lit("invoice_"), F.date_format("period_start", "yyyyMM"), F.lit("_"), "project_id").alias("invoice_id"),
            "project_id", "period_start", F.add_months("period_start", 1).cast("timestamp_ntz").alias("period_end"),
            F.col("price_monthly").alias("base_amount"), "overage_events", "overage_charge",
            (F.col("price_monthly") + F.col("overage_charge")).alias("total_amount"),
            F.lit("pending").alias("status"),
        )
    )
