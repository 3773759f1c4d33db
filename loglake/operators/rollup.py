"""Minute, hour and day rollups, highlights, dashboards.

Counts are kept long: one row per (window, dim, key).  The dims are
`severity`, `host`, `app`, `host_app`, `pattern`, and the two totals `total`
and `unique`, whose key is empty.  Everything above the minute reads only
these small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket_of, case_of, filled, in_zone, top_k
from ..functions.text import display_message
from ..schemas import (
    ANALYSIS_LEVELS, CHART_ERRORS, DAILY_ERRORS, DEFAULT_LEVELS, HIGHLIGHT_PRIORITY,
    HIGHLIGHT_PRIORITY_DEFAULT, ISSUE_PRIORITY, ISSUE_PRIORITY_DEFAULT, KPI_ERRORS,
    PRI_SEVERITIES,
)
from .dedupe import event_order

TOP_DIMS = ["severity", "host", "app", "host_app"]


def priority(severity: Column) -> Column:
    return case_of(F.lower(severity), HIGHLIGHT_PRIORITY, HIGHLIGHT_PRIORITY_DEFAULT)


# --- minute -----------------------------------------------------------------


def event_facts(events: DataFrame, bucket: str = "minute", tz: str = "UTC") -> DataFrame:
    """Counts per (bucket, pattern, severity, host, app): the one pass over the events."""
    return events.groupBy(
        bucket_of(in_zone(F.col("ts"), tz), bucket).alias("bucket"),
        "pattern_id",
        "severity",
        filled(F.col("host"), "unknown").alias("host"),
        filled(F.col("app"), "-").alias("app"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _long_counts(facts: DataFrame, host_apps: bool = True) -> DataFrame:
    """Facts `(bucket, severity, host, app, pattern_id, n, u)` to long counts by grouping sets."""
    sets = [["bucket", "severity"], ["bucket", "host"], ["bucket", "app"],
            ["bucket", "pattern_id"], ["bucket"]]
    if host_apps:
        sets.append(["bucket", "host", "app"])
    cols = [F.col(c) for c in ("bucket", "severity", "host", "app", "pattern_id")]
    g = facts.groupingSets(
        [[F.col(c) for c in s] for s in sets], *cols
    ).agg(
        F.sum("n").alias("cnt"),
        F.sum("u").alias("u"),
        F.grouping("severity").alias("gs"), F.grouping("host").alias("gh"),
        F.grouping("app").alias("ga"), F.grouping("pattern_id").alias("gp"),
    )
    dim = (
        F.when(F.col("gp") == 0, "pattern").when(F.col("gs") == 0, "severity")
        .when((F.col("gh") == 0) & (F.col("ga") == 0), "host_app")
        .when(F.col("gh") == 0, "host").when(F.col("ga") == 0, "app").otherwise("total")
    )
    key = (
        F.when(F.col("gp") == 0, F.col("pattern_id")).when(F.col("gs") == 0, F.col("severity"))
        .when((F.col("gh") == 0) & (F.col("ga") == 0), F.concat("host", F.lit("/"), "app"))
        .when(F.col("gh") == 0, F.col("host")).when(F.col("ga") == 0, F.col("app"))
        .otherwise("")
    )
    return g.select("bucket", dim.alias("dim"), key.alias("key"), "cnt", "u")


def minute_stats(events: DataFrame, tz: str = "UTC", bucket: str = "minute") -> DataFrame:
    """Counts per minute by severity, host, app, host/app, pattern; total and unique."""
    facts = event_facts(events, bucket, tz).withColumn("u", F.lit(0).cast("long"))
    counts = _long_counts(facts).drop("u")
    # Each pattern row also adds one to `unique`, so the events are read once;
    # a union with a count of its own would read them twice, as Spark prunes
    # the two branches to different columns and reuses no exchange.
    row = F.struct("dim", "key", "cnt")
    one = F.struct(F.lit("unique").alias("dim"), F.lit("").alias("key"), F.lit(1).cast("long").alias("cnt"))
    both = F.when(F.col("dim") == "pattern", F.array(row, one)).otherwise(F.array(row))
    return (
        counts.select("bucket", F.explode(both).alias("r"))
        .groupBy("bucket", F.col("r.dim").alias("dim"), F.col("r.key").alias("key"))
        .agg(F.sum("r.cnt").alias("cnt"))
    )


def rebuild_minute_stats(stored: DataFrame) -> DataFrame:
    """Rollup of stored events; each row counts for its `occurrences` (none or 0 is 1).

    `unique` is the number of stored rows, and there is no host/app dim.
    """
    weight = F.coalesce(F.nullif(F.col("occurrences"), F.lit(0).cast("long")), F.lit(1).cast("long"))
    facts = stored.groupBy(
        "bucket",
        F.coalesce("severity", F.lit("info")).alias("severity"),
        F.coalesce("host", F.lit("unknown")).alias("host"),
        F.coalesce("app", F.lit("-")).alias("app"),
        filled(F.col("pattern_id"), "unknown").alias("pattern_id"),
    ).agg(F.sum(weight).alias("n"), F.count(F.lit(1)).alias("u"))
    counts = _long_counts(facts, host_apps=False)
    unique = counts.where("dim = 'total'").select(
        "bucket", F.lit("unique").alias("dim"), F.lit("").alias("key"), F.col("u").alias("cnt")
    )
    return counts.drop("u").unionByName(unique)


def pattern_sources(facts: DataFrame, k: int = 5) -> DataFrame:
    """Top hosts and apps of each (bucket, pattern): `(bucket, pattern_id, kind, key, cnt, rank)`."""
    per_key = (
        facts.select(
            "bucket", "pattern_id", "n",
            F.explode(F.array(
                F.struct(F.lit("host").alias("kind"), F.col("host").alias("key")),
                F.struct(F.lit("app").alias("kind"), F.col("app").alias("key")),
            )).alias("s"),
        )
        .groupBy("bucket", "pattern_id", F.col("s.kind").alias("kind"), F.col("s.key").alias("key"))
        .agg(F.sum("n").alias("cnt"))
    )
    return top_k(per_key, ["bucket", "pattern_id", "kind"], [F.desc("cnt"), F.asc("key")], k)


def _merge_by_pattern(rows: DataFrame, window: str, k: int) -> DataFrame:
    """Rows `(window, pattern_id, kind, key, cnt, first)` to one row per pattern.

    `kind` is host, app or event; the event row carries the total and, in
    `first`, a struct whose leading fields order the samples.  One grouping
    sums all three kinds, one ranking keeps the k largest sources, so the
    arrays built at the end hold at most k entries.
    """
    summed = rows.groupBy(window, "pattern_id", "kind", "key").agg(
        F.sum("cnt").alias("cnt"), F.min("first").alias("first")
    )
    best = top_k(summed, [window, "pattern_id", "kind"], [F.desc("cnt"), F.asc("key")], k)

    def ordered(kind):
        found = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "key", "cnt"))))
        return F.transform(found, lambda r: F.struct(r["key"].alias("key"), r["cnt"].alias("cnt")))

    return best.groupBy(window, "pattern_id").agg(
        F.max(F.when(F.col("kind") == "event", F.col("cnt"))).alias("occurrences"),
        F.max("first").alias("first"),
        ordered("host").alias("source_hosts"),
        ordered("app").alias("source_apps"),
    )


def _kind(kind: str, key: Column, cnt: Column, first: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), cnt.alias("cnt"), first.alias("first"))


def minute_highlights(
    events: DataFrame, k: int | None = 50, bucket: str = "minute", tz: str = "UTC", sources: int = 5
) -> DataFrame:
    """Unique events of each minute with occurrences and sources; the k most frequent (all for None)."""
    facts = events.groupBy(
        bucket_of(in_zone(F.col("ts"), tz), bucket).alias("bucket"),
        "pattern_id",
        filled(F.col("host"), "unknown").alias("source_host"),
        filled(F.col("app"), "-").alias("source_app"),
    ).agg(F.count(F.lit(1)).alias("n"), F.min(highlight_sample(events)).alias("first"))
    return highlights_of_facts(facts, event_order(events), k, sources)


def highlight_sample(events: DataFrame) -> Column:
    """What a highlight shows of an event; the least one is that of the first event."""
    return F.struct(*dict.fromkeys([*event_order(events), "severity", "host", "app", "message"]))


def highlights_of_facts(facts: DataFrame, order: list[str], k: int | None = 50, sources: int = 5) -> DataFrame:
    """`minute_highlights` from rows `(bucket, pattern_id, source_host, source_app, n, first)`."""
    none = F.when(F.lit(False), F.col("first"))
    n = F.col("n")
    rows = facts.select(
        "bucket", "pattern_id",
        F.inline(F.array(
            _kind("host", F.col("source_host"), n, none),
            _kind("app", F.col("source_app"), n, none),
            _kind("event", F.lit(""), n, F.col("first")),
        )),
    )
    merged = _merge_by_pattern(rows, "bucket", sources)
    best = top_k(merged, ["bucket"], [F.desc("occurrences"), *[F.asc(f"first.{c}") for c in order]], k if k else 2**31 - 1)
    return best.select(
        "bucket", "pattern_id", "rank", "first.severity", "first.host", "first.app",
        "first.message", "occurrences", "source_hosts", "source_apps",
    )


def minute_rollup(stats: DataFrame) -> DataFrame:
    """`(hour, minute, total, unique)`, one row per minute."""
    return (
        stats.where(F.col("dim").isin("total", "unique"))
        .groupBy(F.col("bucket").alias("minute"))
        .agg(
            F.sum(F.when(F.col("dim") == "total", F.col("cnt"))).alias("total"),
            F.sum(F.when(F.col("dim") == "unique", F.col("cnt"))).alias("unique"),
        )
        .select(bucket_of(F.col("minute"), "hour").alias("hour"), "minute", "total", "unique")
    )


def minute_rollup_list(stats: DataFrame) -> DataFrame:
    """The minutes of each hour (60 at most) as one ordered array."""
    return minute_rollup(stats).groupBy("hour").agg(
        F.array_sort(F.collect_list(F.struct("minute", "total", "unique"))).alias("minute_rollup")
    )


# --- hour -------------------------------------------------------------------


def _summed(stats: DataFrame, source: str, window: str, dims: list[str]) -> DataFrame:
    return (
        stats.where(F.col("dim").isin(dims))
        .groupBy(bucket_of(F.col(source), window).alias(window), "dim", "key")
        .agg(F.sum("cnt").alias("cnt"))
    )


def hourly_sums(stats: DataFrame) -> DataFrame:
    """Hour sums of every key, uncut: `(hour, dim, key, cnt)`, for exact shares and distinct counts."""
    return _summed(stats, "bucket", "hour", TOP_DIMS + ["total", "unique"])


def ranked_counts(summed: DataFrame, window: str, k: int, cut_severities: bool = False) -> DataFrame:
    """All severities and the first k of the other dims of each window, with their rank.

    Each severity is a group of its own in the first cut, which keeps the
    other lists short before they are shuffled; error totals stay whole.
    `cut_severities` ranks severities away like the rest.
    """
    order = [F.desc("cnt"), F.asc("key")]
    if cut_severities:
        return top_k(summed, [window, "dim"], order, k)
    own = F.when(F.col("dim") == "severity", F.col("key"))
    short = top_k(summed.withColumn("_own", own), [window, "dim", "_own"], order, k, "_rank")
    w = Window.partitionBy(window, "dim").orderBy(*order)
    return short.drop("_own", "_rank").withColumn("rank", F.row_number().over(w))


def hourly_stats(stats: DataFrame, k: int = 5, cut_severities: bool = False) -> DataFrame:
    """Hour totals, all severities, the top k of host, app, host/app: `(hour, dim, key, cnt, rank)`."""
    return ranked_counts(hourly_sums(stats), "hour", k, cut_severities)


def hourly_highlights(highlights: DataFrame, k: int | None = 15, sources: int = 5) -> DataFrame:
    """Minute highlights merged by pattern: summed counts and sources, first sample, ranked.

    `k=None` keeps every pattern of the hour, ranked by (priority, -occurrences).
    """
    sample = F.struct("bucket", "rank", "severity", "host", "app", "message")
    none = F.when(F.lit(False), sample)

    def tagged(name, kind):
        return F.transform(F.col(name), lambda s: _kind(kind, s["key"], s["cnt"], none))

    rows = highlights.select(
        bucket_of(F.col("bucket"), "hour").alias("hour"), "pattern_id",
        F.inline(F.concat(
            tagged("source_hosts", "host"), tagged("source_apps", "app"),
            F.array(_kind("event", F.lit(""), F.col("occurrences"), sample)),
        )),
    )
    merged = _merge_by_pattern(rows, "hour", sources)
    order = [priority(F.col("first.severity")), F.desc("occurrences"), "first.bucket", "first.rank"]
    return top_k(merged, ["hour"], order, k if k else 2**31 - 1).select(
        "hour", "pattern_id", "rank", "first.severity", "first.host", "first.app",
        "first.message", "occurrences", "source_hosts", "source_apps",
    )


def filter_analysis_levels(
    highlights: DataFrame, levels=tuple(DEFAULT_LEVELS), k: int | None = None, window: str = "hour"
) -> DataFrame:
    """Highlights at the wanted levels, ranked anew; the first k of each window if given."""
    level = F.coalesce(
        case_of(F.lower("severity"), ANALYSIS_LEVELS, F.lit(None).cast("string")), F.upper("severity")
    )
    kept = highlights.where(level.isin([x.upper() for x in levels]))
    return top_k(kept, [window], ["rank"], k if k else 2**31 - 1, "level_rank")


def service_health(highlights: DataFrame, k: int = 3) -> DataFrame:
    """Per hour and app: anomalies, counts by severity, the first k issues."""
    h = highlights.select(
        "hour",
        F.when(F.col("app").isNull() | (F.col("app") == "-"), "unknown").otherwise(F.col("app")).alias("app"),
        F.lower(F.coalesce("severity", F.lit("info"))).alias("severity"),
        "occurrences", "rank", "message",
    )
    numbered = top_k(h, ["hour", "app"], ["rank"], 2**31 - 1, "issue_rank")
    issue = F.struct(
        "issue_rank", "severity",
        F.substring(display_message(F.col("message")), 1, 500).alias("message"),
        F.col("occurrences").alias("count"),
    )
    return (
        numbered.groupBy("hour", "app", "severity")
        .agg(F.sum("occurrences").alias("n"),
             F.collect_list(F.when(F.col("issue_rank") <= k, issue)).alias("issues"))
        .groupBy("hour", "app")
        .agg(
            F.sum("n").alias("anomalies"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severities"),
            F.array_sort(F.flatten(F.collect_list("issues"))).alias("top_issues"),
        )
    )


# --- day --------------------------------------------------------------------


def daily_stats(stats: DataFrame, k: int = 10, exact: bool = True) -> DataFrame:
    """Day totals, all severities, top k hosts and apps: `(day, dim, key, cnt, rank)`.

    `exact` reads minute counts; otherwise `stats` are hourly top lists and the
    day sums only what made those lists.
    """
    source = "bucket" if exact else "hour"
    summed = _summed(stats, source, "day", ["severity", "host", "app", "total", "unique"])
    return ranked_counts(summed, "day", k)


def _error_hours(hourly: DataFrame, errors=tuple(DAILY_ERRORS)) -> DataFrame:
    return hourly.where((F.col("dim") == "severity") & F.col("key").isin(list(errors)))


def _first_errors(highlights: DataFrame, k: int) -> DataFrame:
    """First k error highlights of each hour as an ordered array."""
    errors = highlights.where(F.col("severity").isin(DAILY_ERRORS))
    return (
        top_k(errors, ["hour"], ["rank"], k, "error_rank")
        .groupBy("hour")
        .agg(F.array_sort(F.collect_list(
            F.struct("error_rank", "severity", "host", "app", "occurrences", "message")
        )).alias("highlights"))
    )


def _severity_breakdown(hourly: DataFrame) -> DataFrame:
    """Per error hour: total and `(severity, count)` in severity order (8 entries at most)."""
    place = case_of(F.col("key"), {s: i for i, s in enumerate(PRI_SEVERITIES)}, 8)
    return (
        _error_hours(hourly).groupBy("hour").agg(
            F.sum("cnt").alias("total_errors"),
            F.array_sort(F.collect_list(F.struct(
                place.alias("place"), F.col("key").alias("severity"), F.col("cnt").alias("count")
            ))).alias("b"),
        )
        .withColumn("severity_breakdown", F.transform("b", lambda s: s.dropFields("place")))
        .drop("b")
        .where("total_errors > 0")
    )


def notable_incidents(hourly: DataFrame, highlights: DataFrame, k: int = 4) -> DataFrame:
    """Hours with errors: total, breakdown, first k error highlights."""
    return (
        _severity_breakdown(hourly)
        .join(_first_errors(highlights, k), "hour", "left")
        .withColumn("day", bucket_of(F.col("hour"), "day"))
    )


def daily_highlights(highlights: DataFrame, k: int = 50, condensed: bool = False) -> DataFrame:
    """Hourly highlights of a day, not merged, the first k by (priority, -occurrences)."""
    h = highlights.withColumn("day", bucket_of(F.col("hour"), "day")).withColumnRenamed("rank", "hour_rank")
    order = [priority(F.col("severity")), F.desc("occurrences"), "hour", "hour_rank"]
    out = top_k(h, ["day"], order, 15 if condensed else k)
    if condensed:
        out = out.withColumn("message", F.substring(F.coalesce("message", F.lit("")), 1, 500))
    return out.select("day", "rank", "hour", "pattern_id", "severity", "host", "app", "occurrences", "message")


# --- dashboards -------------------------------------------------------------


def recent_hours(hourly: DataFrame, n: int = 24, skip: int = 0) -> DataFrame:
    """The newest n hours that have a report (after `skip` newer ones)."""
    hours = hourly.where(F.col("dim") == "total").select("hour").orderBy(F.desc("hour"))
    return (hours.offset(skip) if skip else hours).limit(n)


def error_insights(hourly: DataFrame, highlights: DataFrame, limit: int = 8) -> DataFrame:
    """Newest error hours with breakdown, top hosts and apps, first highlights."""
    seen = recent_hours(hourly, limit * 3)
    base = (
        _severity_breakdown(hourly.join(seen, "hour", "left_semi"))
        .orderBy(F.desc("hour")).limit(limit)
    )
    errors = highlights.where(F.col("severity").isin(DAILY_ERRORS)).join(
        base.select("hour"), "hour", "left_semi"
    )
    own = F.array(F.struct(F.coalesce("host", F.lit("unknown")).alias("key"), F.col("occurrences").alias("cnt")))
    hosts = (
        errors.select(
            "hour",
            F.explode(F.when(F.size("source_hosts") > 0, F.col("source_hosts")).otherwise(own)).alias("s"),
        )
        .groupBy("hour", F.col("s.key").alias("key")).agg(F.sum("s.cnt").alias("count"))
    )
    apps = errors.groupBy("hour", F.coalesce("app", F.lit("-")).alias("key")).agg(
        F.sum("occurrences").alias("count")
    )

    def ranked(df, k, name):
        best = top_k(df, ["hour"], [F.desc("count"), F.asc("key")], k)
        return best.groupBy("hour").agg(
            F.array_sort(F.collect_list(F.struct("rank", "key", "count"))).alias(name)
        )

    return (
        base.join(ranked(hosts, 5, "top_hosts"), "hour", "left")
        .join(ranked(apps, 3, "top_apps"), "hour", "left")
        .join(_first_errors(errors, 4), "hour", "left")
        .orderBy(F.desc("hour"))
    )


def hourly_counts(hourly: DataFrame, days: int, now: Column) -> DataFrame:
    """Non-zero event totals per hour of the last days."""
    return (
        hourly.where((F.col("dim") == "total") & (F.col("cnt") > 0)
                     & (F.col("hour") >= now - F.make_dt_interval(F.lit(days))))
        .select("hour", F.col("cnt").alias("count"))
        .orderBy("hour")
    )


def kpis_24h(hourly: DataFrame) -> DataFrame:
    """One row: totals of the newest 24 hourly reports, and the change to the 24 before."""
    now = hourly.join(recent_hours(hourly), "hour", "left_semi")
    is_error = (F.col("dim") == "severity") & F.lower("key").isin(KPI_ERRORS)
    per_hour = now.groupBy("hour").agg(
        F.sum(F.when(F.col("dim") == "total", F.col("cnt"))).alias("events"),
        F.coalesce(F.sum(F.when(is_error, F.col("cnt"))), F.lit(0)).alias("errors"),
    )
    totals = per_hour.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("total_errors"),
        F.count_if((F.col("events") > 0) & (F.col("errors") / F.col("events") > 0.1)).alias("anomaly_hours"),
    )
    hosts = now.where(F.col("dim") == "host").agg(F.count_distinct("key").alias("unique_hosts"))
    before = (
        hourly.where(F.col("dim") == "total")
        .join(recent_hours(hourly, 24, 24), "hour", "left_semi")
        .agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("previous_events"))
    )
    one = F.lit(1).alias("_one")
    return (
        totals.select("*", one).join(hosts.select("*", one), "_one").join(before.select("*", one), "_one")
        .select(
            "total_events", "total_errors", "unique_hosts", "anomaly_hours", "previous_events",
            F.when(F.col("total_events") > 0, F.round(F.col("total_errors") / F.col("total_events") * 100, 2))
            .otherwise(0.0).alias("error_rate"),
            F.when(
                F.col("previous_events") > 0,
                F.round((F.col("total_events") - F.col("previous_events")) / F.col("previous_events") * 100, 1),
            ).alias("events_change"),
        )
    )


def top_share(hourly: DataFrame, dim: str, k: int, hours: int = 24) -> DataFrame:
    """Largest keys of a dim over the newest hours."""
    return (
        hourly.where(F.col("dim") == dim)
        .join(recent_hours(hourly, hours), "hour", "left_semi")
        .groupBy("key").agg(F.sum("cnt").alias("count"))
        .orderBy(F.desc("count"), "key").limit(k)
    )


def error_trend(hourly: DataFrame, hours: int = 24) -> DataFrame:
    """Errors per hour of the newest hours, in time order."""
    is_error = (F.col("dim") == "severity") & F.lower("key").isin(KPI_ERRORS)
    return (
        hourly.join(recent_hours(hourly, hours), "hour", "left_semi")
        .groupBy("hour")
        .agg(F.coalesce(F.sum(F.when(is_error, F.col("cnt"))), F.lit(0)).alias("errors"))
        .orderBy("hour")
    )


def _recent_health(health: DataFrame, hours: int) -> DataFrame:
    newest = health.select("hour").distinct().orderBy(F.desc("hour")).limit(hours)
    return health.join(newest, "hour", "left_semi")


def service_status(health: DataFrame, hours: int = 24) -> DataFrame:
    """Anomalies per app over the newest hours and its status."""
    return (
        _recent_health(health, hours).groupBy("app").agg(F.sum("anomalies").alias("anomalies"))
        .withColumn(
            "status",
            F.when(F.col("anomalies") > 10, "critical").when(F.col("anomalies") > 0, "warning").otherwise("healthy"),
        )
        .orderBy(F.desc("anomalies"), "app")
    )


def recent_issues(health: DataFrame, k: int = 15, hours: int = 24) -> DataFrame:
    """Issues of the newest hours by severity, then the newest first."""
    flat = _recent_health(health, hours).select("hour", "app", F.explode("top_issues").alias("i"))
    order = case_of(F.col("severity"), ISSUE_PRIORITY, ISSUE_PRIORITY_DEFAULT)
    return (
        flat.select("hour", "app", "i.severity", "i.message", "i.count", "i.issue_rank")
        .orderBy(order, F.desc("hour"), "app", "issue_rank").limit(k)
    )


def chart_points(
    df: DataFrame, x: str, y: str, group_by: str | None = None, agg: str | None = None, ts: str | None = None
) -> DataFrame:
    """Rows `(x, y[, group])` for a chart; `agg` is sum, avg, count, min, max or last."""
    cols = [F.col(x).alias("x")] + ([F.col(group_by).alias("group")] if group_by else [])
    if agg is None:
        return df.select(*cols, F.col(y).alias("y"))
    how = {
        "sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max,
        "last": lambda c: F.max_by(c, ts or x),
    }
    if agg not in how:
        raise ValueError(f"unknown aggregation {agg!r}")
    return df.groupBy(*cols).agg(how[agg](y).alias("y"))


def chart_log_volume(logs: DataFrame) -> DataFrame:
    return logs.groupBy(bucket_of(F.col("ts"), "hour").alias("hour")).agg(
        F.count(F.lit(1)).alias("count")
    ).orderBy("hour")


def chart_error_rate(logs: DataFrame) -> DataFrame:
    return logs.groupBy(bucket_of(F.col("ts"), "hour").alias("hour")).agg(
        F.round(
            F.count_if(F.col("severity").isin(CHART_ERRORS)) / F.count(F.lit(1)) * 100, 6
        ).alias("error_rate")
    ).orderBy("hour")


def chart_top_hosts(logs: DataFrame, k: int = 10) -> DataFrame:
    return logs.groupBy("host").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "host").limit(k)


def chart_severity_dist(logs: DataFrame) -> DataFrame:
    return logs.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))


def chart_activity_frequency(events: DataFrame, k: int = 20) -> DataFrame:
    return events.groupBy("activity").agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.desc("count"), "activity"
    ).limit(k)
