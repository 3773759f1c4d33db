"""Issue lifecycle: first sighting, return, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket_of
from ..schemas import TREND_ERRORS
from ..session import stored
from ..sources import keyed
from .dedupe import event_order

KEY = ["pattern_id"]
STATE_COLUMNS = ["pattern_id", "first_seen", "last_seen", "status", "severity", "sample_message"]


def daily_error_patterns(highlights: DataFrame) -> DataFrame:
    """Error patterns of each day: `(day, pattern_id, severity, sample_message)`.

    `highlights` are daily highlights with `day` and `rank`; where a pattern
    shows up more than once on a day, the last one gives severity and sample.
    """
    errors = highlights.where(
        F.lower("severity").isin(TREND_ERRORS) & (F.length("pattern_id") > 0)
    )
    return (
        errors.groupBy("day", "pattern_id")
        .agg(F.max_by(F.struct("severity", "message"), "rank").alias("s"))
        .select("day", "pattern_id", "s.severity", F.col("s.message").alias("sample_message"))
    )


def daily_error_patterns_of_events(events: DataFrame, errors=tuple(TREND_ERRORS)) -> DataFrame:
    """Error patterns of each day from the events themselves, so none is missed.

    Severity and sample are those of the day's first event of the pattern.
    """
    order = event_order(events)
    first = F.min(F.struct(*dict.fromkeys([*order, "severity", "message"])))
    found = events.where(F.lower("severity").isin(list(errors)) & (F.length("pattern_id") > 0))
    return (
        found.groupBy(bucket_of(F.col("ts"), "day").alias("day"), "pattern_id").agg(first.alias("s"))
        .select("day", "pattern_id", "s.severity", F.col("s.message").alias("sample_message"))
    )


def issue_state_as_of(daily: DataFrame, day: Column) -> DataFrame:
    """State after the days up to `day` went through upsert and resolve, in one aggregation."""
    latest = F.struct("severity", "sample_message")
    return (
        daily.where(F.col("day") <= day)
        .groupBy("pattern_id")
        .agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"),
             F.max_by(latest, "day").alias("s"))
        .select(
            "pattern_id", "first_seen", "last_seen",
            F.when(F.col("last_seen") == day, "active").otherwise("resolved").alias("status"),
            "s.severity", "s.sample_message",
        )
    )


def upsert_issues(state: DataFrame, today: DataFrame) -> DataFrame:
    """Insert new patterns, refresh known ones; `today` has one row per pattern."""
    t = today.select(
        "pattern_id", F.col("day").alias("_day"), F.col("severity").alias("_severity"),
        F.col("sample_message").alias("_sample"),
    )
    seen = F.col("_day").isNotNull()
    return state.join(t, "pattern_id", "full_outer").select(
        "pattern_id",
        F.coalesce("first_seen", "_day").alias("first_seen"),
        F.coalesce("_day", "last_seen").alias("last_seen"),
        F.when(seen, "active").otherwise(F.col("status")).alias("status"),
        F.when(seen, F.col("_severity")).otherwise(F.col("severity")).alias("severity"),
        F.when(seen, F.col("_sample")).otherwise(F.col("sample_message")).alias("sample_message"),
    )


def resolve_missing(state: DataFrame, today: DataFrame, cutoff: Column) -> DataFrame:
    """Close active issues not seen today and last seen before the cutoff.

    The state comes back whole; `newly_resolved` marks the issues just closed.
    """
    t = today.select("pattern_id", F.lit(True).alias("_today")).distinct()
    gone = (F.col("status") == "active") & F.col("_today").isNull() & (F.col("last_seen") < cutoff)
    return (
        state.join(t, "pattern_id", "left")
        .withColumn("newly_resolved", gone)
        .withColumn("status", F.when(gone, "resolved").otherwise(F.col("status")))
        .drop("_today")
    )


def advance_stored(today: DataFrame, root: str, cutoff: Column, buckets: int = keyed.BUCKETS, most: int = 8) -> int:
    """One day of a stored issue table: upsert, then resolve; only changed rows are written.

    `today` has one row per pattern.  Known rows are looked up in the buckets of
    today's patterns, and active ones that stayed away are found by their
    status.  The changes are one commit of `sources.keyed`, so the day counts
    as a whole or not at all and can be repeated.  Buckets with more than
    `most` changes since their base are compacted.  Returns the commit's number.
    """
    spark = today.sparkSession
    count = keyed.n_buckets(spark, root) or buckets
    today = stored(today.select("pattern_id", "day", "severity", "sample_message"), "today")
    empty = spark.createDataFrame([], "pattern_id string, first_seen timestamp_ntz, last_seen timestamp_ntz, "
                                      "status string, severity string, sample_message string")
    known = keyed.read_rows(spark, root, KEY, keyed.touched(today, KEY, count), empty.schema)
    known = empty if known is None else known.join(today.select(*KEY), KEY, "left_semi")
    seen = upsert_issues(known, today)
    everything = keyed.read_rows(spark, root, KEY, schema=empty.schema)
    if everything is not None:
        away = everything.where((F.col("status") == "active") & (F.col("last_seen") < cutoff)).join(today.select(*KEY), KEY, "left_anti")
        seen = seen.unionByName(away.withColumn("status", F.lit("resolved")))
    number = keyed.put_rows(seen.select(STATE_COLUMNS), root, KEY, count)
    keyed.compact(spark, root, KEY, most, empty.schema)
    return number


def active_issues(state: DataFrame) -> DataFrame:
    return state.where("status = 'active'").orderBy(F.desc("last_seen"), "pattern_id")


def resolved_issues(state: DataFrame, since: Column) -> DataFrame:
    return state.where((F.col("status") == "resolved") & (F.col("last_seen") >= since)).orderBy(
        F.desc("last_seen"), "pattern_id"
    )


def trend_details(state: DataFrame, day: Column) -> DataFrame:
    """Issues with their class on that day: new, ongoing, resolved since the day before."""
    cls = (
        F.when((F.col("status") == "active") & (F.col("first_seen") >= day), "new")
        .when(F.col("status") == "active", "ongoing")
        .when(
            (F.col("status") == "resolved") & (F.col("last_seen") >= day - F.expr("INTERVAL 1 DAY")),
            "resolved",
        )
    )
    return state.withColumn("class", cls).where(F.col("class").isNotNull())


def trend_report(state: DataFrame, day: Column) -> DataFrame:
    """One row of counts per day; the issues themselves are in `trend_details`."""
    d = trend_details(state, day)
    return d.agg(
        F.count_if(F.col("class") == "new").alias("new_count"),
        F.count_if(F.col("class") == "ongoing").alias("ongoing_count"),
        F.count_if(F.col("class") == "resolved").alias("resolved_count"),
    ).select(day.alias("day"), "*")


def issue_timeline(daily: DataFrame, last_day: Column | None = None) -> DataFrame:
    """The lifecycle of all patterns over all days at once, one row per (pattern, day seen).

    `state` is new, ongoing or reopened; `resolved_day` is the next day when
    the pattern stays away then.  The day after `last_day` has not been looked
    at yet, so nothing is resolved there.
    """
    w = Window.partitionBy("pattern_id").orderBy("day")
    one = F.expr("INTERVAL 1 DAY")
    out = daily.select(
        "pattern_id", "day", "severity",
        F.min("day").over(Window.partitionBy("pattern_id")).alias("first_day"),
        F.lag("day").over(w).alias("previous_day"),
        F.lead("day").over(w).alias("_next"),
    )
    quiet = F.col("_next").isNull() | (F.col("_next") > F.col("day") + one)
    looked = F.lit(True) if last_day is None else F.col("day") < last_day
    return out.select(
        "pattern_id", "day", "severity", "first_day", "previous_day",
        F.when(F.col("previous_day").isNull(), "new")
        .when(F.col("previous_day") == F.col("day") - one, "ongoing")
        .otherwise("reopened").alias("state"),
        F.when(quiet & looked, F.col("day") + one).alias("resolved_day"),
    )
