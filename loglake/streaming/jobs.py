"""Structured Streaming jobs.

All of them use event time with a watermark: late events within the delay are
counted, later ones are not.  Input streams carry `ts` as TIMESTAMP (UTC),
since watermarks do not take TIMESTAMP_NTZ.

Closed windows leave an aggregation in one micro-batch, so what needs whole
windows (top lists, unique counts, alerts) runs on the batch in
`foreachBatch`.  Those functions write below a folder named after the batch
id and overwrite it on a retry, so a repeated batch leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import filled
from ..operators import report, usage
from ..operators.dedupe import event_order, sample_per_key
from ..operators.parse import parse_logs, with_pattern_id
from ..operators.rollup import TOP_DIMS, highlight_sample, highlights_of_facts, hourly_highlights, ranked_counts
from ..schemas import STORED_EVENT

# --- running ----------------------------------------------------------------


def start(
    df: DataFrame, path: str, checkpoint: str, once: bool = True, mode: str = "append",
    partition_by: list[str] | None = None,
):
    """Start a query that appends to Parquet files; `once` handles what is there and stops."""
    w = df.writeStream.outputMode(mode).format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint
    )
    if partition_by:
        w = w.partitionBy(*partition_by)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")).start()


def start_batches(df: DataFrame, fn: Callable, checkpoint: str, once: bool = True, mode: str = "append"):
    """Start a query that hands every micro-batch to `fn(batch, batch_id)`."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(fn)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")).start()


def batch_sink(path: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable:
    """Writer for `start_batches`: one folder per batch, replaced when the batch is repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """`ts` as TIMESTAMP, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


# --- parse, tail, forward ---------------------------------------------------


def stream_parse(lines: DataFrame, year: int | None = None, now: str | None = None, tz: str = "UTC") -> DataFrame:
    """Raw lines to log events with pattern ids; no state."""
    return with_pattern_id(parse_logs(lines, tz=tz, year=year, now=now))


def tail_stream(spark: SparkSession, path: str) -> DataFrame:
    """New stored events as they arrive; lines that are no JSON are skipped."""
    lines = spark.readStream.option("recursiveFileLookup", "true").text(path)
    event = F.from_json("value", STORED_EVENT)
    return lines.where(F.get_json_object("value", "$").isNotNull()).select(event.alias("e")).select("e.*")


def forward_events(
    events: DataFrame, sinks: dict[str, Callable[[DataFrame], None]], checkpoint: str, dead_letters: str, once: bool = True
):
    """Hand every micro-batch to several named writers; a failing one does not hold up the others.

    The batch a writer failed on is kept, with the error, in
    `dead_letters/sink=<name>/batch=<id>`, from where it can be sent again.
    """

    def fan_out(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read once for all writers
        for name, sink in sinks.items():
            try:
                sink(batch)
            except Exception as error:  # the intake goes on, the rows are not lost
                failed = batch.withColumn("error", F.lit(str(error)[:1000]))
                failed.write.mode("overwrite").parquet(f"{dead_letters}/sink={name}/batch={batch_id}")
        batch.unpersist()

    return start_batches(events, fan_out, checkpoint, once)


def start_forward_files(events: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Forward to JSON files by Spark's own exactly-once file sink."""
    w = events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


# --- de-duplication ---------------------------------------------------------


def stream_dedupe(events: DataFrame, bucket: str = "1 minute", delay: str = "1 minute", salts: int = 32) -> DataFrame:
    """First event of each (bucket, pattern), as soon as it arrives.

    A frequent pattern is first thinned out per salt, so its events spread
    over many tasks, then once more over all salts.
    """
    marked = (
        events.withWatermark("ts", delay)
        .withColumn("bucket", F.window("ts", bucket))
        .withColumn("_salt", F.pmod(F.xxhash64("ts", "host", "message"), F.lit(salts)))
        # The bucket carries the watermark on; a stream may have one such column.
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    )
    thin = marked.dropDuplicates(["bucket", "pattern_id", "_salt"]).drop("_salt")
    return thin.dropDuplicates(["bucket", "pattern_id"])


def stream_dedupe_counted(events: DataFrame, bucket: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """Earliest event of each (bucket, pattern) with its occurrences, when the bucket closes."""
    sample = F.struct(*[c for c in ("ts", "event_id", "host", "app", "severity", "facility", "message") if c in events.columns])
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", bucket).alias("w"), "pattern_id")
        .agg(F.min(sample).alias("first"), F.count(F.lit(1)).alias("occurrences"))
        .select(F.col("w.start").alias("bucket"), "pattern_id", "first.*", "occurrences")
    )


def stream_sample(events: DataFrame, path: str, checkpoint: str, n: int = 200, seed: int = 0, once: bool = True):
    """Uniform sample of n events per host, severity and app over all batches so far.

    Each batch merges the sample of the batch before with its own n smallest
    hashes; `path/batch=<id>` of the last batch is the current sample.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = sample_per_key(batch, n=n, seed=seed, by_md5=True)
        if batch_id > 0:
            before = spark.read.parquet(f"{path}/batch={batch_id - 1}")
            own = sample_per_key(before.unionByName(own), n=n, seed=seed, by_md5=True)
        own.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return start_batches(events, merge, checkpoint, once)


# --- rollups ----------------------------------------------------------------


def _dim_rows(events: DataFrame) -> DataFrame:
    host, app = filled(F.col("host"), "unknown"), filled(F.col("app"), "-")
    dims = [("severity", F.col("severity")), ("host", host), ("app", app),
            ("host_app", F.concat(host, F.lit("/"), app)), ("pattern", F.col("pattern_id")), ("total", F.lit(""))]
    return events.select("ts", F.inline(F.array(*[
        F.struct(F.lit(d).alias("dim"), k.alias("key")) for d, k in dims
    ])))


def stream_counts(events: DataFrame, window: str, delay: str) -> DataFrame:
    """Counts per closed window by (dim, key)."""
    return (
        _dim_rows(events).withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "dim", "key")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(F.col("w.start").alias("bucket"), "dim", "key", "cnt")
    )


def with_unique(batch: DataFrame) -> DataFrame:
    """Closed windows with their number of different patterns added."""
    row = F.struct("dim", "key", "cnt")
    one = F.struct(F.lit("unique").alias("dim"), F.lit("").alias("key"), F.lit(1).cast("long").alias("cnt"))
    both = F.when(F.col("dim") == "pattern", F.array(row, one)).otherwise(F.array(row))
    return batch.select("bucket", F.inline(both)).groupBy("bucket", "dim", "key").agg(F.sum("cnt").alias("cnt"))


def start_minute_stats(events: DataFrame, path: str, checkpoint: str, delay: str = "1 minute", once: bool = True):
    """Minute rollup of closed minutes."""
    return start_batches(stream_counts(events, "1 minute", delay), batch_sink(path, with_unique), checkpoint, once)


def closed_hours(batch: DataFrame, k: int = 5) -> DataFrame:
    """Hour totals, all severities and top lists from the counts of closed hours.

    `unique` is the number of different patterns of the hour.
    """
    counts = with_unique(batch).where(F.col("dim").isin(TOP_DIMS + ["total", "unique"])).withColumnRenamed("bucket", "hour")
    return ranked_counts(counts, "hour", k)


def start_hourly_stats(events: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes", k: int = 5, once: bool = True):
    """Hourly rollup of closed hours."""
    counts = stream_counts(events, "1 hour", delay)
    return start_batches(counts, batch_sink(path, lambda b: closed_hours(b, k)), checkpoint, once)


def start_alerts(events: DataFrame, path: str, checkpoint: str, threshold: int, delay: str = "10 minutes", once: bool = True):
    """Alert rows of closed hours."""
    counts = stream_counts(events, "1 hour", delay)

    def rows(batch: DataFrame) -> DataFrame:
        return report.alerts(closed_hours(batch), None, threshold)

    return start_batches(counts, batch_sink(path, rows), checkpoint, once)


def stream_hour_facts(events: DataFrame, delay: str) -> DataFrame:
    """Events of closed hours by minute, pattern, severity, host and app, with the first event of each.

    The minutes of an hour stay in the state until the hour closes, so that
    its counts and its highlights leave together, in one batch.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy(
            F.window("ts", "1 hour").alias("w"), F.date_trunc("minute", "ts").alias("minute"), "pattern_id", "severity",
            filled(F.col("host"), "unknown").alias("source_host"), filled(F.col("app"), "-").alias("source_app"),
        )
        .agg(F.count(F.lit(1)).alias("n"), F.min(highlight_sample(events)).alias("first"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("hour"), F.col("minute").cast("timestamp_ntz").alias("bucket"),
            "pattern_id", "severity", "source_host", "source_app", "n", "first",
        )
    )


def hours_of_facts(facts: DataFrame, k: int = 5) -> DataFrame:
    """Hour totals, severities and top lists from the facts of closed hours."""
    host, app = F.col("source_host"), F.col("source_app")
    dims = [("severity", F.col("severity")), ("host", host), ("app", app), ("host_app", F.concat(host, F.lit("/"), app)),
            ("pattern", F.col("pattern_id")), ("total", F.lit(""))]
    rows = facts.select(F.col("hour").alias("bucket"), "n", F.inline(F.array(*[
        F.struct(F.lit(d).alias("dim"), key.alias("key")) for d, key in dims
    ])))
    return closed_hours(rows.groupBy("bucket", "dim", "key").agg(F.sum("n").alias("cnt")), k)


def start_text_alerts(
    events: DataFrame, path: str, checkpoint: str, threshold: int | None, delay: str = "10 minutes", once: bool = True,
    anomalies: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
):
    """Alert rows of closed hours with the texts of their error highlights, as `report.alerts` gives them.

    `anomalies` makes rows `(hour, anomalies)` from the closed hours and their
    highlights; hours with such a text are reported under the threshold, too,
    and without one (None) they alone are.
    """
    order = event_order(events)

    def rows(batch: DataFrame) -> DataFrame:
        facts = batch.persist()  # for the counts and for the highlights
        hours, highlights = hours_of_facts(facts), hourly_highlights(highlights_of_facts(facts, order), 15)
        texts = anomalies(hours, highlights) if anomalies else None
        return report.alerts(hours, highlights, threshold, texts)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch_sink(path, rows)(batch, batch_id)
        batch.unpersist()

    return start_batches(stream_hour_facts(events, delay), write, checkpoint, once)


# --- issues -----------------------------------------------------------------

_ISSUE_ROW = "pattern_id string, day timestamp, state string, severity string"
_ISSUE_STATE = "first_day timestamp, last_day timestamp, severity string, active boolean"
_DAY_MS = 86_400_000
# A resolved pattern is forgotten after so many days; its rows stand in the
# stored issue table, and if it comes back later it starts as new.
EXPIRE_DAYS = 90


def error_pattern_days(events: DataFrame, errors: list[str], delay: str = "1 hour") -> DataFrame:
    """One row per error pattern and closed day; counted on the map side first."""
    return (
        events.where(F.col("severity").isin(errors)).withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"), "pattern_id")
        .agg(F.max("severity").alias("severity"), F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("day"), "pattern_id", "severity", "n")
    )


def _advance(key, frames, state: GroupState):
    """One pattern: its new days in order, or the time-out that closes it."""
    rows = []
    if state.hasTimedOut:
        first, last, severity, active = state.get
        if active:
            rows.append((key[0], pd.Timestamp(last) + pd.Timedelta(days=1), "resolved", severity))
            state.update((first, last, severity, False))
            state.setTimeoutTimestamp(max(
                int(pd.Timestamp(last).timestamp() * 1000) + EXPIRE_DAYS * _DAY_MS, state.getCurrentWatermarkMs() + 1
            ))
        else:
            state.remove()
        yield pd.DataFrame(rows, columns=["pattern_id", "day", "state", "severity"])
        return
    days = pd.concat(list(frames)).sort_values("day")
    known = state.get if state.exists else None
    for day, severity in zip(days["day"], days["severity"]):
        if known is None:
            rows.append((key[0], day, "new", severity))
            known = (day, day, severity, True)
            continue
        first, last, _, active = known
        last = pd.Timestamp(last)
        if day <= last:
            continue
        if day - last > pd.Timedelta(days=1):
            if active:
                rows.append((key[0], last + pd.Timedelta(days=1), "resolved", known[2]))
            rows.append((key[0], day, "reopened", severity))
        else:
            rows.append((key[0], day, "ongoing" if active else "reopened", severity))
        known = (first, day, severity, True)
    state.update(tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in known))
    # Quiet for the whole next day: the pattern is resolved once that day is over.
    due = int(pd.Timestamp(known[1]).timestamp() * 1000) + 2 * _DAY_MS
    state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(rows, columns=["pattern_id", "day", "state", "severity"])


def stream_issue_state(pattern_days: DataFrame, delay: str = "1 day") -> DataFrame:
    """Lifecycle rows (new, ongoing, reopened, resolved) from pattern days.

    `pattern_days` has one row per pattern and day, so a task sees at most
    one row per day of a pattern, however frequent the pattern is.  State is
    kept until a pattern has been quiet for `EXPIRE_DAYS`.
    """
    return (
        pattern_days.withWatermark("day", delay)
        .groupBy("pattern_id")
        .applyInPandasWithState(
            _advance, _ISSUE_ROW, _ISSUE_STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


# --- usage ------------------------------------------------------------------


def stream_hourly_usage(events: DataFrame, project: str = "tenant_id", delay: str = "10 minutes") -> DataFrame:
    """Events and errors per project and closed hour."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 hour").alias("w"), F.col(project).alias("project_id"))
        .agg(F.count(F.lit(1)).alias("event_count"),
             F.count_if(F.col("severity").isin(usage.USAGE_ERRORS)).alias("error_count"))
        .select("project_id", F.col("w.start").cast("timestamp_ntz").alias("timestamp_hour"), "event_count", "error_count")
    )


def start_usage_quota(
    events: DataFrame, path: str, checkpoint: str, projects: DataFrame, plans: DataFrame,
    delay: str = "10 minutes", once: bool = True,
):
    """Hourly usage of closed hours below `path/hourly`, quota colours of the days they touch below `path/quota`."""

    def account(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()  # written and then looked up for the days it touches
        if batch.isEmpty():  # no window has closed yet
            batch.unpersist()
            return
        rows = batch.withColumn("dt", F.to_date("timestamp_hour")).withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch").parquet(f"{path}/hourly")
        # Only the folders of the days the batch touches are listed and read again: as many as windows are open.
        days = [r.dt for r in rows.select("dt").distinct().collect()]
        hourly = spark.read.option("basePath", f"{path}/hourly").parquet(*[f"{path}/hourly/dt={d}" for d in days]).drop("batch")
        usage.quota_by_day(usage.daily_usage(hourly), projects, plans).write.mode("overwrite").parquet(
            f"{path}/quota/batch={batch_id}"
        )
        batch.unpersist()

    return start_batches(stream_hourly_usage(events, delay=delay), account, checkpoint, once)
