"""Texts built from aggregates: model inputs, plain summaries, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucket_of, top_k
from ..functions.text import clip, display_message, strip
from ..schemas import DAILY_ERRORS, DEFAULT_LEVELS, TREND_ERRORS
from .rollup import TOP_DIMS, filter_analysis_levels

# Fixed first line of summaries made without a model.
NO_MODEL = "Local model unavailable, generated deterministic summary."


def hourly_wide(hourly: DataFrame) -> DataFrame:
    """Hourly counts as one row per hour; each top list is an array of at most its k entries."""

    def ranked(dim):
        rows = F.array_sort(F.collect_list(F.when(F.col("dim") == dim, F.struct("rank", "key", "cnt"))))
        return rows.alias("top_" + dim)

    def total(dim):
        return F.coalesce(F.sum(F.when(F.col("dim") == dim, F.col("cnt"))), F.lit(0))

    is_error = (F.col("dim") == "severity") & F.col("key").isin(DAILY_ERRORS)
    return hourly.groupBy("hour").agg(
        total("total").alias("total_events"), total("unique").alias("unique_events"),
        F.coalesce(F.sum(F.when(is_error, F.col("cnt"))), F.lit(0)).alias("total_errors"),
        *[ranked(d) for d in TOP_DIMS],
    )


def _pairs(col: Column, k: int, sep: str = ":") -> Column:
    return F.array_join(
        F.transform(F.slice(col, 1, k), lambda r: F.concat(r["key"], F.lit(sep), r["cnt"].cast("string"))), ", "
    )


def _line(label: str, col: str, k: int = 3) -> Column:
    return F.when(F.size(col) > 0, F.concat(F.lit(f"{label}: "), _pairs(F.col(col), k)))


def stats_text() -> Column:
    return F.concat_ws(
        "\n",
        F.format_string("Total: %d, Unique: %d", "total_events", "unique_events"),
        _line("Severity", "top_severity"), _line("Hosts", "top_host"), _line("Apps", "top_app"),
    )


def _short(col: Column) -> Column:
    return F.substring(display_message(col), 1, 500)


def highlight_texts(highlights: DataFrame, levels=tuple(DEFAULT_LEVELS)) -> DataFrame:
    """Per hour: the table of 5 samples and the context of 10 lines, at the wanted levels."""
    h = filter_analysis_levels(highlights, levels, 10).withColumn("msg", _short(F.col("message")))
    sources = _pairs(F.col("source_hosts"), 3)
    sample = F.concat(
        F.lit("["), "severity", F.lit("] "), F.substring("host", 1, 10), F.lit("/"), F.substring("app", 1, 8),
        F.lit(" ("), F.col("occurrences").cast("string"), F.lit("x) – "), "msg",
        F.when(F.size("source_hosts") > 0, F.concat(F.lit(" | "), sources)).otherwise(""),
    )
    context = F.concat(
        F.lit("["), "severity", F.lit("] "), "host", F.lit("/"), "app", F.lit(" ("),
        F.col("occurrences").cast("string"), F.lit("x) - "), "msg",
    )
    key = F.concat(F.lit("- "), "host", F.lit("/"), "app", F.lit(": "), F.substring("msg", 1, 120))
    rows = h.groupBy("hour").agg(
        F.array_sort(F.collect_list(F.struct(
            "level_rank", sample.alias("sample"), context.alias("context"), key.alias("key")
        ))).alias("r")
    )

    def joined(name, k):
        return F.array_join(F.transform(F.slice("r", 1, k), lambda x: x[name]), "\n")

    return rows.select(
        "hour",
        F.concat(F.lit("Samples:\n"), joined("sample", 5)).alias("highlight_table"),
        joined("context", 10).alias("highlights_text"),
        joined("key", 5).alias("key_samples"),
    )


def rollup_texts(minutes: DataFrame) -> DataFrame:
    """Per hour: the last two minutes as text."""
    last = top_k(minutes, ["hour"], [F.desc("minute")], 2)
    line = F.concat(
        F.date_format("minute", "HH:mm"), F.lit(": t="), F.col("total").cast("string"),
        F.lit(" u="), F.col("unique").cast("string"),
    )
    lines = F.array_sort(F.collect_list(F.struct("minute", line.alias("line"))))
    return last.groupBy("hour").agg(
        F.concat(F.lit("Latest minutes:\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("minute_rollup")
    )


def _iso(col: Column) -> Column:
    return F.concat(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def prompt_table(hourly: DataFrame, minutes: DataFrame, highlights: DataFrame, levels=tuple(DEFAULT_LEVELS)) -> DataFrame:
    """Model input of every hour, with each text clipped to its size."""
    return (
        hourly_wide(hourly)
        .join(rollup_texts(minutes), "hour", "left")
        .join(highlight_texts(highlights, levels), "hour", "left")
        .select(
            "hour", _iso(F.col("hour")).alias("window_start"),
            _iso(F.col("hour") + F.expr("INTERVAL 1 HOUR")).alias("window_end"),
            clip(stats_text(), 300).alias("stats_table"),
            clip(F.coalesce("minute_rollup", F.lit("No minute data.")), 200).alias("minute_rollup"),
            clip(F.coalesce("highlight_table", F.lit("No samples.")), 300).alias("highlight_table"),
            F.trim(F.coalesce("highlights_text", F.lit(""))).alias("highlights_text"),
        )
    )


def deterministic_summary(hourly: DataFrame, highlights: DataFrame, levels=tuple(DEFAULT_LEVELS)) -> DataFrame:
    """Summary text of every hour, made without a model."""
    severities = F.array_join(
        F.transform("top_severity", lambda r: F.concat(r["key"], F.lit(": "), r["cnt"].cast("string"))), "\n"
    )
    return hourly_wide(hourly).join(highlight_texts(highlights, levels), "hour", "left").select(
        "hour",
        F.concat_ws(
            "\n", F.lit(NO_MODEL), F.format_string("Total events: %d", "total_events"),
            F.when(F.size("top_severity") > 0, severities),
            F.when(F.length("key_samples") > 0, F.concat(F.lit("Key samples:\n"), F.col("key_samples"))),
        ).alias("summary"),
    )


def highlight_analysis(highlights: DataFrame, levels=tuple(DEFAULT_LEVELS)) -> DataFrame:
    """Highlight analysis of every hour, made without a model: up to 10 lines of 200 characters."""
    lines = F.transform(F.split("highlights_text", "\n"), lambda x: F.concat(F.lit("- "), F.substring(F.trim(x), 1, 200)))
    return highlight_texts(highlights, levels).select(
        "hour",
        F.concat(F.lit(NO_MODEL + "\n\nHighlights found:\n"), F.array_join(F.slice(lines, 1, 10), "\n")).alias("highlight_analysis"),
    )


def incident_texts(incidents: DataFrame) -> DataFrame:
    """Per day: the text of its error hours (24 at most)."""
    breakdown = F.array_join(F.transform(
        "severity_breakdown", lambda s: F.concat(s["severity"], F.lit(": "), s["count"].cast("string"))
    ), ", ")
    top = F.get("highlights", F.lit(0))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("\n  Time window: "), _iso(F.col("hour")), F.lit(" → "), _iso(F.col("hour") + F.expr("INTERVAL 1 HOUR"))),
        F.concat(F.lit("  Total errors: "), F.col("total_errors").cast("string")),
        F.concat(F.lit("  Severity breakdown: "), breakdown),
        F.concat(
            F.lit("  Top error: ["), top["severity"], F.lit("] "), top["host"], F.lit("/"), top["app"],
            F.lit(" - "), F.substring(top["message"], 1, 500),
        ),
    )
    rows = incidents.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("hour", text.alias("t")))).alias("r"))
    return rows.select("day", F.concat(
        F.format_string("Notable Incidents (%d hours with errors):\n", F.size("r")),
        F.array_join(F.transform("r", lambda x: x["t"]), "\n"),
    ).alias("notable_incidents"))


def daily_prompt_table(summaries: DataFrame, incidents: DataFrame) -> DataFrame:
    """Model input of every day: the last 12 hourly summaries and the incidents."""
    day = bucket_of(F.col("hour"), "day")
    last = top_k(summaries.withColumn("day", day), ["day"], [F.desc("hour")], 12)
    line = F.concat(F.lit("  - "), _iso(F.col("hour")), F.lit(": "), F.substring("summary", 1, 500))
    digest = last.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("hour", line.alias("l")))).alias("r")).select(
        "day", F.concat(F.lit("Hourly highlights (latest 12):\n"), F.array_join(F.transform("r", lambda x: x["l"]), "\n")).alias("hourly_digest")
    )
    none = "No notable incidents (error-level events) occurred during this day."
    return digest.join(incident_texts(incidents), "day", "left").withColumn(
        "notable_incidents", F.coalesce("notable_incidents", F.lit(none))
    )


def trend_prompt_table(details: DataFrame) -> DataFrame:
    """Per class of issues: the first 10 as text, and how many more there are."""
    line = F.concat(F.lit("- ["), "severity", F.lit("] "), F.substring("sample_message", 1, 500))
    first = top_k(details, ["class"], [F.desc("last_seen"), F.asc("pattern_id")], 10)
    lines = first.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("r"))
    sizes = details.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return lines.join(sizes, "class").select(
        "class",
        F.concat(
            F.array_join(F.transform("r", lambda x: x["l"]), "\n"),
            F.when(F.col("n") > 10, F.format_string("\n... and %d more.", F.col("n") - 10)).otherwise(""),
        ).alias("issues"),
    )


def alerts(
    hourly: DataFrame, highlights: DataFrame | None, threshold: int | None, anomalies: DataFrame | None = None
) -> DataFrame:
    """Alert rows: hours with at least `threshold` errors (None: no such alerts), or with an anomaly text `(hour, anomalies)`."""
    w = hourly_wide(hourly)
    if anomalies is not None:
        w = w.join(anomalies.select("hour", "anomalies"), "hour", "left")
    else:
        w = w.withColumn("anomalies", F.lit(None).cast("string"))
    many = F.lit(False) if threshold is None else F.col("total_errors") >= threshold
    text = F.coalesce("anomalies", F.lit(""))
    found = (F.length(text) > 0) & ~F.contains(text, F.lit("No anomalies detected")) & ~F.contains(text, F.lit("No notable anomalies"))
    first_line = F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: F.length(x) > 0), F.lit(0))
    first_line = F.coalesce(first_line, F.lit("Anomaly detected"))
    short = F.when(F.length(first_line) > 150, F.concat(F.substring(first_line, 1, 147), F.lit("..."))).otherwise(first_line)
    w = w.where(many | found).withColumn("reason", F.concat_ws(
        "\n\n",
        F.when(many, F.format_string("High Error Count: %d errors", "total_errors")),
        F.when(found, F.concat(F.lit("Anomaly: "), short)),
    ))
    if highlights is not None:
        errors = highlights.where(F.col("severity").isin(TREND_ERRORS))
        msg = F.when(F.length("message") > 80, F.concat(F.substring("message", 1, 77), F.lit("..."))).otherwise(F.col("message"))
        line = F.concat(F.lit("• "), "app", F.lit(": "), msg, F.lit(" ("), F.col("occurrences").cast("string"), F.lit("x)"))
        sizes = errors.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
        top = top_k(errors, ["hour"], ["rank"], 5, "er").groupBy("hour").agg(
            F.array_sort(F.collect_list(F.struct("er", line.alias("l")))).alias("r")
        ).join(sizes, "hour").select("hour", F.concat(
            F.lit("App Errors:\n"), F.array_join(F.transform("r", lambda x: x["l"]), "\n"),
            F.when(F.col("n") > 5, F.format_string("\n• ... and %d more errors", F.col("n") - 5)).otherwise(""),
        ).alias("app_errors"))
        w = w.join(top, "hour", "left")
    else:
        w = w.withColumn("app_errors", F.lit(None).cast("string"))

    def listed(col):
        rows = F.transform(F.slice(col, 1, 3), lambda r: F.concat(
            F.regexp_replace(r["key"], "/-$", ""), F.lit(" ("), r["cnt"].cast("string"), F.lit(")")
        ))
        return F.array_join(rows, ", ")

    error_list = F.array_sort(F.transform(
        F.filter("top_severity", lambda r: r["key"].isin(DAILY_ERRORS)),
        lambda r: F.concat(r["key"], F.lit(": "), r["cnt"].cast("string")),
    ))
    statistics = F.concat_ws(
        "\n", F.lit("Statistics:"),
        F.concat(F.lit("• Total Events: "), F.format_number("total_events", 0)),
        F.when(F.size(error_list) > 0, F.concat(F.lit("• Errors: "), F.array_join(error_list, ", "))),
        F.when(F.size("top_host_app") > 0, F.concat(F.lit("• Top Hosts: "), listed("top_host_app")))
        .when(F.size("top_host") > 0, F.concat(F.lit("• Top Hosts: "), listed("top_host"))),
        F.when(F.size("top_app") > 0, F.concat(F.lit("• Top Apps: "), listed("top_app"))),
    )
    return w.select(
        "hour", "total_events", "total_errors", F.concat_ws("\n\n", "reason", "app_errors", statistics).alias("body")
    )
