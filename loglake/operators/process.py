"""Process mining over event logs.

A case may hold any share of the events, so no operator gathers a whole case
in one place: long cases are numbered with `with_group_index` and handled in
parts of a bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import top_k
from ..functions.skew import with_group_index
from ..session import stored
from .parse import extract_case_ids

PART = 10_000


def process_events(
    prepared: DataFrame, logs: DataFrame, tenant: str, start: Column, end: Column,
    pattern: str | None = None, activity_field: str = "app", limit: int | None = None,
) -> DataFrame:
    """Events of a tenant and time range: the prepared table, or the logs where it has none."""

    def scope(df):
        return df.where(
            (F.col("tenant_id") == tenant) & (F.col("ts") >= start) & (F.col("ts") <= end)
        )

    ready = scope(prepared)
    if not ready.isEmpty():
        out, order = ready, ["case_id", "ts", "event_id"]
    else:
        order = ["ts", "event_id"]  # the first events of the range, whatever their case
        found = extract_case_ids(scope(logs), pattern)
        out = found.select(
            "tenant_id", "case_id",
            F.when(F.length(activity_field) > 0, F.col(activity_field)).otherwise("unknown").alias("activity"),
            "ts", "event_id", F.col("host").alias("resource"),
            F.create_map(
                F.lit("severity"), F.col("severity"), F.lit("message"), F.substring("message", 1, 200)
            ).alias("attributes"),
        )
    return out if limit is None else out.orderBy(*order).limit(limit)


def _case_sizes(events: DataFrame) -> DataFrame:
    return events.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")
    )


def _long_cases(events: DataFrame, part: int) -> DataFrame:
    """Cases of more than `part` events; written once, so its size is known to the joins."""
    return stored(_case_sizes(events).where(F.col("event_count") > part).select("case_id"), "long_cases")


def _numbered(events: DataFrame) -> DataFrame:
    return with_group_index(events, ["case_id"], [F.col("ts"), F.col("event_id")], "seq")


def with_sequence(events: DataFrame, part: int = PART) -> DataFrame:
    """Number the events 0, 1, 2 ... inside each case by time."""
    long_cases = _long_cases(events, part)
    w = Window.partitionBy("case_id").orderBy("ts", "event_id")
    seq = F.row_number().over(w).cast("long") - 1
    if long_cases.isEmpty():
        return events.withColumn("seq", seq)
    short = events.join(long_cases, "case_id", "left_anti").withColumn("seq", seq)
    return short.unionByName(_numbered(events.join(long_cases, "case_id", "left_semi")))


def traces(events: DataFrame, part: int = PART) -> DataFrame:
    """Ordered activities per case: one row for every `part` events of a case.

    `event_count`, `start_ts`, `end_ts` and `duration_ms` describe the whole
    case; a case of up to `part` events has the one row of part 0.  Ordinary
    cases take one grouping; only cases known to be longer are numbered.
    """
    row = F.struct("ts", "event_id", "activity")
    long_cases = _long_cases(events, part)
    some_long = not long_cases.isEmpty()
    short = events.join(long_cases, "case_id", "left_anti") if some_long else events
    out = short.groupBy("case_id").agg(
        F.array_sort(F.collect_list(row)).alias("a"), F.count(F.lit(1)).alias("event_count"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
    ).select("case_id", F.lit(0).cast("long").alias("part"), F.col("a.activity").alias("activities"), "event_count", "start_ts", "end_ts")
    if some_long:
        long = events.join(long_cases, "case_id", "left_semi")
        parts = (
            _numbered(long).groupBy("case_id", F.floor(F.col("seq") / part).alias("part"))
            .agg(F.array_sort(F.collect_list(F.struct("seq", "activity"))).alias("a"))
            .select("case_id", "part", F.col("a.activity").alias("activities"))
        )
        out = out.unionByName(parts.join(_case_sizes(long), "case_id"))
    micros = F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))
    return out.withColumn("duration_ms", F.floor(micros / 1000).cast("long"))


def variants(trace_parts: DataFrame, k: int = 50, examples: int = 5) -> DataFrame:
    """Different activity sequences by number of cases, the k most frequent.

    One row per variant and part, as in `traces`; `part` is 0 alone for
    variants of up to that many events.

    Sequences are compared by a 128-bit digest over all their parts; the
    activities themselves are only fetched for the k variants returned.
    """
    text = F.to_json("activities")
    cases = trace_parts.groupBy("case_id").agg(
        F.bit_xor(F.xxhash64("part", text)).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("second"), "part", F.sha2(text, 256))).alias("h2"),
        F.max("event_count").alias("n"), F.max("duration_ms").alias("duration_ms"),
    )
    key = ["h1", "h2", "n"]
    best = (
        cases.groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("case_count"), F.avg("duration_ms").alias("avg_duration_ms"),
            F.min("case_id").alias("sample"),
        )
        .orderBy(F.desc("case_count"), "sample").limit(k)
    )
    shown = (
        top_k(cases.join(best.select(*key), key, "left_semi"), key, ["case_id"], examples)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list("case_id")).alias("example_case_ids"))
    )
    return (
        best.join(shown, key)
        .join(trace_parts.select(F.col("case_id").alias("sample"), "part", "activities"), "sample")
        .select("activities", "part", "case_count", "avg_duration_ms", "example_case_ids")
    )


def activity_frequency(events: DataFrame, k: int = 20) -> DataFrame:
    return (
        events.groupBy("activity").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "activity").limit(k)
    )


def process_summary(events: DataFrame, trace_parts: DataFrame) -> DataFrame:
    """One row: events, cases, activities, variants; `variants` and `activity_frequency` list the top."""
    text = F.to_json("activities")
    cases = trace_parts.groupBy("case_id").agg(
        F.bit_xor(F.xxhash64("part", text)).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("second"), "part", F.sha2(text, 256))).alias("h2"),
        F.max("event_count").alias("n"),
    )
    sequences = cases.agg(
        F.count(F.lit(1)).alias("total_cases"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.count_distinct("h1", "h2", "n").alias("variant_count"),
    )
    kinds = events.agg(F.count_distinct("activity").alias("unique_activities"))
    one = F.lit(1).alias("_one")
    return sequences.select("*", one).join(kinds.select("*", one), "_one").drop("_one")


def directly_follows(events: DataFrame, part: int = PART) -> DataFrame:
    """Edges a -> b between neighbouring events of a case, with count and mean gap in seconds.

    Cases are cut in parts; the first event of a part is also handed to the
    part before, where it only serves as the next event.
    """
    rows = with_sequence(events.select("case_id", "activity", "ts", "event_id"), part)
    chunk = F.floor(F.col("seq") / part)
    own = F.struct(chunk.alias("chunk"), F.lit(False).alias("extra"))
    before = F.struct((chunk - 1).alias("chunk"), F.lit(True).alias("extra"))
    copies = F.when((F.col("seq") > 0) & (F.col("seq") % part == 0), F.array(own, before)).otherwise(F.array(own))
    w = Window.partitionBy("case_id", "chunk").orderBy("seq")
    steps = (
        rows.select("case_id", "activity", "ts", "seq", F.inline(copies))
        .withColumn("next_activity", F.lead("activity").over(w))
        .withColumn("next_ts", F.lead("ts").over(w))
        .where(~F.col("extra") & F.col("next_activity").isNotNull())
    )
    gap = (F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return steps.groupBy(F.col("activity").alias("from_activity"), F.col("next_activity").alias("to_activity")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(gap).alias("mean_gap_s")
    )


# --- XES --------------------------------------------------------------------

# Fixed head of an XES document.
XES_HEAD = """<?xml version="1.0" encoding="UTF-8" ?>
<log xes.version="1.0" xes.features="nested-attributes" openxes.version="1.0RC7">
<extension name="Concept" uri="http://www.xes-standard.org/concept.xesext" prefix="concept" />
<extension name="Lifecycle" uri="http://www.xes-standard.org/lifecycle.xesext" prefix="lifecycle" />
<extension name="Time" uri="http://www.xes-standard.org/time.xesext" prefix="time" />
<extension name="Organizational" uri="http://www.xes-standard.org/org.xesext" prefix="org" />
<global scope="event">
<string key="concept:name" value="" />
<date key="time:timestamp" value="" />
<string key="lifecycle:transition" value="" />
</global>"""


def _escaped(col: Column) -> Column:
    for char, code in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                       ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")]:
        col = F.replace(col, F.lit(char), F.lit(code))
    return col


def _tag(kind: str, key: str | Column, value: Column) -> Column:
    key = F.lit(key) if isinstance(key, str) else _escaped(key)
    return F.concat(F.lit(f"<{kind} key=\""), key, F.lit('" value="'), _escaped(value), F.lit('" />'))


def xes_lines(events: DataFrame, process_name: str = "Process") -> DataFrame:
    """The XES document as `(section, case_id, seq, value)`, in that order.

    One row per event: nothing is gathered per case.
    """
    ev = with_sequence(events)
    seconds = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format("ts", "SSSSSS")
    iso = F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))
    parts = [
        _tag("string", "concept:name", F.col("activity")),
        _tag("date", "time:timestamp", iso),
        _tag("string", "lifecycle:transition", F.lit("complete")),
    ]
    if "resource" in ev.columns:
        parts.append(F.when(F.length("resource") > 0, _tag("string", "org:resource", F.col("resource"))))
    if "duration_ms" in ev.columns:
        parts.append(F.when(F.col("duration_ms") > 0, _tag("int", "duration_ms", F.col("duration_ms").cast("string"))))
    if "attributes" in ev.columns:
        parts.append(F.array_join(F.transform(
            F.map_entries("attributes"), lambda e: _tag("string", e["key"], e["value"])
        ), ""))
    body = F.concat(F.lit("<event>"), *[F.coalesce(p, F.lit("")) for p in parts], F.lit("</event>"))
    opening = F.concat(F.lit("<trace>\n"), _tag("string", "concept:name", F.col("case_id")), F.lit("\n"))
    rows = ev.select(
        F.lit(1).alias("section"), F.col("case_id").cast("string").alias("case_id"), F.col("seq"),
        F.when(F.col("seq") == 0, F.concat(opening, body)).otherwise(body).alias("value"),
    )
    closing = events.select("case_id").distinct().select(
        F.lit(1).alias("section"), F.col("case_id").cast("string").alias("case_id"),
        F.lit(2**62).alias("seq"), F.lit("</trace>").alias("value"),
    )
    spark = events.sparkSession
    edges = spark.createDataFrame(
        [(0, "", 0, XES_HEAD), (2, "", 0, "</log>")], "section int, case_id string, seq long, value string"
    )
    name = _tag("string", "concept:name", F.lit(process_name))
    edges = edges.withColumn(
        "value", F.when(F.col("section") == 0, F.concat("value", F.lit("\n"), name)).otherwise(F.col("value"))
    )
    return rows.unionByName(closing).unionByName(edges)


def export_xes(events: DataFrame, path: str, process_name: str = "Process") -> None:
    """Write the document as text; the part files in name order are one XES document."""
    xes_lines(events, process_name).orderBy("section", "case_id", "seq").select("value").write.text(path)
