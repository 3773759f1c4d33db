"""Raw lines to log events, message patterns, rules, case ids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucket_of, case_of, in_zone
from ..functions.text import (
    ISO_TIMESTAMP, display_message, mask_variable_parts, pattern_hash, strip, with_pattern,
)
from ..schemas import PRI_SEVERITIES, TEXT_LEVELS


def _header_time(parts: Column, year: Column, tz: str) -> Column:
    """`Oct 11 22:14:15` of the first three header fields, as UTC; null if it is none."""
    text = F.concat_ws(" ", year.cast("string"), parts[0], parts[1], parts[2])
    local = F.try_to_timestamp(text, F.lit("yyyy MMM d H:m:s")).cast("timestamp_ntz")
    return local if tz.upper() == "UTC" else F.convert_timezone(F.lit(tz), F.lit("UTC"), local)


def _iso_time(raw: Column) -> Column:
    """First ISO timestamp with a zone inside the line, as UTC; null if none."""
    found = F.nullif(F.regexp_extract(raw, ISO_TIMESTAMP, 0), F.lit(""))
    with_colon = F.regexp_replace(found, r"([+-]\d{2})(\d{2})$", "$1:$2")
    instant = with_colon.try_cast("timestamp")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def _app_token(tag: Column, host: Column) -> Column:
    """Last token of the tag that looks like a program name."""
    tokens = F.split(strip(tag), r"\s+")

    def usable(tok):
        return (
            (tok != host) & (tok != "-") & tok.rlike(r"[\p{L}\[\]]")
            & ~tok.rlike("^" + ISO_TIMESTAMP + "$")
        )

    best = F.get(F.filter(F.reverse(tokens), usable), F.lit(0))
    # One word, the usual case, is the name whatever it looks like.
    return (
        F.when(tag.rlike(r"^\S+$"), tag)
        .when(strip(tag) == "", F.lit("-"))
        .otherwise(F.coalesce(best, F.element_at(tokens, -1)))
    )


def parse_logs(
    lines: DataFrame,
    tz: str = "UTC",
    year: int | None = None,
    now: str | None = None,
    app_level_fallback: bool = False,
) -> DataFrame:
    """Syslog lines to log events.

    `lines` has `value`, `sender` and `transport`; other columns are kept.
    Header times carry no year: `year` is used, or the year of `received_at`
    (if present) or of `now`.  Lines without any time get the receive time.
    """
    raw = strip(F.col("value"))
    if "received_at" in lines.columns:
        received = F.col("received_at").cast("timestamp_ntz")
    elif now is not None:
        received = F.lit(now).cast("timestamp_ntz")
    else:
        received = F.current_timestamp().cast("timestamp_ntz")
    year_col = F.lit(year) if year is not None else F.year(received)

    pri_text = F.nullif(F.regexp_extract("_raw", r"^<\s*([+-]?\d+)\s*>", 1), F.lit(""))
    staged = (
        lines.withColumn("_raw", raw)
        .withColumn("_pri", pri_text.try_cast("long"))
        .withColumn(
            "_rest",
            F.when(
                F.col("_pri").isNotNull(),
                strip(F.substr("_raw", F.instr("_raw", ">") + 1)),
            ).otherwise(F.col("_raw")),
        )
        .withColumn("_parts", F.split("_rest", r"\s+", 5))
    )
    parts = F.col("_parts")
    enough = F.size(parts) >= 4
    body = F.coalesce(F.get(parts, F.lit(4)), F.lit(""))
    staged = staged.withColumn(
        "_head", F.when(enough, _header_time(parts, year_col, tz))
    ).withColumn("_body", body)

    b = F.col("_body")
    cut = (
        F.when(F.instr(b, ": ") > 0, F.struct(F.instr(b, ": ").alias("at"), F.lit(2).alias("len")))
        .when(F.instr(b, ":\t") > 0, F.struct(F.instr(b, ":\t").alias("at"), F.lit(2).alias("len")))
        .when(F.instr(b, ":") > 0, F.struct(F.instr(b, ":").alias("at"), F.lit(1).alias("len")))
    )
    staged = staged.withColumn("_cut", cut)
    with_head = F.col("_head").isNotNull()
    tagged = with_head & F.col("_cut").isNotNull()
    host = (
        F.when(with_head, F.get(parts, F.lit(3)))
        .when(enough, F.get(parts, F.lit(0)))
        .otherwise(F.col("sender"))
    )
    tag = F.substring(b, F.lit(1), F.col("_cut.at") - 1)
    message = (
        F.when(tagged, strip(F.substr(b, F.col("_cut.at") + F.col("_cut.len"))))
        .when(with_head, strip(b))
        .when(enough, F.col("_rest"))
        .otherwise(F.col("_raw"))
    )
    severity = F.when(
        F.col("_pri").isNotNull(),
        case_of(F.pmod("_pri", F.lit(8)), {i: s for i, s in enumerate(PRI_SEVERITIES)}, "info"),
    ).otherwise("info")
    facility = F.when(
        F.col("_pri").isNotNull(), F.floor(F.col("_pri") / 8).cast("string")
    ).otherwise("user")
    if app_level_fallback:
        levels = None
        for word, name in TEXT_LEVELS.items():
            hit = F.contains("_raw", F.lit(f" - {word} - "))
            levels = F.when(hit, name) if levels is None else levels.when(hit, name)
        severity = levels.otherwise(severity)
    kept = [c for c in lines.columns if c not in ("value", "sender", "transport")]
    return staged.select(
        *kept,
        F.coalesce(_iso_time(F.col("_raw")), F.col("_head"), received).alias("ts"),
        host.alias("host"),
        F.when(tagged, _app_token(tag, F.get(parts, F.lit(3)))).otherwise("-").alias("app"),
        severity.alias("severity"),
        facility.alias("facility"),
        message.alias("message"),
        F.col("_raw").alias("raw"),
        "transport",
    )


def mask_tokens(df: DataFrame, col: str = "message", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, mask_variable_parts(F.col(col)))


def normalize_messages(
    df: DataFrame, col: str = "message", out: str = "pattern", mask_first: bool = False
) -> DataFrame:
    """Add the pattern text of a message."""
    return with_pattern(df, col, out, mask_first)


def with_pattern_id(df: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Add `pattern_id`; host and app do not take part."""
    if pattern not in df.columns:
        df = normalize_messages(df, out=pattern)
    return df.withColumn(
        "pattern_id", pattern_hash(F.col("facility"), F.col(pattern), F.col("severity"))
    )


def clean_messages(df: DataFrame, col: str = "message", out: str = "clean") -> DataFrame:
    return df.withColumn(out, display_message(F.col(col)))


@dataclass
class Rule:
    """One message rule: ALLOW, SUPPRESS or RECLASSIFY."""

    pattern: str
    action: str
    new_level: str | None = None
    extra_fields: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.action not in ("ALLOW", "SUPPRESS", "RECLASSIFY"):
            raise ValueError(f"unknown action {self.action!r}")


def rules_from_config(config: Sequence[dict]) -> list[Rule]:
    return [Rule(**entry) for entry in config]


def _with_field(fields: Column, name: str, value: str) -> Column:
    others = F.map_filter(fields, lambda k, v: k != F.lit(name))
    return F.map_concat(others, F.create_map(F.lit(name), F.lit(value)))


def apply_rules(
    df: DataFrame, rules: Sequence[Rule], message: str = "message", level: str = "severity",
    extra: str = "extra",
) -> DataFrame:
    """Apply ordered rules to every row.

    ALLOW keeps the row and ends the list for it, SUPPRESS drops it,
    RECLASSIFY sets the level and adds fields, then goes on.  Null messages
    pass unchanged.  All rules fold into one set of expressions: `open` says
    that no earlier rule has decided yet.
    """
    msg = F.col(message)
    still_open = F.lit(True)
    dropped = F.lit(False)
    new_level = F.col(level)
    fields = F.coalesce(
        F.col(extra), F.create_map().cast("map<string,string>")
    ) if extra in df.columns else F.create_map().cast("map<string,string>")
    for rule in rules:
        hit = still_open & F.coalesce(msg.rlike(rule.pattern), F.lit(False))
        if rule.action == "ALLOW":
            still_open = still_open & ~hit
        elif rule.action == "SUPPRESS":
            dropped = dropped | hit
            still_open = still_open & ~hit
        else:
            if rule.new_level:
                new_level = F.when(hit, F.lit(rule.new_level.lower())).otherwise(new_level)
            for name, value in rule.extra_fields.items():
                fields = F.when(hit, _with_field(fields, name, str(value))).otherwise(fields)
    return (
        df.withColumn("_drop", dropped)
        .withColumn(extra, fields)
        .withColumn(level, new_level)
        .where(~F.col("_drop"))
        .drop("_drop")
    )


def to_metric_series(
    df: DataFrame, bucket: str = "hour", agg: Column | None = None, by: str | None = None,
    ts: str = "ts", fill_gaps: bool = False, fill_value: float = 0.0, tz: str = "UTC",
) -> DataFrame:
    """Rows to `(series, ts, value)`, one point per series and bucket.

    `fill_gaps` adds a point for each empty bucket between the first and last
    point of a series.
    """
    agg = F.count(F.lit(1)) if agg is None else agg
    series = F.col(by) if by else F.lit("all")
    points = df.groupBy(
        series.cast("string").alias("series"),
        bucket_of(in_zone(F.col(ts), tz), bucket).alias("ts"),
    ).agg(agg.cast("double").alias("value"))
    if not fill_gaps:
        return points
    step = F.expr(f"INTERVAL 1 {bucket.upper()}")
    grid = points.groupBy("series").agg(
        F.min("ts").alias("_from"), F.max("ts").alias("_to")
    ).select("series", F.explode(F.sequence("_from", "_to", step)).alias("ts"))
    return grid.join(points, ["series", "ts"], "left").withColumn(
        "value", F.coalesce("value", F.lit(float(fill_value)))
    )


# Fixed order in which case ids are looked for.
CASE_KEYS = ["request_id", "transaction_id", "trace_id", "session", "order_id"]


def case_id_of(message: Column, pattern: str | None = None) -> Column:
    if pattern:
        return F.nullif(F.regexp_extract(message, pattern, 1), F.lit(""))
    found = [
        F.nullif(F.regexp_extract(message, rf"(?i){key}[=:\s]+([a-zA-Z0-9\-]+)", 1), F.lit(""))
        for key in CASE_KEYS
    ]
    return F.coalesce(*found)


def extract_case_ids(df: DataFrame, pattern: str | None = None, message: str = "message") -> DataFrame:
    """Add `case_id`; rows without one are dropped."""
    return df.withColumn("case_id", case_id_of(F.col(message), pattern)).where(
        F.col("case_id").isNotNull()
    )
