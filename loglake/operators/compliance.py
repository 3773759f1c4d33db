"""Personal data and secrets in text columns: find, mask, redact, classify.

Everything here works per row, without a shuffle: an Arrow function finds the
matches of a batch of texts, in time linear in their length and number, and
expressions do the rest.  Batches are bounded in bytes, not only in rows.  A text of any length is scanned whole.  White space
and word borders are those of Unicode.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_batches


@dataclass(frozen=True)
class Detector:
    name: str
    pattern: str
    confidence: float


# Fixed detectors in their order of precedence; all ignore case.
DETECTORS = [
    Detector("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.95),
    Detector("phone", r"\b(?:\+?1[-.\s]?)?(?:\(?[0-9]{3}\)?[-.\s]?)?[0-9]{3}[-.\s]?[0-9]{4}\b", 0.8),
    Detector("ssn", r"\b[0-9]{3}[-\s]?[0-9]{2}[-\s]?[0-9]{4}\b", 0.9),
    Detector("credit_card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", 0.95),
    Detector("ip_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 0.7),
    Detector("api_key", r"""\b(?:api[_-]?key|apikey|api_secret)[=:\s]+["']?([a-zA-Z0-9_-]{20,})["']?""", 0.9),
    Detector("password", r"""(?:password|passwd|pwd)[=:\s]+["']?([^\s"']{8,})["']?""", 0.85),
    Detector("jwt", r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", 0.95),
    Detector("aws_key", r"\b(?:AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16}\b", 0.95),
]
NAMES = [d.name for d in DETECTORS]
SECRETS = ["api_key", "password", "jwt", "aws_key"]

SPAN = "ord:int,pii_type:string,start_pos:int,end_pos:int,original:string,confidence:double"
# Kept spans do not overlap; `before` is the text between a span and the one before it.
FOUND = f"spans:array<struct<{SPAN}>>,kept:array<struct<before:string,pii_type:string,original:string>>,rest:string"

# Cheap conditions that every text with such a match meets; most texts are
# spared the full pattern.
MAY_HOLD = {
    "email": lambda text, low: "@" in text,
    "phone": lambda text, low: FOUR_DIGITS.search(text),
    "ssn": lambda text, low: FOUR_DIGITS.search(text),
    "credit_card": lambda text, low: TWELVE_DIGITS.search(text),
    "ip_address": lambda text, low: DOTTED.search(text),
    "api_key": lambda text, low: "api" in low,
    "password": lambda text, low: "passw" in low or "pwd" in low,
    "jwt": lambda text, low: "eyj" in low,
    "aws_key": lambda text, low: "akia" in low or "abia" in low or "acca" in low or "asia" in low,
}
FOUR_DIGITS, TWELVE_DIGITS, DOTTED = (re.compile(p) for p in ("[0-9]{4}", "[0-9]{12}", "[0-9][.][0-9]"))
A_DIGIT = re.compile("[0-9]")
NEED_DIGITS = {"phone", "ssn", "credit_card", "ip_address"}


def _chosen(types) -> list[tuple[int, Detector]]:
    unknown = set(types or ()) - set(NAMES) - {"name"}
    if unknown:
        raise ValueError(f"unknown detector {sorted(unknown)}")
    return [(i, d) for i, d in enumerate(DETECTORS) if types is None or d.name in types]


def _matches(text: str, detectors: list) -> list[tuple]:
    """All matches in detector order, then by position."""
    low, out = text.lower(), []
    digits = A_DIGIT.search(text)
    for order, name, pattern, confidence in detectors:
        if (digits or name not in NEED_DIGITS) and MAY_HOLD[name](text, low):
            out += [(order, name, m.start(), m.end(), m[0], confidence) for m in pattern.finditer(text)]
    return out


def _without_overlaps(spans: list[tuple]) -> list[tuple]:
    """Spans by position; the earlier detector wins where two overlap."""
    starts, kept = [], []
    for s in spans:
        at = bisect_left(starts, s[3])  # spans from here on start after this one ends
        if not at or kept[at - 1][3] <= s[2]:
            starts.insert(at, s[2])
            kept.insert(at, s)
    return kept


def _found(df: DataFrame, text: str, types) -> Column:
    """The matches in a text column; Python holds a few megabytes of texts at once, however long they are."""
    small_batches(df.sparkSession)
    return _finder(types)(F.col(text))


def _finder(types):
    detectors = [(i, d.name, re.compile(d.pattern, re.IGNORECASE), d.confidence) for i, d in _chosen(types)]

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = _matches(text, detectors) if text else []
            kept, at = [], 0
            for _, name, start, end, original, _ in _without_overlaps(spans):
                kept.append({"before": text[at:start], "pii_type": name, "original": original})
                at = end
            names = ("ord", "pii_type", "start_pos", "end_pos", "original", "confidence")
            rows.append(([dict(zip(names, s, strict=True)) for s in spans], kept, text[at:] if kept else None))
        return pd.DataFrame(rows, columns=["spans", "kept", "rest"])

    return find


def masked_sql(kind: str, v: str) -> str:
    """Replacement that keeps what the type of the value allows to show."""
    digits = f"regexp_replace({v}, '[^0-9]', '')"
    secrets = ", ".join(f"'{s}'" for s in SECRETS)
    return f"""
    CASE
      WHEN {kind} = 'email' THEN concat(
        IF(length(split_part({v}, '@', 1)) > 1,
           concat(left({v}, 1), repeat('*', least(length(split_part({v}, '@', 1)) - 1, 5))), '*'),
        '@', split_part({v}, '@', 2))
      WHEN {kind} = 'phone' AND length({digits}) >= 4 THEN concat('***-***-', right({digits}, 4))
      WHEN {kind} = 'ssn' THEN concat('***-**-', right({v}, 4))
      WHEN {kind} = 'credit_card' AND length({digits}) >= 4
        THEN concat(repeat('*', length({digits}) - 4), right({digits}, 4))
      WHEN {kind} = 'ip_address' THEN concat(split_part({v}, '.', 1), '.', split_part({v}, '.', 2), '.***.***')
      WHEN {kind} IN ({secrets}) AND length({v}) > 6
        THEN concat(left({v}, 3), repeat('*', length({v}) - 6), right({v}, 3))
      ELSE repeat('*', length({v}))
    END"""


def with_spans(df: DataFrame, text: str = "text", types=None, out: str = "spans") -> DataFrame:
    """Add the array of matches, in detector order, then by position."""
    return df.withColumn("_found", _found(df, text, types)).withColumn(out, F.col("_found.spans")).drop("_found")


def pii_matches(df: DataFrame, id_col: str = "id", text: str = "text", types=None) -> DataFrame:
    """One row per match."""
    s = with_spans(df.select(id_col, text), text, types)
    return s.select(id_col, F.inline("spans")).select(
        id_col, "pii_type", "original", F.expr(masked_sql("pii_type", "original")).alias("masked"),
        "start_pos", "end_pos", "confidence",
    )


def _replace_spans(df: DataFrame, text: str, types, replacement: str, out: str) -> DataFrame:
    """Text with every kept span replaced; `replacement` is SQL over the span `s`."""
    rebuilt = f"""
    IF(size(_found.kept) > 0,
      concat(array_join(transform(_found.kept, s -> concat(s.before, {replacement})), ''), _found.rest),
      `{text}`)"""
    return df.withColumn("_found", _found(df, text, types)).withColumn(out, F.expr(rebuilt)).drop("_found")


def mask_pii(df: DataFrame, text: str = "text", types=None, out: str = "masked") -> DataFrame:
    return _replace_spans(df, text, types, masked_sql("s.pii_type", "s.original"), out)


def redact_pii(df: DataFrame, text: str = "text", types=None, out: str = "redacted") -> DataFrame:
    return _replace_spans(df, text, types, "'[REDACTED]'", out)


def _found_types(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(spans.getField("pii_type")))


def classify_text(df: DataFrame, text: str = "text", types=None, strict: bool = False) -> DataFrame:
    """Add classification, risk level, number and types of matches, and the matches themselves.

    A match is (pii_type, masked, confidence), in detector order.  `strict` counts tokens and cloud keys among the secrets.
    """
    s = with_spans(df, text, types, "_spans").withColumn("pii_types", _found_types(F.col("_spans")))

    def has(*names):
        return F.arrays_overlap("pii_types", F.array(*[F.lit(n) for n in names]))

    secret = has("api_key", "password", "jwt", "aws_key") if strict else has("api_key", "password")
    levels = [
        (has("ssn", "credit_card"), "sensitive_pii", "critical"),
        (has("email", "phone"), "pii", "high"),
        (secret, "confidential", "high"),
        (has("ip_address"), "internal", "medium"),
    ]
    cls, risk = F.when(levels[0][0], levels[0][1]), F.when(levels[0][0], levels[0][2])
    for cond, c, r in levels[1:]:
        cls, risk = cls.when(cond, c), risk.when(cond, r)
    return (
        s.withColumn("classification", cls.otherwise("public"))
        .withColumn("risk_level", risk.otherwise("low"))
        .withColumn("pii_count", F.size("_spans"))
        .withColumn("pii_detected", F.col("pii_count") > 0)
        .withColumn("matches", F.expr(f"""transform(_spans, s -> named_struct(
            'pii_type', s.pii_type, 'masked', {masked_sql("s.pii_type", "s.original")}, 'confidence', s.confidence))"""))
        .drop("_spans")
    )


def validate_compliance(
    df: DataFrame, text: str = "text", max_pii: int = 0, allowed=None, types=None
) -> DataFrame:
    """Add `pii_count`, `compliant` and the violations."""
    s = with_spans(df, text, types, "_spans").withColumn("pii_count", F.size("_spans"))
    rules = [F.when(
        F.col("pii_count") > max_pii,
        F.struct(
            F.lit("max_pii_count").alias("rule"), F.lit(str(max_pii)).alias("expected"),
            F.col("pii_count").cast("string").alias("actual"),
            F.format_string(f"Found %d PII instances, max allowed is {max_pii}", "pii_count").alias("message"),
        ),
    )]
    if allowed is not None:
        known = F.array(*[F.lit(a) for a in sorted(allowed)]).cast("array<string>")
        extra = F.array_except(_found_types(F.col("_spans")), known)
        listed = F.array_join(extra, ", ")
        rules.append(F.when(
            F.size(extra) > 0,
            F.struct(
                F.lit("allowed_pii_types").alias("rule"), F.lit(", ".join(sorted(allowed))).alias("expected"),
                listed.alias("actual"),
                F.concat(F.lit("Found disallowed PII types: "), listed).alias("message"),
            ),
        ))
    return (
        s.withColumn("violations", F.array_compact(F.array(*rules)))
        .withColumn("compliant", F.size("violations") == 0)
        .drop("_spans")
    )


def scan_rows(df: DataFrame, id_col: str = "id", text: str = "text", types=None) -> DataFrame:
    """Per row: number of matches and matches by type, without the text."""
    s = with_spans(df.select(id_col, text), text, types)

    def count(name):
        return F.expr(f"size(filter(spans, s -> s.pii_type = '{name}'))").alias(name)

    return s.select(
        id_col, F.size("spans").alias("pii_count"), _found_types(F.col("spans")).alias("pii_types"),
        *[count(d.name) for _, d in _chosen(types)],
    )


def scan_summary(rows: DataFrame, k: int = 100) -> DataFrame:
    """One row over `scan_rows`: scanned, with PII, instances, instances by type, list truncated."""
    names = [n for n in NAMES if n in rows.columns]
    hit = F.col("pii_count") > 0
    return rows.agg(
        F.count(F.lit(1)).alias("logs_scanned"),
        F.count_if(hit).alias("logs_with_pii"),
        F.coalesce(F.sum("pii_count"), F.lit(0)).alias("total_pii_instances"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
    ).withColumn("truncated", F.col("logs_with_pii") > k)


def scan_affected(rows: DataFrame, id_col: str = "id", k: int = 100) -> DataFrame:
    """First k rows with matches."""
    return rows.where("pii_count > 0").orderBy(id_col).limit(k).select(id_col, "pii_count", "pii_types")


# Column rules of the plan templates; `apply_policy` takes their names too.
TEMPLATES = {
    "standard": {},
    "pii": {"email": "hash", "phone": "mask", "ssn": "redact"},
    "process_mining": {"user_id": "pseudonymize"},
}


def apply_policy(df: DataFrame, rules: dict[str, str] | str, salt: str = "") -> DataFrame:
    """Apply hash, mask, redact or pseudonymize to columns; absent columns are skipped.

    `rules` is a column-to-rule mapping or the name of a template.
    """
    if isinstance(rules, str):
        rules = TEMPLATES[rules]
    for column, rule in rules.items():
        if column not in df.columns:
            continue
        value = F.col(column).cast("string")
        if rule == "hash":
            df = df.withColumn(column, F.sha2(value, 256))
        elif rule == "pseudonymize":
            df = df.withColumn(column, F.sha2(F.concat(F.lit(salt), value), 256))
        elif rule == "redact":
            df = df.withColumn(column, F.when(value.isNotNull(), F.lit("[REDACTED]")))
        elif rule == "mask":
            df = mask_pii(df.withColumn(column, value), column, out=column)
        else:
            raise ValueError(f"unknown rule {rule!r}")
    return df
