"""Table schemas and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# One line of a stored minute bucket (NDJSON).
STORED_EVENT = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("app", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("facility", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("transport", T.StringType()),
    T.StructField("pattern_id", T.StringType()),
    T.StructField("occurrences", T.LongType()),
])

# ---------------------------------------------------------------------------
# Fixed values.  They must stay as they are for the results to agree.
# ---------------------------------------------------------------------------

# Severity names by PRI modulo 8.
PRI_SEVERITIES = ["emerg", "alert", "crit", "err", "warn", "notice", "info", "debug"]

# Four separate notions of "error".
DAILY_ERRORS = ["emerg", "alert", "crit", "err"]
TREND_ERRORS = ["err", "error", "crit", "critical", "alert", "emerg", "emergency"]
KPI_ERRORS = ["emerg", "alert", "crit", "err", "error"]
CHART_ERRORS = ["err", "crit", "emerg"]

# Order of highlights (lower comes first); unknown severities get 6.
HIGHLIGHT_PRIORITY = {
    "err": 0, "error": 0, "warn": 1, "warning": 1, "crit": 2, "critical": 2,
    "alert": 3, "emerg": 4, "emergency": 4, "notice": 5, "info": 6, "debug": 7,
}
HIGHLIGHT_PRIORITY_DEFAULT = 6

# Order of the issue list; unknown severities get 9.
ISSUE_PRIORITY = {
    "emerg": 0, "alert": 1, "crit": 2, "err": 3, "error": 3,
    "warn": 4, "warning": 4, "info": 5,
}
ISSUE_PRIORITY_DEFAULT = 9

# Severity to analysis level.
ANALYSIS_LEVELS = {
    "debug": "DEBUG", "info": "INFO", "notice": "INFO",
    "warn": "WARNING", "warning": "WARNING",
    "err": "ERROR", "error": "ERROR",
    "crit": "CRITICAL", "critical": "CRITICAL", "alert": "CRITICAL",
    "emerg": "CRITICAL", "emergency": "CRITICAL",
}
DEFAULT_LEVELS = ["ERROR", "CRITICAL"]

# Level words in ` - LEVEL - ` texts, tried in this order.
TEXT_LEVELS = {
    "DEBUG": "debug", "INFO": "info", "WARNING": "warn", "WARN": "warn",
    "ERROR": "err", "CRITICAL": "crit",
}

# Subscription plans: id, name, monthly price, events a day, events a month, days kept.
PLANS = [
    ("starter", "Starter", 29.0, 50_000, 1_500_000, 7),
    ("professional", "Professional", 99.0, 500_000, 15_000_000, 30),
    ("business", "Business", 299.0, 5_000_000, 150_000_000, 90),
    ("enterprise", "Enterprise", 999.0, 50_000_000, 1_500_000_000, 365),
]
