"""Line-first cleaning with Spark's own functions only.

Each line of a text that has a word is judged by itself:

* punctuation: more than `SIGN_SHARE` of its characters are signs that prose
  seldom has, or it has `LONG_LINE` words or more without a single mark that
  ends or divides a sentence;
* navigation: it has `SEPARATORS` or more menu separators;
* boilerplate: it is short and holds a stock phrase of web pages.

Failing lines are removed, and a document that loses more than `LOST_SHARE` of
the characters of its lines is rejected.  Two base rules come first: texts of
under 50 words, and texts in which over half of the words lie in three-word
windows that occur twice or more.

All steps work inside the row, so nothing is shuffled.  Equal windows are
found by sorting (hash, place) pairs of the windows of one text; hashes have
64 bits and are compared within a text only.

Defined results: a null text has no words and fails; equal rows give equal
results; an empty table gives no rows; other columns are kept by
`clean_documents` and left out by `judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
REPEATED_PERCENT = 50

SIGNS = "#*$%&|<>!=~^_{}[]\\"
SIGN_SHARE = 0.1
LONG_LINE = 80
MARKS = "[.,;:!?…。，]"
SEPARATORS = 3
SEPARATOR_SIGNS = "|»›·•"
SHORT_LINE = 120
LOST_SHARE = 0.3
# Phrases of page furniture, in lower case.
STOCK_PHRASES = [
    "accept all cookies", "all rights reserved", "click here", "cookie policy", "enable javascript",
    "log in", "lorem ipsum", "privacy policy", "read more", "sign up", "subscribe to our", "terms of use",
]


def _without(col: Column, signs: str) -> Column:
    return F.translate(col, signs, "")


def _count(col: Column, signs: str) -> Column:
    return F.length(col) - F.length(_without(col, signs))


def line_fails(line: Column) -> Column:
    """Condition: a line breaks a rule."""
    signs = _count(line, SIGNS) > F.length(line) * SIGN_SHARE
    endless = (F.length(line) > LONG_LINE) & (_count(line, " ") >= LONG_LINE - 1) & ~line.rlike(MARKS)
    menu = _count(line, SEPARATOR_SIGNS) >= SEPARATORS
    lower = F.lower(line)
    stock = F.lit(False)
    for phrase in STOCK_PHRASES:
        stock = stock | F.contains(lower, F.lit(phrase))
    return signs | endless | menu | ((F.length(line) <= SHORT_LINE) & stock)


def _measured(df: DataFrame, text: Column) -> DataFrame:
    """Add struct columns `_m` with all measures; steps are staged so that arrays are made once."""
    first = lambda a, n: F.slice(a, F.lit(1), F.greatest(n, F.lit(0)))
    staged = df.withColumn("_text", F.coalesce(text, F.lit("")))
    staged = staged.withColumn("_bare", F.trim("_text", F.lit(SPACE)))
    staged = staged.withColumn("_w", F.when(F.col("_bare") == "", F.array().cast("array<string>")).otherwise(F.split("_bare", SPACE_RUN)))
    n = F.size("_w")
    staged = staged.withColumn("_runs", first(
        F.transform("_w", lambda w, i: F.xxhash64(w, F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2))), n - 2
    ))
    staged = staged.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(A_WORD)))
    staged = staged.select(
        *df.columns, "_runs",
        n.cast("long").alias("_n"),
        F.length(F.array_join("_w", "")).cast("long").alias("_chars"),
        _count(F.col("_text"), SYMBOLS).cast("long").alias("_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_dups"),
        F.aggregate(F.transform("_lines", F.length), F.lit(0), lambda a, x: a + x).alias("_all"),
        F.filter("_lines", lambda x: ~line_fails(x)).alias("_kept_lines"),
    )
    # Only texts with a window that occurs again need their windows sorted.
    again = F.size("_runs") > F.size(F.array_distinct("_runs"))
    staged = staged.withColumn("_placed", F.when(again, F.sort_array(
        F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )))
    at = lambda k: F.get(F.col("_placed"), k).getField("h")
    repeated = F.filter("_placed", lambda p, k: F.coalesce(p["h"] == at(k - 1), F.lit(False)) | F.coalesce(p["h"] == at(k + 1), F.lit(False)))
    staged = staged.withColumn("_again", F.sort_array(F.transform(repeated, lambda p: p["i"])))
    # A window at i adds the words past the end of the window before it.
    covered = F.aggregate(
        "_again", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
    )["n"]
    kept = F.aggregate(F.transform("_kept_lines", F.length), F.lit(0), lambda a, x: a + x)
    staged = staged.withColumn("_covered", F.coalesce(covered, F.lit(0)).cast("long")).withColumn("_kept", kept)
    failed = (F.col("_n") < LEAST_WORDS) | (F.col("_covered") * 100 > F.col("_n") * REPEATED_PERCENT)
    lost = (F.col("_all") - F.col("_kept")) > F.col("_all") * LOST_SHARE
    return staged.select(*df.columns, F.struct(
        F.col("_n").alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_symbols").alias("n_symbols"),
        F.col("_dups").alias("n_dup_lines"), F.col("_covered").alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & ~lost).alias("kept"), F.col("_kept_lines").alias("kept_lines"),
    ).alias("_m"))


def judge(docs: DataFrame) -> DataFrame:
    """Measures and verdict per document: doc_id, the counts, base_failed, kept and kept_lines."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _measured(rows, F.col("text")).select("doc_id", "_m.*")


def clean_documents(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their failing lines (and lines without a word) removed from `text`."""
    rows = docs.select(F.struct("*").alias("_row"))
    # A plain filter would be pushed below the staged steps, and every step put into every use of it.
    found = F.filter(F.array(F.struct("_row", "_m")), lambda x: x["_m"]["kept"])
    passed = _measured(rows, F.col("_row.text")).select(F.inline(found))
    row = F.col("_row").withField("text", F.array_join("_m.kept_lines", "\n"))
    return passed.select(row.alias("_row")).select("_row.*")
