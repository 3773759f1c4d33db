"""Message text: masking of variable parts, patterns, display form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns (they define pattern ids, so they must not change).
ISO_TIMESTAMP = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})"
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
MAC = r"\b[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}\b"
IPV4 = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
HEX_RUN = r"\b[0-9a-fA-F]{16,}\b"
QUOTED = r'"[^"]{5,}"'
HEX_NUMBER = r"\b0x[0-9a-fA-F]+\b"
WHOLE_NUMBER = r"(?U)\b\d+\b"
DIGITS = r"\p{Nd}+"
# White space of any script, and the separator controls.
SPACES = r"[\s\p{Z}\x85\x1c-\x1f]+"
ZONED_TIMESTAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.\d]*[+-]\d{2}:\d{2}"
PLAIN_TIMESTAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.\d]*"

# Masks in the order they apply: (pattern, replacement, needs a digit to match).
MASKS = [
    (UUID, "UUID", False),
    (MAC, "MAC", False),
    (IPV4, "IP", True),
    (HEX_RUN, "HEX", False),
    (QUOTED, '"STR"', False),
    (HEX_NUMBER, "0xHEX", True),
    (WHOLE_NUMBER, "N", True),
]

# Clean-up of the message field of JSON logs, in order.
JSON_CLEANUP = [
    (WHOLE_NUMBER, "N"),
    (r"\(N, N\)", ""),
    (r"ts_sec:N|ts_usec:N", ""),
    (r"0x[0-9a-fA-F]+", "0xHEX"),
    (r'thread:"[^"]*"', ""),
    (r'session_name:"[^"]*"', ""),
    (r",\s*,", ","),
]


def squeeze(col: Column) -> Column:
    """Whitespace runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(col, SPACES, " "))


def strip(col: Column) -> Column:
    """Remove all kinds of white space at both ends."""
    return F.trim(col, F.lit(" \t\n\r\f\x0b"))


def mask_variable_parts(col: Column, digits_gone: bool = False) -> Column:
    """Replace ids, addresses and numbers by fixed words.

    With `digits_gone` the text holds no digits any more and its white space
    is squeezed already: masks that need a digit cannot match and are left out
    of the plan, and the others bring in no white space.
    """
    for pattern, word, needs_digit in MASKS:
        if not (digits_gone and needs_digit):
            col = F.regexp_replace(col, pattern, word)
    return col if digits_gone else squeeze(col)


def json_object(col: Column) -> Column:
    """Condition: the text is one JSON object and nothing more.

    Spark's JSON functions stop reading after the first value, so the text is
    looked at inside an array, which must then hold one element, and inside an
    object: text behind the object breaks one of them.
    """
    inside = F.from_json(F.concat(F.lit("["), col, F.lit("]")), "array<string>")
    return (
        col.rlike(r"^\s*\{") & F.get_json_object(col, "$").isNotNull() & (F.size(inside) == 1)
        & F.get_json_object(F.concat(F.lit('{"v":'), col, F.lit("}")), "$").isNotNull()
    )


def json_message(col: Column) -> Column:
    """The message text inside a JSON log, '' when there is none.

    `attr.message.msg` is used when `attr` is an object (and then hides a
    top-level `msg`); otherwise `msg`, or `msg.msg` when `msg` is an object.
    """
    attr = F.get_json_object(col, "$.attr")
    msg = F.get_json_object(col, "$.msg")
    nested = F.when(
        F.get_json_object(col, "$.attr.message").startswith("{"),
        F.get_json_object(col, "$.attr.message.msg"),
    )
    direct = F.when(msg.startswith("{"), F.get_json_object(col, "$.msg.msg")).otherwise(msg)
    return F.coalesce(F.when(attr.startswith("{"), nested).otherwise(direct), F.lit(""))


def plain_pattern(col: Column, mask_first: bool = False) -> Column:
    """Pattern of a plain text.

    Digit runs become N before anything else, which is what keeps the pattern
    of two messages equal; `mask_first` masks whole tokens first.
    """
    if mask_first:
        col = F.regexp_replace(col, ZONED_TIMESTAMP, "TIMESTAMP")
        col = F.regexp_replace(col, PLAIN_TIMESTAMP, "TIMESTAMP")
        return F.regexp_replace(mask_variable_parts(col), DIGITS, "N")
    return mask_variable_parts(squeeze(F.regexp_replace(col, DIGITS, "N")), digits_gone=True)


def json_pattern(body: Column) -> Column:
    """Pattern of the message text of a JSON log."""
    for pattern, word in JSON_CLEANUP:
        body = F.regexp_replace(body, pattern, word)
    return mask_variable_parts(squeeze(body))


def with_pattern(df: DataFrame, col: str, out: str, mask_first: bool = False) -> DataFrame:
    """Add the pattern of a message: `component:text` for JSON logs, else the plain pattern.

    The JSON steps run only on JSON rows, inside a lambda.  Spark evaluates
    lambdas outside whole-stage code; inline, this rare branch would make the
    generated method too long for the JIT and slow down every row.
    """
    text = F.col(col)
    is_json = F.col("_json")

    def body_of(message):
        return json_pattern(json_message(message))

    staged = df.withColumn("_json", json_object(text)).withColumns({
        "_component": F.when(is_json, F.coalesce(F.get_json_object(text, "$.c"), F.lit(""))),
        "_body": F.when(is_json, F.get(F.transform(F.array(text), lambda m: body_of(m)), F.lit(0))),
    })
    component, body = F.col("_component"), F.col("_body")
    return staged.withColumn(
        out,
        F.when((component != "") & (body != ""), F.concat(component, F.lit(":"), body))
        .when(component != "", component)
        .when(body != "", body)
        .otherwise(plain_pattern(text, mask_first)),
    ).drop("_json", "_component", "_body")


def pattern_hash(facility: Column, pattern: Column, severity: Column) -> Column:
    """sha1 of the compact JSON of (facility, message, severity)."""
    return F.sha1(
        F.to_json(
            F.struct(
                facility.alias("facility"), pattern.alias("message"), severity.alias("severity")
            )
        )
    )


def display_message(col: Column) -> Column:
    """Short form of a message for reports."""
    text = F.when(F.instr(col, "] ") > 0, F.substr(col, F.instr(col, "] ") + 2)).otherwise(col)
    from_json = F.get(F.transform(F.array(text), lambda t: _json_display(t)), F.lit(0))
    plain = _plain_display(text)
    return F.when(json_object(text), F.coalesce(from_json, plain)).otherwise(plain)


def _json_display(text: Column) -> Column:
    """The telling field of a JSON log, null when it has none."""
    c = F.get_json_object(text, "$.c")
    attr_message = F.get_json_object(text, "$.attr.message")
    attr_msg = F.get_json_object(text, "$.attr.message.msg")
    attr_short = F.when(F.length(attr_msg) > 2000, F.split_part(attr_msg, F.lit(","), F.lit(1))).otherwise(attr_msg)
    msg = F.get_json_object(text, "$.msg")
    msg_msg = F.get_json_object(text, "$.msg.msg")
    message = F.get_json_object(text, "$.message")
    message_msg = F.get_json_object(text, "$.message.msg")
    return (
        F.when(
            F.get_json_object(text, "$.attr").startswith("{")
            & attr_message.startswith("{") & attr_msg.isNotNull(),
            F.substring(F.concat(F.coalesce(c, F.lit("")), F.lit(": "), attr_short), 1, 1000),
        )
        .when(msg.isNotNull() & ~msg.startswith("{"), F.substring(msg, 1, 1000))
        .when(msg_msg.isNotNull(), F.substring(msg_msg, 1, 1000))
        .when(message.startswith("{") & message_msg.isNotNull(), F.substring(message_msg, 1, 1000))
        .when(message.isNotNull(), F.substring(message, 1, 1000))
        .when(c.isNotNull(), F.substring(c, 1, 80))
    )


def _plain_display(text: Column) -> Column:
    """Text as it is up to 1000 characters, else its first sentence, cut at 500."""
    plain = strip(F.replace(text, F.lit("  "), F.lit(" ")))
    first = None
    for sep in [". ", "! ", "? ", "\n", "; "]:
        hit = F.instr(plain, sep) > 0
        cut = F.split_part(plain, F.lit(sep), F.lit(1))
        first = F.when(hit, cut) if first is None else first.when(hit, cut)
    sentence = first.otherwise(plain)
    shortened = F.when(
        F.length(sentence) > 500, F.concat(F.substring(sentence, 1, 497), F.lit("..."))
    ).otherwise(sentence)
    return F.when(F.length(plain) > 1000, shortened).otherwise(plain)


def clip(col: Column, n: int) -> Column:
    """Cut to n - 30 characters and add a marker, if longer than n."""
    return F.when(
        F.length(col) > n, F.concat(F.substring(col, 1, n - 30), F.lit("\n... truncated ..."))
    ).otherwise(col)
