"""Checked queries: parsing, patterns, rules, de-duplication, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedupe, parse
from ..operators.parse import Rule
from ..sources import views
from .oracle_views import IPV4, LOGS, PATTERNS, mask, plain_pattern, squeeze, sub, typed

RULES = [
    Rule("props \\{\"k\": 7", "ALLOW"),
    Rule("^view .*k\": 1", "SUPPRESS"),
    Rule("^error", "RECLASSIFY", new_level="WARNING", extra_fields={"type": "app_error"}),
    Rule("r1[0-9]* ", "RECLASSIFY", extra_fields={"group": "one"}),
    Rule("k\": 2", "SUPPRESS"),
]


def patterned(spark, d):
    """Logs with pattern and pattern_id."""
    return parse.with_pattern_id(views.logs(spark, d))


def _lines(spark, d):
    raw = views.with_raw(views.logs(spark, d))
    return raw.select(
        "event_id", F.col("raw").alias("value"), F.lit("10.9.9.9").alias("sender"), "transport"
    )


def b1_parse_logs(spark, d):
    return parse.parse_logs(_lines(spark, d), year=2024, now="2024-01-31 00:00:00").select(
        "event_id", "ts", "host", "app", "severity", "facility", "message", "transport"
    )


def b2_level_fallback(spark, d):
    ev = views.table(spark, d, "events")
    word = F.element_at(
        F.array(*[F.lit(w) for w in ("DEBUG", "INFO", "WARNING", "WARN", "ERROR", "CRITICAL", "TRACE")]),
        (F.col("user_id") % 7 + 1).cast("int"),
    )
    lines = ev.select(
        "event_id",
        F.concat(F.lit("2024-01-05T10:00:00Z svc - "), word, F.lit(" - "), "event_type").alias("value"),
        F.lit("h").alias("sender"), F.lit("udp").alias("transport"),
    )
    return parse.parse_logs(lines, year=2024, now="2024-01-31 00:00:00", app_level_fallback=True).select(
        "event_id", "ts", "severity", "host", "message"
    )


def b3_mask_tokens(spark, d):
    return parse.mask_tokens(views.logs(spark, d)).select("event_id", "message")


def b3_mask_documents(spark, d):
    return parse.mask_tokens(views.texts(spark, d), "text").select(
        "id", F.md5("text").alias("masked_md5"), F.length("text").alias("masked_chars")
    )


def b4_normalize_messages(spark, d):
    return parse.normalize_messages(views.logs(spark, d)).select("event_id", "pattern")


def _json_logs(spark, d):
    ev = views.table(spark, d, "events")
    body = F.concat(
        F.lit("user "), "user_id", F.lit(" hit (3, 4), , at 0x1f after "), F.col("event_id") % 50, F.lit(" ms")
    )
    return ev.select(
        "event_id",
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"c": "'), "event_type", F.lit('", "msg": "'), body, F.lit('"}')))
        .when(F.col("event_id") % 4 == 1, F.concat(
            F.lit('{"c": "NET", "attr": {"message": {"msg": "'), body, F.lit('"}}, "msg": "hidden"}')))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"msg": {"msg": "'), body, F.lit('"}}')))
        .otherwise(F.concat(F.lit('{"broken": '), body)).alias("message"),
    )


def b4_normalize_json(spark, d):
    return parse.normalize_messages(_json_logs(spark, d)).select("event_id", "pattern")


def b4_mask_first(spark, d):
    df = views.logs(spark, d).withColumn(
        "message", F.concat("message", F.lit(" at "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    return parse.normalize_messages(df, mask_first=True).select("event_id", "pattern")


_OTHER_DIGITS = "\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669"


def _foreign_logs(spark, d):
    """Numbers in other digits after no-break spaces; every third message is JSON with a tail."""
    number = F.translate(F.col("user_id").cast("string"), "0123456789", _OTHER_DIGITS)
    text = F.concat("event_type", F.lit("\u00a0\u2003took "), number, F.lit(" ms"))
    tail = F.concat(F.lit('{"c": "X", "msg": "'), "event_type", F.lit('"} trailing '), F.col("user_id").cast("string"))
    return views.table(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, tail).otherwise(text).alias("message")
    )


def b4_normalize_unicode(spark, d):
    return parse.normalize_messages(_foreign_logs(spark, d)).select("event_id", "pattern")


def b5_pattern_id(spark, d):
    return patterned(spark, d).select("event_id", "pattern_id")


def b6_clean_messages(spark, d):
    df = _json_logs(spark, d).withColumn(
        "message",
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("<3> svc[12] "), "message")).otherwise(F.col("message")),
    )
    return parse.clean_messages(df).select("event_id", "clean")


def b6_clean_documents(spark, d):
    return parse.clean_messages(views.texts(spark, d), "text").select("id", F.md5("clean").alias("clean_md5"))


def b7_apply_rules(spark, d):
    out = parse.apply_rules(views.logs(spark, d), RULES)
    return out.select(
        "event_id", "severity",
        F.coalesce(F.col("extra")["type"], F.lit("")).alias("x_type"),
        F.coalesce(F.col("extra")["group"], F.lit("")).alias("x_group"),
    )


def b8_metric_series(spark, d):
    ev = views.table(spark, d, "events")
    return parse.to_metric_series(
        ev, "hour", F.round(F.avg("value"), 6), by="event_type", fill_gaps=True, fill_value=-1.0
    )


def b9_case_ids(spark, d):
    df = views.logs(spark, d).withColumn(
        "message",
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("SESSION: s-"), "host", F.lit(" order_id=o7"))).when(
            F.col("event_id") % 3 == 1, F.col("message")
        ).otherwise("nothing to see"),
    )
    return parse.extract_case_ids(df).select("event_id", "case_id")


def c1_dedupe(spark, d):
    return dedupe.dedupe_bucket(patterned(spark, d), "hour").select(
        "bucket", "pattern_id", "event_id", "ts", "host", "app", "occurrences"
    )


def c2_occurrences(spark, d):
    return dedupe.occurrence_counts(patterned(spark, d), "hour")


def c3_sample(spark, d):
    return dedupe.sample_per_key(views.logs(spark, d), n=5, seed=7, by_md5=True).select(
        "host", "severity", "app", "event_id"
    )


def c4_latest_version(spark, d):
    orders = views.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return dedupe.latest_version(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


QUERIES = {f.__name__: f for f in (
    b1_parse_logs, b2_level_fallback, b3_mask_tokens, b3_mask_documents, b4_normalize_messages,
    b4_normalize_json, b4_normalize_unicode, b4_mask_first, b5_pattern_id, b6_clean_messages, b6_clean_documents,
    b7_apply_rules, b8_metric_series, b9_case_ids, c1_dedupe, c2_occurrences, c3_sample,
    c4_latest_version,
)}

_BODY = "concat('user ', user_id, ' hit (3, 4), , at 0x1f after ', event_id % 50, ' ms')"
_JSON_LOGS = f"""
jl AS (SELECT event_id, CASE event_id % 4
  WHEN 0 THEN concat('{{"c": "', event_type, '", "msg": "', {_BODY}, '"}}')
  WHEN 1 THEN concat('{{"c": "NET", "attr": {{"message": {{"msg": "', {_BODY}, '"}}}}, "msg": "hidden"}}')
  WHEN 2 THEN concat('{{"msg": {{"msg": "', {_BODY}, '"}}}}')
  ELSE concat('{{"broken": ', {_BODY}) END AS message, event_type, {_BODY} AS body FROM events)"""


def _json_body(e):
    e = sub(e, r"\b\d+\b", "N")
    e = sub(e, r"\(N, N\)", "")
    e = sub(e, r"0x[0-9a-fA-F]+", "0xHEX")
    e = sub(e, r",\s*,", ",")
    return mask(squeeze(e))


_ZT = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.\d]*"

ORACLES = {
    "b1_parse_logs": f"""WITH {LOGS} SELECT event_id, date_trunc('second', ts) AS ts, host, app, severity,
        facility, message, transport FROM logs""",
    "b2_level_fallback": """SELECT event_id, TIMESTAMP '2024-01-05 10:00:00' AS ts,
        CASE user_id % 7 WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'warn' WHEN 3 THEN 'warn'
          WHEN 4 THEN 'err' WHEN 5 THEN 'crit' ELSE 'info' END AS severity,
        '2024-01-05T10:00:00Z' AS host,
        concat('2024-01-05T10:00:00Z svc - ',
          ['DEBUG','INFO','WARNING','WARN','ERROR','CRITICAL','TRACE'][user_id % 7 + 1], ' - ', event_type) AS message
        FROM events""",
    "b3_mask_tokens": f"WITH {LOGS} SELECT event_id, {mask('message')} AS message FROM logs",
    "b3_mask_documents": f"""SELECT doc_id AS id, md5(m) AS masked_md5, length(m) AS masked_chars
        FROM (SELECT doc_id, {mask('text')} AS m FROM documents)""",
    "b4_normalize_messages": f"WITH {LOGS} SELECT event_id, {plain_pattern('message')} AS pattern FROM logs",
    "b4_normalize_json": f"""WITH {_JSON_LOGS} SELECT event_id, CASE event_id % 4
        WHEN 0 THEN concat(event_type, ':', {_json_body('body')})
        WHEN 1 THEN concat('NET:', {_json_body('body')})
        WHEN 2 THEN {_json_body('body')}
        ELSE {plain_pattern('message')} END AS pattern FROM jl""",
    "b4_normalize_unicode": f"""WITH fl AS (SELECT event_id, CASE WHEN event_id % 3 = 0
          THEN concat('{{"c": "X", "msg": "', event_type, '"}} trailing ', user_id)
          ELSE concat(event_type, chr(160), chr(8195), 'took ', translate(cast(user_id AS VARCHAR), '0123456789', '{_OTHER_DIGITS}'), ' ms')
          END AS message FROM events) SELECT event_id, {plain_pattern('message')} AS pattern FROM fl""",
    "b4_mask_first": f"""WITH {LOGS} SELECT event_id, {sub(mask(sub(
        "concat(message, ' at ', strftime(ts, '%Y-%m-%d %H:%M:%S'))", _ZT, 'TIMESTAMP')), chr(92) + 'd+', 'N')}
        AS pattern FROM logs""",
    "b5_pattern_id": f"WITH {PATTERNS} SELECT event_id, pattern_id FROM pat",
    "b6_clean_messages": f"""WITH {_JSON_LOGS} SELECT event_id, CASE event_id % 4
        WHEN 0 THEN body WHEN 1 THEN concat('NET: ', body) WHEN 2 THEN body
        ELSE concat('{{"broken": ', body) END AS clean FROM jl""",
    "b6_clean_documents": r"""
        WITH a AS (SELECT doc_id, CASE WHEN position('] ' IN text) > 0
              THEN substring(text, position('] ' IN text) + 2) ELSE text END AS t FROM documents),
        b AS (SELECT doc_id, regexp_replace(replace(t, '  ', ' '), '^\s+|\s+$', '', 'g') AS t FROM a),
        c AS (SELECT doc_id, t, CASE WHEN position('. ' IN t) > 0 THEN split_part(t, '. ', 1)
            WHEN position('! ' IN t) > 0 THEN split_part(t, '! ', 1)
            WHEN position('? ' IN t) > 0 THEN split_part(t, '? ', 1)
            WHEN position(chr(10) IN t) > 0 THEN split_part(t, chr(10), 1)
            WHEN position('; ' IN t) > 0 THEN split_part(t, '; ', 1) ELSE t END AS s FROM b)
        SELECT doc_id AS id, md5(CASE WHEN length(t) > 1000 THEN
            CASE WHEN length(s) > 500 THEN concat(left(s, 497), '...') ELSE s END ELSE t END) AS clean_md5 FROM c""",
    "b7_apply_rules": f"""WITH {LOGS}, m AS (SELECT *,
          contains(message, 'props {{"k": 7') AS allow,
          regexp_matches(message, '^view .*k": 1') AS s1, starts_with(message, 'error') AS r1,
          regexp_matches(message, 'r1[0-9]* ') AS r2, contains(message, 'k": 2') AS s2 FROM logs)
        SELECT event_id, CASE WHEN r1 AND NOT allow THEN 'warning' ELSE severity END AS severity,
          CASE WHEN r1 AND NOT allow THEN 'app_error' ELSE '' END AS x_type,
          CASE WHEN r2 AND NOT allow THEN 'one' ELSE '' END AS x_group
        FROM m WHERE allow OR NOT (s1 OR s2)""",
    "b8_metric_series": """WITH p AS (SELECT event_type AS series, date_trunc('hour', ts) AS ts,
            round(avg(value), 6) AS value FROM events GROUP BY 1, 2),
        g AS (SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM p GROUP BY series)
        SELECT series, ts, coalesce(value, -1.0) AS value FROM g LEFT JOIN p USING (series, ts)""",
    "b9_case_ids": f"""WITH {LOGS} SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('s-', host)
          ELSE regexp_extract(message, 'request_id=([a-z0-9]+)', 1) END AS case_id
        FROM logs WHERE event_id % 3 < 2""",
    "c1_dedupe": f"""WITH {PATTERNS}, r AS (SELECT date_trunc('hour', ts) AS bucket, pattern_id, event_id, ts, host, app,
          count(*) OVER (PARTITION BY date_trunc('hour', ts), pattern_id) AS occurrences,
          row_number() OVER (PARTITION BY date_trunc('hour', ts), pattern_id ORDER BY ts, event_id) AS rn FROM pat)
        SELECT bucket, pattern_id, event_id, ts, host, app, occurrences FROM r WHERE rn = 1""",
    "c2_occurrences": f"""WITH {PATTERNS} SELECT date_trunc('hour', ts) AS bucket, pattern_id,
        count(*) AS occurrences FROM pat GROUP BY 1, 2""",
    "c3_sample": f"""WITH {LOGS} SELECT host, severity, app, event_id FROM logs
        QUALIFY row_number() OVER (PARTITION BY host, severity, app
          ORDER BY md5(concat(event_id, '|7')), event_id) <= 5""",
    "c4_latest_version": """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
}

# Column types as Spark has them.
for _name, _types in {
    "b3_mask_documents": {'masked_chars': 'INTEGER'},
}.items():
    ORACLES[_name] = typed(ORACLES[_name], **_types)
