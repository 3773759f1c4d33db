"""DuckDB texts of the views and of the masking steps, shared by the checks."""

LOGS = """
logs AS (
  SELECT event_id, ts, concat('t', user_id % 4) AS tenant_id, concat('host-', user_id % 20) AS host,
    event_type AS app,
    CASE WHEN event_type = 'error' AND value >= 100 THEN 'crit' WHEN event_type = 'error' THEN 'err'
         WHEN event_type = 'signup' THEN 'warn' WHEN event_type = 'purchase' THEN 'notice'
         ELSE 'info' END AS severity,
    cast(user_id % 24 AS VARCHAR) AS facility,
    concat(event_type, ' request_id=r', user_id, ' from 10.0.', user_id % 256, '.', event_id % 256,
           ' props ', props) AS message,
    CASE WHEN event_id % 2 = 0 THEN 'udp' ELSE 'tcp' END AS transport
  FROM events)"""

UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
MAC = r"\b[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
HEX_RUN = r"\b[0-9a-fA-F]{16,}\b"


# White space of any script, and the separator controls.
SPACES = r"[\s\x0b\p{Z}\x{85}\x1c-\x1f]+"


def sub(expr: str, pattern: str, word: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', '{word}', 'g')"


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{SPACES}', ' ', 'g'))"


def mask(expr: str) -> str:
    for pattern, word in [
        (UUID, "UUID"), (MAC, "MAC"), (IPV4, "IP"), (HEX_RUN, "HEX"),
        ('"[^"]{5,}"', '"STR"'), (r"\b0x[0-9a-fA-F]+\b", "0xHEX"), (r"\b\d+\b", "N"),
    ]:
        expr = sub(expr, pattern, word)
    return squeeze(expr)


def plain_pattern(expr: str) -> str:
    return mask(squeeze(sub(expr, r"\p{Nd}+", "N")))


PATTERNS = LOGS + f""",
norm AS (SELECT *, {plain_pattern('message')} AS pattern FROM logs),
pat AS (SELECT *, sha1(to_json({{'facility': facility, 'message': pattern, 'severity': severity}}))
        AS pattern_id FROM norm)"""

SERIES = """
series AS (SELECT event_type AS series, date_trunc('hour', ts) AS ts, cast(count(*) AS DOUBLE) AS value
           FROM events GROUP BY 1, 2)"""


def typed(sql: str, **types: str) -> str:
    """The SQL with the named columns cast, where DuckDB's own types are wider than Spark's."""
    casts = ", ".join(f'cast("{c}" AS {t}) AS "{c}"' for c, t in types.items())
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"
