"""Checked queries: time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import bucket_of, ntz
from ..operators import parse, series
from ..session import scratch
from ..sources import views
from .oracle_views import SERIES, typed


def points(spark, d):
    return views.metric_points(spark, d)


def mixed(spark, d):
    """Hourly counts per type (720 points) and daily counts per host (30 points)."""
    daily = parse.to_metric_series(views.logs(spark, d), "day", by="host")
    return points(spark, d).unionByName(daily)


def rounded(df, *cols, places=4):
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c) + 0.0, places))
    return df


def h1_keep_last(spark, d):
    return series.keep_last(points(spark, d), 100)


def h2_zscore(spark, d):
    return rounded(series.anomalies_zscore(mixed(spark, d), 1.5), "z_score", "anomaly_score", "expected_low", "expected_high")


def h3_iqr(spark, d):
    return rounded(series.anomalies_iqr(mixed(spark, d), 0.5), "anomaly_score", "expected_low", "expected_high")


_BOUNDS = ("predicted_value", "lower_bound", "upper_bound", "confidence")


def h4_linear(spark, d):
    return rounded(series.forecast_linear(mixed(spark, d)), *_BOUNDS)


def h5_seasonal(spark, d):
    return rounded(series.forecast_seasonal(mixed(spark, d)), *_BOUNDS)


def h5_seasonal_corrected(spark, d):
    return rounded(series.forecast_seasonal(points(spark, d), corrected=True), *_BOUNDS)


def h6_pattern_changes(spark, d):
    return series.pattern_changes(points(spark, d))


def h7_health_details(spark, d):
    return series.health_details(mixed(spark, d), 1.5)


def h7_health_summary(spark, d):
    return series.health_summary(mixed(spark, d), 1.5)


_HW = ("value", "lower_bound", "upper_bound", "confidence")


def h8_holt_winters(spark, d):
    return rounded(series.holt_winters(series.keep_last(mixed(spark, d), 168)), *_HW)


def h9_moving_average(spark, d):
    return rounded(series.moving_average_forecast(mixed(spark, d), history=168), *_HW)


def h8_holt_winters_whole(spark, d):
    return rounded(series.holt_winters(mixed(spark, d)), *_HW)


def h9_moving_average_whole(spark, d):
    return rounded(series.moving_average_forecast(mixed(spark, d)), *_HW)


def h12_decompose_whole(spark, d):
    return rounded(series.decompose(points(spark, d)), "trend", "seasonal", "residual")


def _thresholds(df):
    return df.groupBy("series").agg((F.max("value") * 0.9).alias("threshold"))


def h10_capacity_breach(spark, d):
    df = mixed(spark, d)
    out = series.capacity_breach(df, _thresholds(df), 2000)
    return rounded(out, "predicted_value", "threshold", "hours_to_breach").select(
        "series", "current_value", "predicted_value", "threshold", "hours_to_breach",
        bucket_of(F.col("predicted_breach_time"), "hour").alias("breach_hour"), "severity", "recommendation",
    )


def h11_detect_trend(spark, d):
    return rounded(series.detect_trend(mixed(spark, d)), "slope", "r_squared", "predicted_24h")


def h12_decompose(spark, d):
    return rounded(series.decompose(series.keep_last(points(spark, d), 168)), "trend", "seasonal", "residual")


def h13_write_anomalies(spark, d):
    path = scratch(spark, "anomalies")
    series.write_anomalies(series.anomalies_zscore(points(spark, d), 1.5), path, "t0")
    back = spark.read.parquet(path)
    return rounded(back, "expected_value", "deviation_score").select(
        "timestamp", "metric_name", "current_value", "expected_value", "deviation_score",
        "is_anomaly", "detection_method",
    )


def h13_write_forecasts(spark, d):
    path = scratch(spark, "forecasts")
    series.write_forecasts(series.forecast_linear(points(spark, d)), path, "t0", made_at=ntz("2024-01-31 00:00:00"))
    return rounded(spark.read.parquet(path), "predicted_value").select(
        "metric_name", "prediction_time", "predicted_value", "method"
    )


QUERIES = {f.__name__: f for f in (
    h1_keep_last, h2_zscore, h3_iqr, h4_linear, h5_seasonal, h5_seasonal_corrected, h6_pattern_changes,
    h7_health_details, h7_health_summary, h8_holt_winters, h9_moving_average, h10_capacity_breach,
    h8_holt_winters_whole, h9_moving_average_whole, h12_decompose_whole,
    h11_detect_trend, h12_decompose, h13_write_anomalies, h13_write_forecasts,
)}

MIXED = SERIES + """,
mixed AS (SELECT * FROM series UNION ALL
  SELECT concat('host-', user_id % 20), date_trunc('day', ts), cast(count(*) AS DOUBLE) FROM events GROUP BY 1, 2)"""


def _z(source, t):
    return f"""
mom AS (SELECT series, count(*) AS n, avg(value) AS mean, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1.0 END AS sd
        FROM {source} GROUP BY series HAVING count(*) >= 10),
z AS (SELECT series, ts, value, mean, sd, abs((value - mean) / sd) AS z FROM {source} JOIN mom USING (series)),
za AS (SELECT series, ts, value, mean, z AS z_score, z > {t} AS is_anomaly, 1.0 - least(z / {t}, 2.0) / 2.0 AS anomaly_score,
       mean - 2 * sd AS expected_low, mean + 2 * sd AS expected_high,
       CASE WHEN z <= {t} THEN 'low' WHEN z <= {t} * 1.5 THEN 'medium' WHEN z <= {t} * 2 THEN 'high' ELSE 'critical' END AS severity FROM z)"""


def _r(*cols):
    return ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in cols)


_LINEAR = """
fit AS (SELECT series, count(*) AS n, regr_slope(value, epoch(ts) / 60) AS slope, regr_intercept(value, epoch(ts) / 60 - 28000000) AS icpt,
        max(ts) AS last_ts FROM src GROUP BY series HAVING count(*) >= 10),
res AS (SELECT series, sqrt(avg((value - (icpt + slope * (epoch(ts) / 60 - 28000000))) ** 2)) AS sigma FROM src
        JOIN fit USING (series) GROUP BY series),
lin AS (SELECT series, last_ts + INTERVAL 1 HOUR * i AS ts, icpt + slope * (epoch(last_ts) / 60 - 28000000 + i * 60) AS predicted_value,
        sigma * (1 + 0.1 * i) AS margin, greatest(0.5, 1.0 - 0.02 * i) AS confidence, i
        FROM fit JOIN res USING (series), range(1, 25) t(i))"""
_LIN_OUT = """SELECT series, ts, round(predicted_value, 4) AS predicted_value, round(predicted_value - 2 * margin, 4) AS lower_bound,
  round(predicted_value + 2 * margin, 4) AS upper_bound, round(confidence, 4) AS confidence FROM lin"""


def _seasonal(source, shift):
    return f"""
ord AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY series) AS n FROM {source}),
st AS (SELECT series, any_value(n) AS n, avg(value) AS mean, stddev_pop(value) AS sigma, max(ts) AS last_ts,
       avg(value) FILTER (idx <= 12) AS ft, avg(value) FILTER (idx >= n - 13) AS lt FROM ord WHERE n >= 48 GROUP BY series),
ph AS (SELECT series, idx % 24 AS phase, avg(value) AS pm FROM ord GROUP BY 1, 2),
sea AS (SELECT st.series, last_ts + INTERVAL 1 HOUR * i AS ts, (lt + (lt - ft) / n * i) * (pm / mean) AS predicted_value,
        sigma * (1 + 0.15 * i) AS margin, greatest(0.4, 1.0 - 0.03 * i) AS confidence
        FROM st, range(1, 25) t(i), ph WHERE ph.series = st.series AND ph.phase = (n + i - {shift}) % 24)"""


_SEA_OUT = _LIN_OUT.replace("FROM lin", "FROM sea")

_RECENT = """
rec AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS r FROM mixed QUALIFY r <= 168),
fit AS (SELECT series, count(*) AS n, max(ts) AS last_ts, arg_max(value, ts) AS cur,
   regr_slope(value, -r) FILTER (r <= 24) AS slope, corr(value, -r) FILTER (r <= 24) ** 2 AS r2,
   avg(value) FILTER (r <= 24) AS mean, var_pop(value) FILTER (r <= 24) AS vy FROM rec GROUP BY series)"""

_MA = """ma AS (SELECT series, h AS horizon_hours, last_ts + INTERVAL 1 HOUR * h AS ts, m AS value,
   greatest(0, m - 1.96 * sd * (1 + 0.1 * sqrt(h))) AS lower_bound, m + 1.96 * sd * (1 + 0.1 * sqrt(h)) AS upper_bound,
   greatest(0.4, 0.8 - 0.02 * h) AS confidence FROM (
     SELECT series, max(ts) AS last_ts, avg(value) AS m, CASE WHEN count(*) > 1 THEN stddev_pop(value) ELSE avg(value) * 0.1 END AS sd,
       count(*) AS n FROM rec GROUP BY series), (VALUES (1), (6), (24), (72)) t(h) {where})"""
_MA_OUT = f"SELECT series, cast(horizon_hours AS INTEGER) AS horizon_hours, ts, {_r('value', 'lower_bound', 'upper_bound', 'confidence')} FROM"

ORACLES = {
    "h1_keep_last": f"WITH {SERIES} SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= 100",
    "h2_zscore": f"""WITH {MIXED}, {_z('mixed', 1.5)} SELECT series, ts, value, is_anomaly, severity,
        {_r('z_score', 'anomaly_score', 'expected_low', 'expected_high')} FROM za""",
    "h3_iqr": f"""WITH {MIXED},
        o AS (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY value, ts) - 1 AS i,
              count(*) OVER (PARTITION BY series) AS n FROM mixed),
        q AS (SELECT series, max(value) FILTER (i = n // 4) AS q1, max(value) FILTER (i = 3 * n // 4) AS q3 FROM o
              WHERE n >= 10 GROUP BY series),
        f AS (SELECT series, q3 - q1 AS iqr, q1 - 0.5 * (q3 - q1) AS lo, q3 + 0.5 * (q3 - q1) AS hi FROM q),
        g AS (SELECT series, ts, value, lo, hi, value < lo OR value > hi AS is_anomaly,
              CASE WHEN value < lo THEN CASE WHEN iqr > 0 THEN (lo - value) / iqr ELSE lo - value END
                   WHEN value > hi THEN CASE WHEN iqr > 0 THEN (value - hi) / iqr ELSE value - hi END ELSE 0 END AS dist
              FROM mixed JOIN f USING (series))
        SELECT series, ts, value, is_anomaly, round(greatest(-1.0, 1.0 - dist), 4) + 0.0 AS anomaly_score,
          round(lo, 4) + 0.0 AS expected_low, round(hi, 4) + 0.0 AS expected_high,
          CASE WHEN dist <= 0 THEN 'low' WHEN dist <= 1 THEN 'medium' WHEN dist <= 2 THEN 'high' ELSE 'critical' END AS severity FROM g""",
    "h4_linear": f"WITH {MIXED}, src AS (SELECT * FROM mixed), {_LINEAR} {_LIN_OUT}",
    "h5_seasonal": f"""WITH {MIXED}, {_seasonal('mixed', 0)}, src AS (SELECT series, ts, value FROM ord WHERE n < 48), {_LINEAR}
        {_SEA_OUT} UNION ALL {_LIN_OUT}""",
    "h5_seasonal_corrected": f"WITH {SERIES}, {_seasonal('series', 1)} {_SEA_OUT}",
    "h6_pattern_changes": f"""WITH {SERIES}, w AS (SELECT *, lag(value) OVER s AS ph, lag(value, 24) OVER s AS pd,
          row_number() OVER s AS rn FROM series WINDOW s AS (PARTITION BY series ORDER BY ts)),
        c AS (SELECT *, CASE WHEN ph > 0 THEN (value - ph) / ph ELSE 0 END AS h, CASE WHEN pd > 0 THEN (value - pd) / pd ELSE 0 END AS d
          FROM w WHERE rn > 24)
        SELECT series, ts, value AS current_count, round_even(h * 100, 1) AS hour_over_hour_change,
          round_even(d * 100, 1) AS day_over_day_change,
          CASE WHEN abs(h) > 1 OR abs(d) > 2 THEN 'high' ELSE 'medium' END AS severity FROM c WHERE abs(h) > 0.5 OR abs(d) > 1""",
    "h7_health_details": f"""WITH {MIXED}, {_z('mixed', 1.5)} SELECT series, count(*) FILTER (is_anomaly) AS anomaly_count,
        count(*) FILTER (is_anomaly AND severity = 'critical') AS critical,
        count(*) FILTER (is_anomaly AND severity = 'high') AS high, arg_max(value, ts) AS latest_value FROM za GROUP BY series""",
    "h7_health_summary": f"""WITH {MIXED}, {_z('mixed', 1.5)}, t AS (SELECT count(DISTINCT series) AS metrics_analyzed,
          count(*) FILTER (is_anomaly) AS anomaly_count, count(*) FILTER (is_anomaly AND severity = 'critical') AS critical,
          count(*) FILTER (is_anomaly AND severity = 'high') AS high FROM za)
        SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'warning' WHEN anomaly_count > 0 THEN 'degraded'
          ELSE 'healthy' END AS overall_status FROM t""",
    "h8_holt_winters": f"""WITH RECURSIVE {MIXED},
        rec AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS r FROM mixed QUALIFY r <= 168),
        vals AS (SELECT series, list(value ORDER BY ts) AS v, max(ts) AS last_ts FROM rec GROUP BY series HAVING count(*) >= 48),
        init AS (SELECT series, v, last_ts, list_sum(v[1:24]) / 24 AS lv, (list_sum(v[25:48]) - list_sum(v[1:24])) / 576 AS tr FROM vals),
        hw AS (
          SELECT series, v, last_ts, 24 AS i, lv, tr, [(v[k] + v[k + 24]) / 2 - lv FOR k IN range(1, 25)] AS s FROM init
          UNION ALL
          SELECT series, v, last_ts, i + 1, l2, 0.1 * (l2 - lv) + 0.9 * tr,
            [CASE WHEN k = i % 24 + 1 THEN 0.2 * (v[i + 1] - l2) + 0.8 * s[k] ELSE s[k] END FOR k IN range(1, 25)]
          FROM (SELECT *, 0.3 * (v[i + 1] - s[i % 24 + 1]) + 0.7 * (lv + tr) AS l2 FROM hw WHERE i < len(v))),
        fin AS (SELECT *, len(v) AS n, sqrt(list_sum([(v[len(v) + 1 - k] - (lv + s[k])) ** 2 FOR k IN range(1, 25)]) / 24) AS sg
          FROM hw WHERE i = len(v)),
        p AS (SELECT series, h, last_ts + INTERVAL 1 HOUR * h AS ts, lv + h * tr + s[(n + h) % 24 + 1] AS pt,
          1.96 * sg * (1 + 0.1 * sqrt(h)) AS mg FROM fin, (VALUES (1), (6), (24), (72)) t(h)),
        {_MA.format(where='WHERE n < 48')}
        SELECT series, cast(h AS INTEGER) AS horizon_hours, ts, round(greatest(0, pt), 4) AS value,
          round(greatest(0, pt - mg), 4) AS lower_bound, round(pt + mg, 4) AS upper_bound,
          round(greatest(0.5, 1 - 0.01 * h), 4) AS confidence FROM p
        UNION ALL {_MA_OUT} ma""",
    "h9_moving_average": f"""WITH {MIXED},
        rec AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS r FROM mixed QUALIFY r <= 168),
        {_MA.format(where='')} {_MA_OUT} ma""",
    "h10_capacity_breach": f"""WITH {MIXED}, {_RECENT}, th AS (SELECT series, max(value) * 0.9 AS threshold FROM mixed GROUP BY series),
        b AS (SELECT *, cur >= threshold AS done, CASE WHEN cur >= threshold THEN 0.0 ELSE (threshold - cur) / slope END AS hrs
          FROM fit JOIN th USING (series) WHERE n >= 12 AND (cur >= threshold OR slope > 0))
        SELECT series, cur AS current_value, round(CASE WHEN done THEN cur ELSE cur + slope * 2000 END, 4) + 0.0 AS predicted_value,
          round(threshold, 4) + 0.0 AS threshold, round(hrs, 4) + 0.0 AS hours_to_breach,
          date_trunc('hour', last_ts + to_microseconds(cast(round(hrs * 3600000000) AS BIGINT))) AS breach_hour,
          CASE WHEN done OR hrs < 12 THEN 'critical' ELSE 'warning' END AS severity,
          CASE WHEN done THEN printf('%s has already exceeded threshold (%.1f >= %.1f). Immediate action required.', series, cur, threshold)
          ELSE printf('At current rate, %s will exceed %d in approximately %d hours. Consider scaling or optimization.', series, cast(round(threshold) AS BIGINT), cast(round(hrs) AS BIGINT))
          END AS recommendation FROM b WHERE done OR hrs <= 2000""",
    "h11_detect_trend": f"""WITH {MIXED}, {_RECENT},
        t AS (SELECT series, cur, slope, mean, n >= 24 AS ok, CASE WHEN n >= 24 AND vy > 0 THEN r2 ELSE 0.0 END AS rr FROM fit),
        u AS (SELECT *, CASE WHEN ok THEN rr > 0.5 END AS sig, CASE WHEN ok THEN CASE WHEN abs(slope) < mean * 0.01 THEN 'stable'
            WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END END AS direction FROM t)
        SELECT series, CASE WHEN NOT ok THEN 'insufficient_data' WHEN sig THEN direction ELSE 'noisy' END AS trend,
          round(CASE WHEN ok THEN slope ELSE 0.0 END, 4) + 0.0 AS slope, direction,
          CASE WHEN ok THEN CASE WHEN abs(slope) < mean * 0.01 THEN 'low' WHEN abs(slope) > mean * 0.05 THEN 'high' ELSE 'moderate' END END AS magnitude,
          round(rr, 4) + 0.0 AS r_squared, sig AS significant, CASE WHEN ok THEN cur END AS current_value,
          round(CASE WHEN sig THEN cur + slope * 24 END, 4) AS predicted_24h FROM u""",
    "h12_decompose": f"""WITH {SERIES},
        rec AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS r FROM series QUALIFY r <= 168),
        o AS (SELECT *, count(*) OVER (PARTITION BY series) - r AS i, count(*) OVER (PARTITION BY series) AS n FROM rec),
        t AS (SELECT *, i % 24 AS ph, CASE WHEN i >= 12 AND i < n - 12 THEN
              avg(value) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) END AS tr FROM o WHERE n >= 48),
        s0 AS (SELECT series, ph, coalesce(avg(value - tr), 0.0) AS m FROM t GROUP BY 1, 2),
        s AS (SELECT series, ph, m - avg(m) OVER (PARTITION BY series) AS seasonal FROM s0)
        SELECT series, ts, value, round(coalesce(tr, 0.0), 4) + 0.0 AS trend, round(seasonal, 4) + 0.0 AS seasonal,
          round(coalesce(value - tr - seasonal, 0.0), 4) + 0.0 AS residual FROM t JOIN s USING (series, ph)""",
    "h13_write_anomalies": f"""WITH {SERIES}, {_z('series', 1.5)} SELECT ts AS timestamp, series AS metric_name,
        value AS current_value, round(mean, 4) AS expected_value, round(z_score, 4) AS deviation_score,
        cast(is_anomaly AS INTEGER) AS is_anomaly, 'zscore' AS detection_method FROM za""",
    "h13_write_forecasts": f"""WITH {SERIES}, src AS (SELECT * FROM series), {_LINEAR} SELECT series AS metric_name,
        ts AS prediction_time, round(predicted_value, 4) AS predicted_value, 'linear' AS method FROM lin""",
}

ORACLES |= {f"{name}_whole": ORACLES[name].replace(" QUALIFY r <= 168", "") for name in ("h8_holt_winters", "h9_moving_average", "h12_decompose")}
# Column types as Spark has them.
for _name, _types in {
    "h4_linear": {'confidence': 'DOUBLE'},
    "h5_seasonal": {'confidence': 'DOUBLE'},
    "h5_seasonal_corrected": {'confidence': 'DOUBLE'},
    "h8_holt_winters": {'confidence': 'DOUBLE'},
    "h9_moving_average": {'confidence': 'DOUBLE'},
    "h8_holt_winters_whole": {'confidence': 'DOUBLE'},
    "h9_moving_average_whole": {'confidence': 'DOUBLE'},
}.items():
    ORACLES[_name] = typed(ORACLES[_name], **_types)
