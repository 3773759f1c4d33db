"""Headline measures: prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores).  Every query
runs once to warm up, then BENCH_REPEAT times; the median counts.  Results go
to Spark's `noop` sink, so all rows are computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import functions as F

from loglake.functions.columns import ntz
from loglake.operators import compliance, dedupe, parse, process, rollup, search, series
from loglake.session import build_session, scratch, stored
from loglake.sources import storage, views

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEAT = int(os.environ.get("BENCH_REPEAT", "3"))
NOW = "2024-01-31 00:00:00"


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]", "loglake-bench",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    # Inputs a collector would have left behind: raw lines, stored events, minute counts.
    # The given tables are one small file each; more files let all cores read.
    logs = stored(views.logs(spark, SF_DIR).repartition(int(CPUS)), "logs")
    raw = scratch(spark, "raw")
    views.with_raw(logs).select(F.col("raw").alias("value"), "transport").write.partitionBy("transport").text(raw)
    patterned = stored(parse.with_pattern_id(logs), "patterned")
    minutes = stored(rollup.minute_stats(patterned), "minutes")
    events, chars = logs.count(), views.texts(spark, SF_DIR).agg(F.sum(F.octet_length("text"))).first()[0]
    points = views.metric_points(spark, SF_DIR)
    cases = views.process_events(spark, SF_DIR)
    texts = stored(views.texts(spark, SF_DIR).repartition(int(CPUS)), "texts")

    def ingest():
        lines = storage.read_raw_lines(spark, raw)
        return dedupe.dedupe_bucket(parse.with_pattern_id(parse.parse_logs(lines, year=2024, now=NOW)))

    def variants():
        return process.variants(stored(process.traces(cases), "traces"), 50)

    headline = {
        "ingest_parse_normalise_dedupe": ingest,
        "minute_stats": lambda: rollup.minute_stats(patterned),
        "minute_highlights": lambda: rollup.minute_highlights(patterned),
        "hourly_to_daily": lambda: rollup.daily_stats(rollup.hourly_stats(minutes), exact=False),
        "search_24h": lambda: search.search_logs(patterned, "request_id=r1", ntz(NOW), hours=24),
        "error_rate_chart": lambda: rollup.chart_error_rate(logs),
        "pii_scan_documents": lambda: compliance.scan_rows(texts),
        "pii_mask_documents": lambda: compliance.mask_pii(texts),
        "zscore_all_series": lambda: series.anomalies_zscore(points),
        "linear_forecast_all_series": lambda: series.forecast_linear(points),
        "process_variants": variants,
    }
    took = {}
    for name, query in headline.items():
        run(query())
        times = []
        for _ in range(REPEAT):
            begin = time.perf_counter()
            run(query())
            times.append(time.perf_counter() - begin)
        took[name] = round(statistics.median(times), 4)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 4), "unit": "sec",
        "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS),
        "ingest_events_per_sec": round(events / took["ingest_parse_normalise_dedupe"]),
        "pii_scan_mb_per_sec": round(chars / 1e6 / took["pii_scan_documents"], 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
