"""Hot groups: exact results, and no group whole in one task."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loglake.functions import selection
from loglake.functions.skew import with_group_index
from loglake.operators import dedupe, process, series, usage


@pytest.fixture(scope="module")
def hot(spark):
    """20,000 rows; key 0 holds more than half of them, with equal times in it."""
    return spark.range(20_000).select(
        F.when(F.col("id") % 5 < 3, 0).otherwise(F.col("id") % 400).alias("k"),
        (F.col("id") * 7919 % 1000).alias("v"), F.col("id"),
    )


def test_group_index_is_exact(hot):
    out = with_group_index(hot, ["k"], [F.col("v"), F.col("id")]).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.k, []).append((r.v, r.id, r.idx))
    assert len(out) == 20_000
    for rows in groups.values():
        rows.sort()
        assert [i for _, _, i in rows] == list(range(len(rows)))


def test_group_index_with_null_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    got = {(r.k, r.v): r.idx for r in with_group_index(df, ["k"], [F.col("v")]).collect()}
    assert got == {(None, 1): 0, (None, 2): 1, ("a", 3): 0}


def test_group_index_spreads_the_hot_group(hot):
    placed = hot.repartitionByRange(8, "k", "v", "id").withColumn("p", F.spark_partition_id())
    biggest = max(r["count"] for r in placed.groupBy("p").count().collect())
    assert biggest < 6_000  # the hot key alone has 12,000 rows


def test_rank_limits_apply_before_the_shuffle(hot):
    df = hot.withColumnRenamed("id", "event_id").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    plan = dedupe.sample_per_key(df, ["k"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_dedupe_combines_before_the_shuffle(spark, hot):
    df = hot.select(
        F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.col("id").alias("event_id"),
        F.col("k").cast("string").alias("pattern_id"), F.lit("m").alias("message"),
    )
    out = dedupe.dedupe_bucket(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "partial_count" in plan
    rows = {r.pattern_id: r for r in out.collect()}
    want = Counter(str(r.k) for r in hot.select("k").collect())
    assert {k: r.occurrences for k, r in rows.items()} == dict(want)
    assert rows["0"].event_id == 0


def test_admit_events_on_a_hot_tenant(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=i // 50), "big" if i % 3 else "small") for i in range(3000)]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, tenant_id string")
    lim = spark.createDataFrame([("big", 700), ("small", 5000)], "project_id string, limit long")
    out = usage.admit_events(ev, lim).collect()
    big = sorted((r.ts, r.event_id) for r in out if r.tenant_id == "big" and r.admitted)
    want = sorted((t, i) for i, t, n in rows if n == "big")[:700]
    assert big == want
    assert all(r.admitted for r in out if r.tenant_id == "small") and len(out) == 3000


def test_long_cases_in_parts(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("long", "abc"[i % 3], t0 + dt.timedelta(seconds=i), i) for i in range(1000)]
    rows += [("short", "a", t0, 5000), ("short", "b", t0 + dt.timedelta(seconds=9), 5001)]
    ev = spark.createDataFrame(rows, "case_id string, activity string, ts timestamp_ntz, event_id long")
    parts = process.traces(ev, part=64).collect()
    long = sorted((r.part, list(r.activities)) for r in parts if r.case_id == "long")
    assert sum((a for _, a in long), []) == [r[1] for r in rows[:1000]]
    assert max(len(a) for _, a in long) == 64
    edges = {(r.from_activity, r.to_activity): r["count"] for r in process.directly_follows(ev, part=64).collect()}
    want = Counter((a[1], b[1]) for a, b in zip(rows[:999], rows[1:1000]))
    want[("a", "b")] += 1
    assert edges == dict(want)


def test_variants_of_split_cases(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for case, seq in (("x", "ab" * 40), ("y", "ab" * 40), ("z", "ab" * 39 + "ba")):
        rows += [(case, a, t0 + dt.timedelta(seconds=i), i) for i, a in enumerate(seq)]
    ev = spark.createDataFrame(rows, "case_id string, activity string, ts timestamp_ntz, event_id long")
    got = process.variants(process.traces(ev, part=10)).collect()
    assert Counter((tuple(r.example_case_ids), r.case_count) for r in got) == {(("x", "y"), 2): 8, (("z",), 1): 8}


def test_quartiles_of_a_long_series(spark):
    df = spark.range(5001).select(
        F.lit("s").alias("series"), (F.col("id") * 37 % 5001).cast("double").alias("value"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("ts"),
    )
    r = series.anomalies_iqr(df, 0.1).select("expected_low", "expected_high").first()
    assert (r.expected_low, r.expected_high) == (1250 - 250.0, 3750 + 250.0)


@pytest.mark.parametrize("small", [50_000, 300, 20])
def test_order_values_by_counting(spark, small):
    rng = random.Random(7)
    groups = {
        "smooth": [rng.gauss(0, 1) for _ in range(6000)], "few": [float(rng.randrange(3)) for _ in range(4000)],
        "tail": [rng.paretovariate(0.2) for _ in range(3000)] + [1e300, -1e300], "one": [5.0] * 2500,
        "nulls": [None] * 700 + [float(i) for i in range(900)], "none": [None] * 12, "short": [2.0, 1.0],
        "nan": [float("nan")] * 400 + [float(i % 50) for i in range(800)],
    }
    rows = [(k, v) for k, values in groups.items() for v in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "series string, value double").repartition(5)
    n = F.col("n")
    got = selection.order_values(df, "series", "value", {"a": F.floor(n / 4), "b": F.floor(3 * n / 4), "c": n - 1, "d": n}, small)
    for r in got.collect():
        values = sorted(groups[r.series], key=lambda v: (v is not None, v != v, 0 if v is None or v != v else v))
        want = [values[len(values) // 4], values[3 * len(values) // 4], values[-1], None]
        assert r.n == len(values) and repr([r.a, r.b, r.c, r.d]) == repr(want), r.series
    assert selection.order_values(df.limit(0), "series", "value", {"a": n}, small).count() == 0
