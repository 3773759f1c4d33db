"""Streams fed in several batches give the batch results."""

import datetime as dt

from pyspark.sql import functions as F

from loglake.operators import dedupe, issues, rollup, usage
from loglake.operators.parse import with_pattern_id
from loglake.schemas import DAILY_ERRORS
from loglake.session import workspace
from loglake.sources import keyed
from loglake.streaming import admission, jobs, samples

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("event_id long, ts timestamp_ntz, tenant_id string, host string, app string, severity string, "
          "facility string, message string")


def events(spark, n=600, step=60):
    rows = [(i, T0 + dt.timedelta(seconds=i * step), "t", f"h{i % 3}", "a", ("err", "info")[i % 2], "1", f"m{'x' * (i % 4)} {i}")
            for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def stream_of(spark, df, folder, parts=3):
    """The rows as files, one after another in time, read one file per batch."""
    n = df.count()
    for p in range(parts):
        lo, hi = p * n // parts, (p + 1) * n // parts
        df.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.mode("append").parquet(folder)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return jobs.event_time(with_pattern_id(s))


def run(query):
    query.awaitTermination()


def test_dedupe_equals_batch(spark, tmp_path):
    df = events(spark)
    s = jobs.stream_dedupe(stream_of(spark, df, str(tmp_path / "in")), "10 minutes")
    run(jobs.start(s, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out"))
    bucket = F.window(F.col("ts").cast("timestamp"), "10 minutes").start
    want = with_pattern_id(df).select(bucket.alias("b"), "pattern_id").distinct()
    assert got.count() == want.count()
    assert got.select(F.col("bucket.start").alias("b"), "pattern_id").exceptAll(want).count() == 0


def test_minute_stats_equal_batch(spark, tmp_path):
    df = events(spark, 300, 20)
    s = stream_of(spark, df, str(tmp_path / "in"))
    run(jobs.start_minute_stats(s, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out")).select(
        F.col("bucket").cast("timestamp_ntz").alias("bucket"), "dim", "key", "cnt")
    closed = F.lit((T0 + dt.timedelta(seconds=299 * 20 - 120)).isoformat(" ")).cast("timestamp_ntz")
    want = rollup.minute_stats(with_pattern_id(df)).where(F.col("bucket") <= closed)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_sample_equals_batch(spark, tmp_path):
    df = events(spark)
    s = stream_of(spark, df, str(tmp_path / "in"))
    run(jobs.stream_sample(s, str(tmp_path / "out"), str(tmp_path / "cp"), n=9, seed=3))
    last = spark.read.parquet(str(tmp_path / "out") + "/batch=2")
    want = dedupe.sample_per_key(df, n=9, seed=3, by_md5=True)
    assert {r.event_id for r in last.collect()} == {r.event_id for r in want.collect()}


def arrive(spark, df, folder):
    df.write.mode("append").parquet(folder)
    return jobs.event_time(spark.readStream.schema(df.schema).parquet(folder))


def test_sample_in_state_equals_batch_after_restarts(spark, tmp_path):
    odd = spark.createDataFrame(
        [(2**60 + i, T0, None, None, None, None, None, None) for i in range(12)] + [(None, None, "t", "h0", "a", "err", "1", "m")] * 2, SCHEMA)
    df = events(spark).unionByName(odd).withColumn("raw", F.encode(F.concat(F.lit("é"), F.coalesce("message", F.lit(""))), "UTF-8")).withColumn(
        "tags", F.when(F.col("host") == "h1", F.array(F.lit(None).cast("string"), F.col("app")))).persist()
    folder, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    provider = spark.conf.get(samples.PROVIDER)
    for part in range(3):
        s = arrive(spark, df.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part), folder)
        run(samples.start_sample(s, out, cp, n=9, seed=3, salts=2))
    assert spark.conf.get(samples.PROVIDER) == provider
    got = samples.current_sample(spark, out, n=9, seed=3)
    want = dedupe.sample_per_key(df.withColumn("ts", F.col("ts").cast("timestamp")), n=9, seed=3, by_md5=True)
    assert dict(got.dtypes) == dict(want.dtypes)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # What came later than the sample's marks was not written.
    written = spark.read.parquet(out)
    assert written.where("batch = 2").count() < written.where("batch = 0").count() and written.count() < df.count() / 2


def test_sampled_rows_are_few(spark, tmp_path):
    df = events(spark, 3000).withColumn("host", F.lit("hot")).withColumn("severity", F.lit("err"))
    run(samples.start_sample(stream_of(spark, df, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), n=5, salts=1))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert [written.where(f"batch = {b}").count() <= 5 for b in range(3)] == [True] * 3
    assert written.where("event_id >= 0").count() < 16


LIMITS = [("big", 500), ("small", 3), ("none", 0), ("wide", 10_000)]


def quota_events(spark, n=2400):
    """Four days of which one project has most events; some have no project, no limit or no time."""
    rows = []
    for i in range(n):
        project = "big" if i % 3 else ("small", "none", "wide", "free", None)[i % 5]
        rows.append((i, None if i % 400 == 7 else T0 + dt.timedelta(minutes=i * 2.4 // 1), project))
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, tenant_id string").persist()


def test_admission_equals_batch_after_restarts(spark, tmp_path):
    df, limits = quota_events(spark), spark.createDataFrame(LIMITS, "project_id string, limit long")
    folder, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    cuts = [0, 300, 310, 900, 1500, 2400]  # several parts of one day
    for a, b in zip(cuts, cuts[1:]):
        s = arrive(spark, df.where((F.col("event_id") >= a) & (F.col("event_id") < b)), folder)
        run(admission.start_admission(s, out, cp, limits))
    got = spark.read.parquet(f"{out}/events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "tenant_id", "admitted")
    want = usage.admit_events(df, limits)
    assert got.count() == df.count() and got.exceptAll(want).isEmpty()
    per_day = got.where("ts IS NOT NULL").groupBy("tenant_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.count_if("admitted").alias("admitted")).join(limits.withColumnRenamed("project_id", "tenant_id"), "tenant_id")
    assert per_day.where("admitted <> least(n, limit)").isEmpty() and per_day.where("n > limit AND limit > 0").count() == 4


def test_repeated_batch_decides_the_same(spark, tmp_path):
    df, limits = quota_events(spark, 600), spark.createDataFrame(LIMITS, "project_id string, limit long")
    root = str(tmp_path / "counters")

    def admit(lo, hi, batch_id):
        with workspace(spark):
            part = df.where((F.col("event_id") >= lo) & (F.col("event_id") < hi))
            rows, counters = admission.admit_batch(part, batch_id, root, limits)
            rows = sorted((r.event_id, r.admitted) for r in rows.collect())
            keyed.put_rows(counters, root, admission.KEY)
            return rows

    admit(0, 300, 0)
    first = admit(300, 600, 1)
    keyed.compact(spark, root, admission.KEY, 1)
    assert admit(300, 600, 1) == first and any(a for _, a in first) and not all(a for _, a in first)


def test_closed_days_take_no_events(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(admission, "MOST_DELTAS", 0)  # every batch leaves out the counters of closed days
    limits = spark.createDataFrame([("p", 2), ("q", 1)], "project_id string, limit long")
    folder, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    days = [[0, 0], [5], [0, 3, 5, 5], [9], [3]]
    for part, found in enumerate(days):
        rows = [(10 * part + i, T0 + dt.timedelta(days=d), "p") for i, d in enumerate(found)]
        rows += [(10 * part + 9, T0 + dt.timedelta(days=30), "q")] * (part == 0)  # a wrong clock, of another project
        s = arrive(spark, spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, tenant_id string"), folder)
        run(admission.start_admission(s, out, cp, limits, keep_days=2))
    got = {r.event_id: r.admitted for r in spark.read.parquet(f"{out}/events").collect()}
    assert got == {0: True, 1: True, 9: True, 10: True, 20: False, 21: True, 22: True, 23: False, 30: True, 40: False}
    left = keyed.read_rows(spark, f"{out}/counters", admission.KEY).collect()
    assert {(r.project_id, r.day.day, r.used) for r in left if r.day.day > 7} == {("p", 10, 1), ("q", 31, 1)}


def test_issue_state_over_several_batches(spark, tmp_path):
    """Days 1, 2, 4 of pattern p and day 1 of q arrive apart; 12 is there to move the watermark."""
    days = [(1, "p"), (1, "q"), (2, "p"), (4, "p"), (12, "z")]
    path = str(tmp_path / "in")
    for d, p in days:
        spark.createDataFrame([(T0 + dt.timedelta(days=d - 1), p, "err", 1)], "day timestamp, pattern_id string, severity string, n long"
                              ).coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema("day timestamp, pattern_id string, severity string, n long").option("maxFilesPerTrigger", 1).parquet(path)
    run(jobs.start(jobs.stream_issue_state(s, "0 seconds"), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = sorted((r.pattern_id, r.day.day, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("p", 1, "new"), ("p", 2, "ongoing"), ("p", 3, "resolved"), ("p", 4, "reopened"), ("p", 5, "resolved"),
                   ("q", 1, "new"), ("q", 2, "resolved"), ("z", 12, "new")]
    daily = spark.createDataFrame([(p, T0 + dt.timedelta(days=d - 1), "err") for d, p in days], "pattern_id string, day timestamp_ntz, severity string")
    batch = issues.issue_timeline(daily).where("pattern_id <> 'z'").collect()
    rows = [(r.pattern_id, r.day.day, r.state) for r in batch] + [(r.pattern_id, r.resolved_day.day, "resolved") for r in batch if r.resolved_day]
    assert sorted(rows) == [g for g in got if g[0] != "z"]


def test_error_pattern_days(spark, tmp_path):
    df = events(spark, 200, 3600)
    s = jobs.error_pattern_days(stream_of(spark, df, str(tmp_path / "in")), DAILY_ERRORS)
    run(jobs.start(s, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.agg(F.sum("n")).first()[0] == 8 * 12  # eight closed days, every second hour is an error
    assert got.groupBy("day", "pattern_id").count().where("count > 1").count() == 0


def test_forwarding_goes_on_when_a_sink_fails(spark, tmp_path):
    s = stream_of(spark, events(spark, 30), str(tmp_path / "in"), 1)
    out = str(tmp_path / "out")

    def broken(batch):
        raise RuntimeError("down")

    sinks = {"bad": broken, "good": lambda b: b.write.mode("append").json(out)}
    run(jobs.forward_events(s, sinks, str(tmp_path / "cp"), str(tmp_path / "dead")))
    dead = spark.read.parquet(str(tmp_path / "dead"))
    assert dead.count() == 30 and {(r.sink, r.error) for r in dead.select("sink", "error").collect()} == {("bad", "down")}
    assert spark.read.json(out).count() == 30


def test_tail_skips_bad_lines(spark, tmp_path):
    f = tmp_path / "in" / "2024" / "x.ndjson"
    f.parent.mkdir(parents=True)
    f.write_text('{"host":"a","message":"m"}\nbroken {\n')
    run(jobs.start(jobs.tail_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")))
    assert [r.host for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]
