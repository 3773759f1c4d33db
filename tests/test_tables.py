"""Issues, usage, storage, SQL surface, rollup sums, XES."""

import datetime as dt
import glob
import os
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from loglake.functions.columns import ntz, top_k
from loglake.operators import issues, parse, process, report, rollup, sql_surface, usage
from loglake.session import stored, workspace
from loglake.sources import storage
from loglake.streaming import jobs

D = dt.datetime


def day(n):
    return D(2024, 1, n)


def state(spark, *rows):
    return spark.createDataFrame(
        list(rows), "pattern_id string, first_seen timestamp_ntz, last_seen timestamp_ntz, status string, "
        "severity string, sample_message string")


def today(spark, *rows):
    return spark.createDataFrame(list(rows), "pattern_id string, day timestamp_ntz, severity string, sample_message string")


def test_upsert_keeps_first_seen(spark):
    st = state(spark, ("p1", day(1), day(1), "resolved", "err", "old"), ("p2", day(2), day(2), "active", "crit", "x"))
    out = {r.pattern_id: r for r in issues.upsert_issues(
        st, today(spark, ("p1", day(3), "crit", "new"), ("p3", day(3), "err", "y"))).collect()}
    assert (out["p1"].first_seen, out["p1"].last_seen, out["p1"].status) == (day(1), day(3), "active")
    assert (out["p1"].severity, out["p1"].sample_message) == ("crit", "new")
    assert out["p2"].last_seen == day(2) and out["p3"].first_seen == day(3)


def test_resolve_missing(spark):
    st = state(spark, ("a", day(1), day(2), "active", "err", ""), ("b", day(1), day(3), "active", "err", ""))
    out = {r.pattern_id: r for r in issues.resolve_missing(st, today(spark, ("c", day(3), "err", "")), ntz("2024-01-03 00:00:00")).collect()}
    assert out["a"].status == "resolved" and out["a"].newly_resolved
    assert out["b"].status == "active" and not out["b"].newly_resolved


def test_timeline_of_a_returning_issue(spark):
    daily = today(spark, *[("p", day(n), "err", "") for n in (1, 2, 4)])
    got = [(r.day.day, r.state, r.resolved_day and r.resolved_day.day)
           for r in issues.issue_timeline(daily, ntz("2024-01-04 00:00:00")).orderBy("day").collect()]
    assert got == [(1, "new", None), (2, "ongoing", 3), (4, "reopened", None)]


def test_two_severities_of_a_pattern_last_one_wins(spark):
    h = spark.createDataFrame(
        [(day(1), "p", 1, "err", "first"), (day(1), "p", 2, "crit", "last"), (day(1), "q", 3, "info", "no")],
        "day timestamp_ntz, pattern_id string, rank int, severity string, message string")
    (r,) = issues.daily_error_patterns(h).collect()
    assert (r.severity, r.sample_message) == ("crit", "last")


def logs(spark, n=500):
    return parse.with_pattern_id(spark.range(n).select(
        F.col("id").alias("event_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 37)").alias("ts"),
        F.concat(F.lit("h"), F.col("id") % 3).alias("host"), F.lit("").alias("app"),
        F.when(F.col("id") % 4 == 0, "err").otherwise("info").alias("severity"), F.lit("1").alias("facility"),
        F.concat(F.lit("msg "), F.col("id")).alias("message")))


def test_sums_agree_from_minute_to_day(spark):
    minutes = rollup.minute_stats(logs(spark))
    for dim in ("total", "severity", "host", "app", "host_app", "pattern"):
        assert minutes.where(F.col("dim") == dim).agg(F.sum("cnt")).first()[0] == 500
    hours = rollup.hourly_stats(minutes)
    assert hours.where("dim = 'total'").agg(F.sum("cnt")).first()[0] == 500
    assert rollup.daily_stats(minutes).where("dim = 'total'").first().cnt == 500
    assert {r.key for r in minutes.where("dim = 'app'").collect()} == {"-"}


@pytest.mark.parametrize("levels, kept", [(("ERROR", "CRITICAL"), {"err", "error", "crit", "critical", "alert", "emerg", "emergency"}),
                                          (("WARNING",), {"warn", "warning"})])
def test_analysis_levels(spark, levels, kept):
    names = ["err", "error", "crit", "critical", "alert", "emerg", "emergency", "info", "warn", "warning", "debug", "notice"]
    df = spark.createDataFrame([(day(1), i, n) for i, n in enumerate(names)], "hour timestamp_ntz, rank int, severity string")
    assert {r.severity for r in rollup.filter_analysis_levels(df, levels).collect()} == kept


def test_stats_text(spark):
    rows = [("total", "", 100, 1), ("unique", "", 10, 1), ("severity", "info", 95, 1), ("severity", "error", 5, 2), ("host", "host1", 50, 1)]
    df = spark.createDataFrame([(day(1), *r) for r in rows], "hour timestamp_ntz, dim string, key string, cnt long, rank int")
    text = report.hourly_wide(df).select(report.stats_text().alias("t")).first().t
    assert text == "Total: 100, Unique: 10\nSeverity: info:95, error:5\nHosts: host1:50"


def test_quota_colours(spark):
    plans = spark.createDataFrame([("p", "P", 9.0, 100, 1000, 7)], "plan_id string, plan_name string, price_monthly double, events_per_day_limit long, events_per_month_limit long, retention_days int")
    use = {"g": 79, "y": 80, "o": 90, "r": 100, "z": 1, "s": 5}
    projects = spark.createDataFrame(
        [(k, k, "p", "suspended" if k == "s" else "active", 0 if k == "z" else None) for k in use],
        "project_id string, name string, plan_id string, status string, custom_quota_per_day long")
    daily = spark.createDataFrame([(k, day(1), v) for k, v in use.items()], "project_id string, date timestamp_ntz, event_count long")
    at = ntz("2024-01-01 00:00:00")
    got = {r.project_id: (r.quota_status, r.exceeded, r.should_warn, r.should_alert) for r in usage.quota_status(daily, projects, plans, at).collect()}
    assert got == {"g": ("green", False, False, False), "y": ("yellow", False, True, False), "o": ("orange", False, False, True),
                   "r": ("red", True, False, True), "s": ("red", True, False, False), "z": ("green", False, False, False)}
    acts = {r.project_id: r.action for r in usage.quota_actions(daily, projects, plans, at).collect()}
    assert acts == {"r": "suspend", "s": "resume", "z": "suspend"}


def test_buckets_and_bad_lines(spark, tmp_path):
    for minute, body in (("10/14", '{"host":"a","occurrences":2}\nnot json\n'), ("11/00", '{"host":"b"}\n')):
        f = tmp_path / "2024/01/05" / (minute + ".ndjson")
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)
    (tmp_path / "2024/01/05/10/14.meta.json").write_text("{}")
    got = storage.read_buckets(spark, str(tmp_path), pattern="*.ndjson").orderBy("host").collect()
    assert [(r.host, r.occurrences, r.bucket) for r in got] == [("a", 2, D(2024, 1, 5, 10, 14)), ("b", None, D(2024, 1, 5, 11))]
    late = storage.read_buckets(spark, str(tmp_path), ntz("2024-01-05 10:15:00"), ntz("2024-01-05 12:00:00"), pattern="*.ndjson")
    assert [r.host for r in late.collect()] == ["b"]
    files = {r.bucket: (r.lines, r["size"]) for r in storage.bucket_files(spark, str(tmp_path), "*.ndjson").collect()}
    assert files[D(2024, 1, 5, 11)] == (1, 13) and files[D(2024, 1, 5, 10, 14)][0] == 2


def test_search_range_prunes_day_partitions(spark, tmp_path):
    from loglake.operators import search

    root = str(tmp_path / "ev")
    storage.write_events(logs(spark, 5000), root)
    df = search.search_logs(spark.read.parquet(root), "msg 2", ntz("2024-01-02 06:00:00"), hours=2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in plan
    assert df.count() > 0


def test_read_only_sql(spark):
    assert sql_surface.check_read_only("select 1") is None
    assert sql_surface.check_read_only("with a as (select 1) select * from a") is None
    assert "DROP" in sql_surface.check_read_only("select 1; drop table x")
    assert sql_surface.check_read_only("select updated from t") is None
    assert "SELECT or WITH" in sql_surface.check_read_only("show tables")
    with pytest.raises(ValueError):
        sql_surface.run_query(spark, "DELETE FROM t")
    assert sql_surface.run_query(spark, "select :a as v", {"a": "x' or '1"}).first().v == "x' or '1"


def test_export_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string").coalesce(1)
    storage.export_table(df, "csv", str(tmp_path / "c"))
    (part,) = glob.glob(str(tmp_path / "c" / "*.csv"))
    assert open(part).read() == "n,s\n1,a\n"
    with pytest.raises(ValueError):
        storage.export_table(df, "xml", str(tmp_path / "x"))


def test_xes_document(spark, tmp_path):
    ev = spark.createDataFrame(
        [("c1", 'a<&"', D(2024, 1, 1, 0, 0, 1), 1, "r", {"k": "v\n1"}), ("c1", "b", D(2024, 1, 1, 0, 0, 2, 5), 2, None, None),
         ("c2", "a", D(2024, 1, 1), 3, "r", {})],
        "case_id string, activity string, ts timestamp_ntz, event_id long, resource string, attributes map<string,string>")
    out = str(tmp_path / "x")
    process.export_xes(ev, out, "P & Q")
    text = "".join(open(f).read() for f in sorted(glob.glob(os.path.join(out, "part-*"))))
    log = ET.fromstring(text.encode())
    traces = log.findall("trace")
    assert [t.find("string").get("value") for t in traces] == ["c1", "c2"]
    first, second = traces[0].findall("event")
    values = {e.get("key"): e.get("value") for e in first}
    assert values == {"concept:name": 'a<&"', "time:timestamp": "2024-01-01T00:00:01", "lifecycle:transition": "complete",
                      "org:resource": "r", "k": "v\n1"}
    assert second.find("date").get("value") == "2024-01-01T00:00:02.000005"
    assert log.find("string").get("value") == "P & Q"


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a long, b string")
    for exact in (False, True):
        rows = sql_surface.profile_table(df, exact=exact).collect()
        assert [(r.column, r.cardinality, r.total_count, r.null_percent) for r in rows] == [("a", 0, 0, 0.0), ("b", 0, 0, 0.0)]


@pytest.mark.parametrize("sql", [
    "select reflect('java.lang.System', 'getProperty', 'user.name') as x",
    "select `reflect`('java.lang.System', 'getProperty', 'user.name') as x",
    "select java_method('java.lang.System', 'getProperty', 'user.name') as x",
    "select try_reflect('java.lang.System', 'getProperty', 'user.name') as x",
])
def test_read_only_queries_run_no_code(spark, sql):
    with pytest.raises(ValueError):
        sql_surface.run_query(spark, sql)


def test_read_only_queries_read_no_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    sql = f"select * from parquet.`{tmp_path}/x`"
    with pytest.raises(Exception, match="NOT_FOUND"):
        sql_surface.run_query(spark, sql)
    assert sql_surface.run_query(spark, sql, read_only=False).count() == 3
    assert sql_surface.run_query(spark, "select count(*) as n from t", tables={"t": spark.range(4)}).first().n == 4


def test_workspace_deletes_its_tables(spark):
    with workspace(spark) as path:
        kept = stored(spark.range(5), "t").count()
        assert os.listdir(path.removeprefix("file:"))
    assert kept == 5 and not os.path.exists(path.removeprefix("file:"))


def severe_hour(spark):
    """One hour of seven severities: 27 errors, and more of four harmless kinds."""
    counts = {"err": 10, "crit": 9, "emerg": 8, "info": 40, "debug": 30, "notice": 20, "warn": 15}
    rows = [(i, dt.datetime(2024, 1, 1, 5, i % 60), s, "h", "a", s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, severity string, host string, app string, pattern_id string")


def test_rare_severities_count(spark):
    hourly = rollup.hourly_stats(rollup.minute_stats(severe_hour(spark)))
    (r,) = report.alerts(hourly, None, 20).collect()
    assert r.total_errors == 27 and "emerg: 8" in r.body
    assert report.alerts(rollup.hourly_stats(rollup.minute_stats(severe_hour(spark)), cut_severities=True), None, 20).count() == 0
    (r,) = report.alerts(jobs.closed_hours(severe_hour(spark).groupBy(
        F.date_trunc("hour", "ts").alias("bucket"), F.lit("severity").alias("dim"), F.col("severity").alias("key")
    ).agg(F.count(F.lit(1)).alias("cnt"))), None, 20).collect()
    assert r.total_errors == 27


@pytest.mark.parametrize("k", [5, 1001, 5000])
def test_top_k_is_cut_before_the_shuffle(spark, k):
    df = spark.range(20000).select((F.col("id") % 2).alias("g"), "id")
    out = top_k(df, ["g"], [F.desc("id")], k)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or plan.count("Window") >= 2
    rows = out.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo")).collect()
    assert all(r.n == k and r.lo == 20000 - 2 * k + r.g for r in rows)


def test_errors_beyond_the_lists_are_issues(spark):
    rows = [(i, dt.datetime(2024, 1, 1), "err", "h", "a", f"m{i}", f"p{i:03d}") for i in range(80)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, severity string, host string, app string, message string, pattern_id string")
    assert issues.daily_error_patterns_of_events(df).count() == 80
    lists = rollup.daily_highlights(rollup.hourly_highlights(rollup.minute_highlights(df)))
    assert issues.daily_error_patterns(lists).count() == 15


def test_limit_takes_the_first_events_of_the_range(spark):
    at = [dt.datetime(2024, 1, 1, 0, i) for i in range(4)]
    logs = spark.createDataFrame(
        [(i, at[i], "t0", "h", "a", "info", f"request_id=r{9 - i} x") for i in range(4)],
        "event_id long, ts timestamp_ntz, tenant_id string, host string, app string, severity string, message string")
    none = spark.createDataFrame([], "tenant_id string, case_id string, activity string, ts timestamp_ntz, event_id long, resource string")
    out = process.process_events(none, logs, "t0", F.lit(at[0]), F.lit(at[3]), limit=2)
    assert sorted(r.event_id for r in out.collect()) == [0, 1]
