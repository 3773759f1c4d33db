"""Keyed tables, gram index, manifest of files, proven most frequent values, mergeable hosts."""

import datetime as dt
import glob
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from loglake.functions.columns import ntz
from loglake.operators import issues, search, sql_surface, usage
from loglake.sources import grams, keyed, manifest, storage

D = dt.datetime


# -- keyed tables -----------------------------------------------------------------

def rows_of(spark, root):
    return {r.k: r.v for r in keyed.read_rows(spark, root, ["k"]).collect()}


def table(spark, values):
    return spark.createDataFrame(list(values.items()), "k string, v long")


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = str(tmp_path / "t")
    assert keyed.read_rows(spark, root, ["k"]) is None and keyed.commits(spark, root) == []
    base = {f"k{i}": i for i in range(200)}
    keyed.put_rows(table(spark, base), root, ["k"], 16)
    assert rows_of(spark, root) == base
    change = {"k3": -3, "new": 1}
    number = keyed.put_rows(table(spark, change), root, ["k"], 99)  # the number of buckets stays
    wanted = keyed.touched(table(spark, change), ["k"], 16)
    folders = glob.glob(f"{root}/buckets=16/commit={number:09d}-delta/bucket=*")
    assert sorted(int(f.split("=")[-1]) for f in folders) == wanted and len(wanted) <= 2
    assert len(glob.glob(f"{root}/buckets=16/commit={number:09d}-delta/bucket=*/*.parquet")) == len(wanted)
    assert rows_of(spark, root) == {**base, **change}
    some = keyed.read_rows(spark, root, ["k"], wanted)
    assert {r.b for r in some.select(keyed.bucket_of_key(["k"], 16).alias("b")).distinct().collect()} == set(wanted)


def test_compaction_and_lost_jobs(spark, tmp_path):
    root, want = str(tmp_path / "t"), {}
    rng = random.Random(1)
    for step in range(7):
        change = {f"k{rng.randrange(40)}": 100 * step + n for n in range(6)}
        want |= change
        keyed.put_rows(table(spark, change), root, ["k"], 4)
        assert rows_of(spark, root) == want
    # A job that was lost before its success mark counts for nothing, and its number is used again.
    home = f"{root}/buckets=4"
    shutil.copytree(f"{home}/commit=000000000-delta", f"{home}/commit=000000007-delta")
    os.remove(f"{home}/commit=000000007-delta/_SUCCESS")
    shutil.copytree(f"{home}/commit=000000007-delta", f"{home}/commit=000000005-base")
    assert rows_of(spark, root) == want
    full = keyed.compact(spark, root, ["k"], 3)
    assert full and rows_of(spark, root) == want and keyed.compact(spark, root, ["k"], 3) == []
    number, kind, buckets = keyed.commits(spark, root)[-1]
    assert (number, kind, buckets) == (7, "base", full)
    gone = keyed.vacuum(spark, root)
    assert rows_of(spark, root) == want
    assert set(gone).isdisjoint(n for n, *_ in keyed.commits(spark, root)) and not os.path.exists(f"{home}/commit=000000005-base")
    assert keyed.put_rows(table(spark, {"k1": 5}), root, ["k"]) == 8 and rows_of(spark, root) == want | {"k1": 5}


def test_stored_issues_by_day(spark, tmp_path):
    root, rng = str(tmp_path / "issues"), random.Random(2)
    days = {n: sorted({f"p{rng.randrange(30)}" for _ in range(8)}) for n in range(1, 6)}
    days[4] = []
    rows = [(p, D(2024, 1, n), "err", f"{p} {n}") for n, found in days.items() for p in found]
    daily = spark.createDataFrame(rows, "pattern_id string, day timestamp_ntz, severity string, sample_message string")
    for n in days:
        at = ntz(f"2024-01-0{n} 00:00:00")
        for _ in range(2 if n == 3 else 1):  # a day that is repeated changes nothing
            issues.advance_stored(daily.where(F.col("day") == at), root, at, buckets=4, most=2)
        want = {tuple(r) for r in issues.issue_state_as_of(daily, at).select(issues.STATE_COLUMNS).collect()}
        got = keyed.read_rows(spark, root, issues.KEY).select(issues.STATE_COLUMNS).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


# -- gram index -------------------------------------------------------------------

def logs(spark, n=400):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        message = f"user ÄRGER{i % 7} request {rng.randrange(10**6):06d} " + ("needle-" + str(i) if i % 97 == 0 else "ok")
        rows.append((i, D(2024, 1, 1 + i % 3, i % 24, 5), f"host{i % 4}", "web", "err", message if i % 50 else None))
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, host string, app string, severity string, message string")


def test_gram_index_loses_nothing(spark, tmp_path):
    root, index = str(tmp_path / "events"), str(tmp_path / "index")
    df = logs(spark)
    storage.write_events(df.where("event_id < 300"), root)
    events = spark.read.parquet(root)
    assert search.index_events(events, index) == len(events.inputFiles()) and search.index_events(events, index) == 0
    storage.write_events(df.where("event_id >= 300"), root)  # not indexed yet: these files are always read
    events = spark.read.parquet(root)
    now = ntz("2024-01-04 00:00:00")
    texts = ["needle-97", "NEEDLE-", "ärger3", "ne", "zzz", "host2 web", "request 0", "ÄRGER", "dle-388"]

    def check():
        for q in texts:
            want = search.search_logs(df, q, now, 72, limit=1000).collect()
            got = search.search_indexed(events, index, q, now, 72, limit=1000).select(df.columns).collect()
            assert got == want, q

    check()
    assert search.index_events(events, index) > 0
    check()
    files, all_files = grams.files_to_read(spark, events, index, "needle-97")
    assert len(files) < all_files / 10 and len(grams.files_to_read(spark, events, index, "ne")[0]) == all_files
    assert grams.files_to_read(spark, events, index, "not there at all")[0] == []
    assert search.search_indexed(events, index, "not there at all", now, 72).count() == 0
    read = search.narrowed(events, index, "needle-97", now - F.make_dt_interval(hours=F.lit(24)), now)
    assert all("dt=2024-01-03" in f for f in read.inputFiles())
    with pytest.raises(ValueError):
        search.search_indexed(events, index, "", now)


# -- most frequent values ---------------------------------------------------------

@pytest.mark.parametrize("tracked", [8, 64, 10_000])
def test_frequent_values_are_exact(spark, tracked):
    rng = random.Random(3)
    rows = [(f"v{int(rng.paretovariate(0.7))}", rng.choice("ab"), f"u{i}", None, i % 500) for i in range(3000)]
    df = spark.createDataFrame(rows, "skewed string, few string, unique string, nothing string, `odd.name` int").repartition(5)
    for k in (1, 10, 100):
        got = sql_surface.frequent_values(df, k=k, tracked=tracked).collect()
        want = sql_surface.profile_table_top(df.withColumnRenamed("odd.name", "odd"), k).collect()
        assert sorted(map(tuple, got)) == sorted(("odd.name" if r.column == "odd" else r.column, *r[1:]) for r in want)
    assert sql_surface.frequent_values(df.limit(0), k=3, tracked=tracked).count() == 0


def test_proven_columns_are_not_counted_in_full(spark, monkeypatch):
    rows = [("hot" if i % 2 else f"u{i}",) for i in range(20_000)]
    df = spark.createDataFrame(rows, "value string")
    monkeypatch.setattr(sql_surface, "_top_of", lambda *a: pytest.fail("counted in full"))
    top = sql_surface.frequent_values(df, k=1, tracked=64).collect()
    assert [(r.value, r["count"]) for r in top] == [("hot", 10_000)]


# -- mergeable hosts --------------------------------------------------------------

def test_estimated_hosts_keep_to_the_error(spark):
    """A set of hosts whose sketch of 12 bits is 5.3 % off; the bound is 4.9 %."""
    events = spark.range(2099 * 4500, 2100 * 4500).select(
        F.lit("p").alias("tenant_id"), ntz("2024-01-01 00:00:00").alias("ts"), F.lit("info").alias("severity"),
        F.concat(F.lit("h"), "id").alias("host"), F.lit("m").alias("message"), "id",
    )
    one, two = (usage.hourly_usage_mergeable(events.where(F.col("id") % 2 == k)) for k in (0, 1))
    row = usage.merge_usage_hosts(one, two).first()
    assert row.event_count == 4500 and abs(row.unique_hosts - 4500) <= 4500 * 0.04875


def test_added_hosts_are_united(spark):
    def part(lo, hi):
        return spark.range(lo, hi).select(
            F.lit("p").alias("tenant_id"), F.lit(D(2024, 1, 1, 3)).cast("timestamp_ntz").alias("ts"), F.concat(F.lit("h"), "id").alias("host"),
            F.lit("err").alias("severity"), F.lit("four").alias("message"),
        )

    one, two = usage.hourly_usage_mergeable(part(0, 6000)), usage.hourly_usage_mergeable(part(4000, 9000))
    row = usage.merge_usage_hosts(one, two).first()
    assert (row.event_count, row.data_size_bytes) == (11_000, 44_000) and abs(row.unique_hosts - 9000) <= 9000 * usage.HOST_ERROR
    again = usage.merge_usage_hosts(one, usage.hourly_usage_mergeable(part(0, 3)), "replace").first()
    assert (again.event_count, again.unique_hosts) == (3, 3)
    alone = usage.merge_usage_hosts(one, usage.hourly_usage_mergeable(part(0, 0))).first()
    assert alone.event_count == 6000 and abs(alone.unique_hosts - 6000) <= 6000 * usage.HOST_ERROR


# -- manifest of files ------------------------------------------------------------

def test_manifest_follows_the_files(spark, tmp_path):
    root, path = str(tmp_path / "events"), str(tmp_path / "manifest")
    rng = random.Random(9)
    rows = [(i, None if i % 90 == 5 else D(2024, 1, 1 + i % 4, rng.randrange(24), rng.randrange(60), 59, 999_999), None if i % 7 == 0 else f"t{i % 5}")
            for i in range(500)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, tenant_id string").persist()
    stats = df.where("event_id % 3 = 0 AND ts IS NOT NULL").select(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("bucket"))

    def check(read):
        events = spark.read.parquet(root)
        found = manifest.facts(events, path)
        want = sql_surface.table_stats(events, exact=True).first()
        assert manifest.table_stats(found).first() == want
        size = manifest.table_size(found).first()
        assert (size.files, size.row_count, size.size_bytes) == (len(events.inputFiles()), events.count(), sum(
            os.path.getsize(f.removeprefix("file://")) for f in events.inputFiles()))
        for got, plain in (
            (manifest.missing_rollups(found, stats), storage.missing_rollups(events, stats)),
            (manifest.missing_rollups(found, stats, "Asia/Tehran"), storage.missing_rollups(events, stats, tz="Asia/Tehran")),
            (manifest.hourly_counts(found), events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).count()),
        ):
            assert got.count() == plain.count() and got.exceptAll(plain).isEmpty()
        assert sum("/events/" in f for f in found.inputFiles()) == read

    storage.write_events(df.where("event_id < 300"), root)
    first = len(spark.read.parquet(root).inputFiles())
    check(first)  # no manifest yet
    assert manifest.update(spark.read.parquet(root), path) == first and manifest.update(spark.read.parquet(root), path) == 0
    check(0)
    storage.write_events(df.where("event_id >= 300"), root)
    check(len(spark.read.parquet(root).inputFiles()) - first)
    assert manifest.update(spark.read.parquet(root), path) > 0
    assert storage.drop_expired_partitions(spark, root, 1, "2024-01-03 12:00:00") == ["2024-01-01", "2024-01-02"]
    check(0)  # files that are gone do not count


def test_manifest_added_twice_counts_once(spark, tmp_path):
    root, path = str(tmp_path / "events"), str(tmp_path / "manifest")
    storage.write_events(logs(spark, 50).withColumn("tenant_id", F.col("host")), root)
    events = spark.read.parquet(root)
    manifest.update(events, path)
    spark.read.schema(manifest.SCHEMA).parquet(path).write.mode("append").parquet(path)  # another job at the same time
    assert manifest.table_stats(manifest.facts(events, path)).first().row_count == 50
