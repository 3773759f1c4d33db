"""Results that only tables with many events an hour bring out, against DuckDB, and work left out."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import rows_of
from loglake import plans
from loglake.functions.columns import ntz
from loglake.session import workspace

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Hours 2 to 6 of a day with 1,200 errors each, and some other events."""
    path = str(tmp_path_factory.mktemp("many"))
    n = F.col("id")
    spark.range(5 * 1500).select(
        n.alias("event_id"), (ntz("2024-01-01 02:00:00") + F.make_dt_interval(secs=n * 2.4)).alias("ts"), (n % 240).alias("user_id"),
        F.when(n % 5 == 0, "view").otherwise("error").alias("event_type"), (n % 200).cast("double").alias("value"),
        F.concat(F.lit('{"k": '), n % 100, F.lit("}")).alias("props"),
    ).coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["l3_alerts_anomaly"])
def test_same_rows(spark, folder, name):
    df = QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    rel = con.execute(SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert got and rows_of(df.columns, got) == rows_of(names, rel.fetchall())


@pytest.mark.parametrize("name", ["d11_notable_incidents_exact", "d13_error_insights_exact"])
def test_no_highlights_are_made_where_none_are_shown(spark, folder, name):
    with workspace(spark) as path:
        assert QUERIES[name](spark, folder).count() == 5
        made = os.listdir(path.removeprefix("file:"))
    assert made and not [x for x in made if x.startswith("highlights")]


def test_admission_makes_no_patterns(spark):
    with workspace(spark) as path:
        QUERIES["n7_stream_admission"](spark, "/root/testdata/sf0.001").count()
        home = path.removeprefix("file:")
        (stream,) = [x for x in os.listdir(home) if x.startswith("stream-")]
        assert "pattern_id" not in spark.read.parquet(f"{home}/{stream}/events").columns
