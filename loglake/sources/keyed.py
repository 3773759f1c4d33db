"""Tables with a key: changed rows are written to the buckets they fall in, and merged when read.

    root/buckets=16/commit=000000007-delta/bucket=3/part-*.parquet
    root/buckets=16/commit=000000009-base/bucket=3/part-*.parquet

A row belongs to the bucket of its key's hash.  `put_rows` writes a delta: whole
new rows, only in the buckets that have any.  A bucket is read as its newest base
and the deltas after it; of equal keys the row of the last commit counts.
`compact` writes a new base for the buckets that have gathered many deltas, and
leaves all others as they are.

A commit counts once Spark's success mark is in its folder, so a lost job
leaves the table as it was, and its folder is overwritten by the next commit.
One job writes at a time; readers see the commits there were when they started.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


def _names(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def n_buckets(spark: SparkSession, root: str) -> int | None:
    """Buckets of a table, fixed by its first commit; None if there is no table."""
    found = [n for n in _names(spark, root) if n.startswith("buckets=")]
    return int(found[0].removeprefix("buckets=")) if found else None


def commits(spark: SparkSession, root: str) -> list[tuple[int, str, list[int]]]:
    """(number, kind, buckets) of the complete commits, in order."""
    count = n_buckets(spark, root)
    if count is None:
        return []
    out = []
    for name in _names(spark, f"{root}/buckets={count}"):
        inside = _names(spark, f"{root}/buckets={count}/{name}")
        if name.startswith("commit=") and "_SUCCESS" in inside:
            number, kind = name.removeprefix("commit=").split("-")
            out.append((int(number), kind, sorted(int(n.removeprefix("bucket=")) for n in inside if n.startswith("bucket="))))
    return sorted(out)


def bucket_of_key(key: list[str], count: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(count)).cast("int")


def touched(df: DataFrame, key: list[str], count: int) -> list[int]:
    """Buckets that rows fall in; no more than there are buckets."""
    return sorted(r.b for r in df.select(bucket_of_key(key, count).alias("b")).distinct().collect())


def _layout(spark: SparkSession, root: str) -> dict[int, tuple[int | None, list[int]]]:
    """For each bucket the number of its newest base, and of the deltas after it."""
    out: dict = {}
    for number, kind, buckets in commits(spark, root):
        for b in buckets:
            out[b] = (number, []) if kind == "base" else (out.get(b, (None, []))[0], [*out.get(b, (None, []))[1], number])
    return out


def read_rows(
    spark: SparkSession, root: str, key: list[str], buckets: list[int] | None = None, schema: StructType | None = None
) -> DataFrame | None:
    """The rows of a table, or of some buckets; None if they have none yet.  A known schema saves a look into a file."""
    count = n_buckets(spark, root)
    layout = _layout(spark, root)
    chosen = [b for b in (layout if buckets is None else buckets) if b in layout]
    home = f"{root}/buckets={count}"
    bases = [f"{home}/commit={layout[b][0]:09d}-base/bucket={b}" for b in chosen if layout[b][0] is not None]
    deltas = [f"{home}/commit={n:09d}-delta/bucket={b}" for b in chosen for n in layout[b][1]]
    if not bases and not deltas:
        return None
    schema = schema or spark.read.parquet((deltas or bases)[0]).schema

    def load(paths):
        return spark.read.schema(schema).option("basePath", home).parquet(*paths).drop("bucket")

    columns = schema.names
    if not deltas:
        return load(bases).select(columns)
    row = F.struct(*columns)
    newest = load(deltas).groupBy(*key).agg(F.max_by(row, "commit").alias("_row")).select("_row.*")
    if not bases:
        return newest
    # The few changed keys go to the base, which keeps its place.
    return load(bases).select(columns).join(newest.select(*key), key, "left_anti").unionByName(newest)


def _write(df: DataFrame, root: str, key: list[str], count: int, kind: str) -> int:
    spark = df.sparkSession
    known = commits(spark, root)
    number = known[-1][0] + 1 if known else 0
    rows = df.withColumn("bucket", bucket_of_key(key, count)).hint("rebalance", "bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/buckets={count}/commit={number:09d}-{kind}")
    return number


def put_rows(df: DataFrame, root: str, key: list[str], count: int = BUCKETS) -> int:
    """Add or replace rows, one per key in `df`; returns the number of the commit.

    `count` holds for a new table only.
    """
    return _write(df, root, key, n_buckets(df.sparkSession, root) or count, "delta")


def compact(
    spark: SparkSession, root: str, key: list[str], most: int = 8, schema: StructType | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> list[int]:
    """Give buckets with more than `most` deltas a new base; returns these buckets.

    Only the rows that `keep` returns go into the new bases.  A bucket of which
    it returns none stays as it is.
    """
    full = sorted(b for b, (_, deltas) in _layout(spark, root).items() if len(deltas) > most)
    if full:
        rows = read_rows(spark, root, key, full, schema)
        if keep is not None:
            rows = keep(rows)
            full = touched(rows, key, n_buckets(spark, root))
    if full:
        _write(rows, root, key, n_buckets(spark, root), "base")
    return full


def vacuum(spark: SparkSession, root: str) -> list[int]:
    """Delete commits whose rows all stand in newer bases, and what lost jobs left; returns the commits' numbers.

    Readers that started before the newest base may still want them.  The last
    commit stays, so that numbers go on.
    """
    home, layout, complete = f"{root}/buckets={n_buckets(spark, root)}", _layout(spark, root), commits(spark, root)
    gone = []
    for number, kind, buckets in complete[:-1]:
        if all((layout[b][0] or 0) > number for b in buckets):
            gone.append((number, kind))
    last = complete[-1][0] if complete else -1
    names = [f"commit={number:09d}-{kind}" for number, kind in gone]
    for name in _names(spark, home):
        lost = name.startswith("commit=") and int(name[7:16]) <= last and "_SUCCESS" not in _names(spark, f"{home}/{name}")
        if lost or name in names:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{name}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return [number for number, _ in gone]
