"""De-duplication, sampling, latest versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucket_of, in_zone, top_k


def event_order(df: DataFrame) -> list[str]:
    """Columns that put log events in a total order."""
    if "event_id" in df.columns:
        return ["ts", "event_id"]
    return [c for c in ("ts", "host", "app", "raw", "message") if c in df.columns]


def dedupe_bucket(df: DataFrame, bucket: str = "minute", key: str = "pattern_id", tz: str = "UTC") -> DataFrame:
    """First event per (bucket, key), with the number of events it stands for.

    One aggregation: `min_by` keeps the earliest event and combines on the map
    side, so a pattern that holds most rows is cut to one row per map task
    before the shuffle.
    """
    order = F.struct(*event_order(df))
    keep = [c for c in df.columns if c not in (key, "bucket")]
    return (
        df.groupBy(bucket_of(in_zone(F.col("ts"), tz), bucket).alias("bucket"), key)
        .agg(
            F.min_by(F.struct(*keep), order).alias("_first"),
            F.count(F.lit(1)).alias("occurrences"),
        )
        .select("bucket", key, *[F.col(f"_first.{c}").alias(c) for c in keep], "occurrences")
    )


def occurrence_counts(df: DataFrame, bucket: str = "minute", key: str = "pattern_id", tz: str = "UTC") -> DataFrame:
    """Events per (bucket, key), duplicates included."""
    return df.groupBy(
        bucket_of(in_zone(F.col("ts"), tz), bucket).alias("bucket"), key
    ).agg(F.count(F.lit(1)).alias("occurrences"))


def sample_mark(id_cols, seed: int) -> Column:
    """Hash of an event's id and the seed as 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed))))


def sample_per_key(
    df: DataFrame, keys=("host", "severity", "app"), n: int = 200, seed: int = 0,
    id_cols=("event_id",), by_md5: bool = False,
) -> DataFrame:
    """Uniform sample of n rows per key, the same on every run.

    Rows are ordered by a hash of their id and the seed; the n smallest are a
    uniform sample without replacement.  Map tasks pass on at most n rows per
    key.
    """
    mark = sample_mark(id_cols, seed) if by_md5 else F.xxhash64(*id_cols, F.lit(seed))
    ranked = top_k(df.withColumn("_mark", mark), list(keys), ["_mark", *id_cols], n, "_rank")
    return ranked.drop("_mark", "_rank")


def latest_version(df: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Newest row per key."""
    order = [F.col(v).desc() for v in version]
    return top_k(df, key, order, 1, "_rank").drop("_rank")
