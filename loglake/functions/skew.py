"""Exact row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, stored


def with_group_index(df: DataFrame, keys: list[str], order: list, name: str = "idx") -> DataFrame:
    """Number the rows 0, 1, 2 ... inside each group, in the given order.

    `row_number()` would send a whole group to one task.  Here rows are range
    partitioned by (keys, order), so a hot group is spread over many
    partitions; every partition numbers its own rows, and the start of each
    (group, partition) piece is a running sum of piece sizes.  The pieces
    table has one row per group and partition touched.

    The ranged rows are checkpointed once, since the pieces and the rows must
    see the same partition bounds.  The pieces are written as well: Spark then
    knows their size when it plans the join, and moves the rows only if the
    pieces are too large to be sent to all executors.
    """
    if not keys:
        df = df.withColumn("_all", F.lit(1))
        return with_group_index(df, ["_all"], order, name).drop("_all")
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).sortWithinPartitions(
        *[F.col(k) for k in keys], *order
    )
    placed = checkpointed(ranged.withColumn("_pos", F.monotonically_increasing_id()))
    part = F.shiftright("_pos", 33)
    placed = placed.withColumn("_part", part)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    pieces = (
        placed.groupBy(*keys, "_part")
        .agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_kp"),
                "_start", "_offset")
    )
    pieces = stored(pieces, "pieces")
    same = F.col("_part") == F.col("_kp")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        placed.join(pieces, same)
        .withColumn(name, F.col("_pos") - F.col("_start") + F.col("_offset"))
        .select(*df.columns, name)
    )
