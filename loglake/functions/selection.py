"""Exact order statistics of groups of any size, without sorting them.

Counting passes narrow a range of values for each group and place wanted: a
quantile sketch per group, which combines on the map side, gives bounds that hold the place
for certain; the rows below are counted, and only those between the bounds stay.
A pass leaves a few thousandths of a group's rows, so three passes do for 10**9
rows.  What is left of a group is sorted once it is small; a range of a
single value needs no sort, however many rows have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

GRID = 1000  # bounds are two of so many quantiles
ACCURACY = 10 * GRID  # the sketch is off by a tenth of their distance at most
SMALL = 50_000  # rows of a group that are sorted


def order_values(df: DataFrame, key: str, value: str, places: dict[str, Column], small: int = SMALL) -> DataFrame:
    """(key, n, <names>): of each group the values at places of its sorted rows, from 0.

    `places` are expressions of `n`, the rows of the group.  Nulls come first and
    not-a-number last, as in Spark's own order; a place outside the group has null.
    """
    df = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    sizes = stored(df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known")), "sizes")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), at.cast("long").alias("at")) for name, at in places.items()])
    goals = stored(
        sizes.select("key", F.col("known").alias("size"), (F.col("n") - F.col("known")).alias("nulls"), F.inline(wanted))
        .select("key", "name", "size", (F.col("at") - F.col("nulls")).alias("at")).where("at >= 0 AND at < size"), "goals",
    )
    found, rows = None, None
    while goals.where(F.col("size") > small).limit(1).count():
        # The first pass reads the rows themselves, later ones what is left for each goal.
        by = ["key"] if rows is None else ["key", "name"]
        source = df.where("value IS NOT NULL") if rows is None else rows
        grid = F.percentile_approx("value", [i / GRID for i in range(GRID + 1)], ACCURACY).alias("grid")
        step = F.floor((F.col("at") + 0.5) / F.col("size") * GRID).cast("int")
        bounds = goals.join(source.groupBy(*by).agg(grid), by).select(
            "key", "name", "at", "size",
            F.get("grid", F.greatest(step - 1, F.lit(0))).alias("low"),
            F.get("grid", F.least(step + 2, F.lit(GRID))).alias("high"),
        )
        bounds = stored(bounds, "bounds")
        inside = source.join(bounds.drop("at", "size"), by)
        counts = inside.groupBy("key", "name").agg(
            F.count_if(F.col("value") < F.col("low")).alias("below"),
            F.count_if((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))).alias("between"),
        )
        # The least and greatest quantile are the least and greatest value, but a sketch is not trusted with that.
        narrowed = stored(bounds.join(counts, ["key", "name"]).select(
            "key", "name", "low", "high", (F.col("at") - F.col("below")).alias("at"), F.col("between").alias("size")
        ), "narrowed")
        if narrowed.where("at < 0 OR at >= size").limit(1).count():
            raise ArithmeticError("a quantile sketch was further off than its accuracy")
        done = narrowed.where("low = high").select("key", "name", F.col("low").alias("value"))
        found = done if found is None else found.unionByName(done)
        left = narrowed.where("low < high")
        rows = stored(
            source.join(left.select("key", "name", "low", "high"), by)
            .where((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))).select("key", "name", "value"), "between",
        )
        before, goals = goals, left.select("key", "name", "size", "at")
        if goals.join(before.select("key", "name", F.col("size").alias("was")), ["key", "name"]).where(
            (F.col("size") > small) & (F.col("size") >= F.col("was"))
        ).limit(1).count():
            break  # no smaller: few different values that the grid cannot part
    if rows is None:
        rows = df.where("value IS NOT NULL").join(goals.select("key", "name"), "key")
    # Equal values are counted together, so what is sorted has different values only.
    values = rows.groupBy("key", "name", "value").agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("key", "name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = values.withColumn("upto", upto).join(goals, ["key", "name"]).where(
        (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("rows"))
    ).select("key", "name", "value")
    found = placed if found is None else found.unionByName(placed)
    wide = found.groupBy("key").agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in places])
    return sizes.select("key", "n").join(wide, "key", "left").withColumnRenamed("key", key)
