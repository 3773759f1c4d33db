"""Daily quotas enforced while events arrive.

A counter per project and day stands in a keyed table (`sources/keyed.py`).
A batch first counts its own events per project and day, which combines on the
map side, and sets the counts against the counters.  Days that stay within
their limit are admitted whole, days that are used up are refused whole; only
where a limit falls inside the batch are events numbered, spread over many tasks
however large the project is.  Every project and day crosses its limit once, so
numbering is rare.

A counter keeps the number before its last batch, so a batch that Spark
repeats after a failure starts from the same counters and decides the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.skew import with_group_index
from ..session import stored, workspace
from ..sources import keyed
from .jobs import start_batches

KEY = ["project_id", "day"]
COUNTER = "project_id string, day date, used long, before long, batch long"
KEEP_DAYS = 2  # days before a project's newest one that still take events
MOST_DELTAS = 8


def _before(spark, root: str, batch_id: int) -> DataFrame:
    """Counters as they were before a batch."""
    schema = StructType.fromDDL(COUNTER)
    rows = keyed.read_rows(spark, root, KEY, schema=schema)
    if rows is None:
        rows = spark.createDataFrame([], schema)
    used = F.when(F.col("batch") >= batch_id, F.col("before")).otherwise(F.col("used"))
    return rows.select(*KEY, used.alias("before")).where("before > 0")


def _newest(counters: DataFrame) -> DataFrame:
    """The newest day of each project; a wrong clock closes days of its own project only."""
    return counters.groupBy("project_id").agg(F.max("day").alias("newest"))


def admit_batch(
    batch: DataFrame, batch_id: int, root: str, limits: DataFrame, project: str = "tenant_id", keep_days: int = KEEP_DAYS
) -> tuple[DataFrame, DataFrame]:
    """Rows of a batch with `admitted`, and the counters that the batch changes.

    In a batch the first events by time and id are admitted.  Days more than
    `keep_days` before the newest counted day of their project are closed: their
    counters may be gone, and their events are refused.  Events without a
    project, a day or a limit are admitted.
    """
    spark = batch.sparkSession
    rows = batch.withColumn("_day", F.to_date("ts"))
    known = stored(_before(spark, root, batch_id), "counters")
    counts = rows.groupBy(F.col(project).cast("string").alias("project_id"), F.col("_day").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    closed = F.coalesce(F.col("day") < F.date_sub("newest", keep_days), F.lit(False))
    room = F.col("limit") - F.col("before")
    judged = stored(
        counts.join(limits.select(F.col("project_id").cast("string").alias("project_id"), "limit"), "project_id")
        .where("limit IS NOT NULL AND day IS NOT NULL")
        .join(known, KEY, "left").withColumn("before", F.coalesce("before", F.lit(0)))
        .join(_newest(known), "project_id", "left").select(
            *KEY, "n", "before", F.when(closed, F.lit(0)).otherwise(F.greatest(room, F.lit(0))).alias("room"), closed.alias("closed"),
        ), "judged",
    )
    fit = judged.select(F.col("project_id").alias("_project"), F.col("day").alias("_day"), "room", F.col("n").alias("_n"))
    marked = rows.withColumn("_project", F.col(project).cast("string")).join(fit, ["_project", "_day"], "left")
    across = (F.col("room") > 0) & (F.col("room") < F.col("_n"))
    whole = marked.where(~F.coalesce(across, F.lit(False))).select(
        *batch.columns, F.coalesce(F.col("room") >= F.col("_n"), F.lit(True)).alias("admitted")
    )
    counters = judged.where("NOT closed").select(
        *KEY, (F.col("before") + F.col("n")).alias("used"), "before", F.lit(batch_id).cast("long").alias("batch")
    )
    if judged.where("room > 0 AND room < n").isEmpty():
        return whole, counters
    order = [F.col("ts"), F.col("event_id")]
    numbered = with_group_index(marked.where(across), ["_project", "_day"], order, "_idx")
    return whole.unionByName(
        numbered.select(*batch.columns, (F.col("_idx") < F.col("room")).alias("admitted"))
    ), counters


def start_admission(
    events: DataFrame, path: str, checkpoint: str, limits: DataFrame, project: str = "tenant_id",
    keep_days: int = KEEP_DAYS, once: bool = True,
):
    """All events with `admitted` below `path/events`; the counters stand in `path/counters`.

    `limits` has one row `(project_id, limit)` per project and is read anew by every batch.
    """
    root = f"{path}/counters"

    def admit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()  # counted, joined, and numbered where a limit is crossed
        with workspace(spark):
            rows, counters = admit_batch(batch, batch_id, root, limits, project, keep_days)
            rows.write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")
            if not counters.isEmpty():
                # The counters last: until they are there, a repeated batch finds those of the batch before.
                keyed.put_rows(counters, root, KEY)
            schema = StructType.fromDDL(COUNTER)

            def still_open(rows: DataFrame) -> DataFrame:
                newest = _newest(keyed.read_rows(spark, root, KEY, schema=schema))
                return stored(rows.join(newest, "project_id").where(F.col("day") >= F.date_sub("newest", keep_days)).drop("newest"), "open")

            if keyed.compact(spark, root, KEY, MOST_DELTAS, schema, keep=still_open):
                keyed.vacuum(spark, root)
        batch.unpersist()

    return start_batches(events, admit, checkpoint, once)
