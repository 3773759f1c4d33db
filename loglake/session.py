"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on.  Partition counts and memory stay with the
# cluster; AQE coalesces small shuffles and splits skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints go once nothing refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # No Python call sites inside plans: building large expressions is much faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "loglake", **extra) -> SparkSession:
    """Session with the library's settings; `extra` holds further Spark options."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: `spark.checkpoint.dir` of the session.

    Only where the session names none (tests on one machine) a temporary
    folder is made and recorded in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not path:
        path = spark.conf.get("loglake.local.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        path = tempfile.mkdtemp(prefix="loglake-")
        spark.conf.set("loglake.local.dir", path)
    return path.rstrip("/")


_OWNED: list[str] = []  # folders of the open workspaces, the innermost last


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Owns the intermediate tables written inside it and deletes them at the end.

    Results that read such tables must be written or collected before.
    """
    path = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
    _OWNED.append(path)
    try:
        yield path
    finally:
        _OWNED.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path in the innermost workspace, or else below the shared folder."""
    return f"{_OWNED[-1] if _OWNED else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


BATCH_BYTES = 4 << 20  # of texts that a Python worker gets at once


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session, which else hold 10,000 rows of any size; a smaller bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not now or not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def checkpointed(df):
    """Reliable checkpoint in the shared folder; survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df, name: str = "table"):
    """Write to the shared folder and read back: a rollup several jobs read is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
