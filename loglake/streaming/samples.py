"""Samples per key kept in the state store.

The state of a key holds the n least marks seen so far, and only events that
come among them are written, about n * ln(N / n) of a key's N events.  A frequent
key is spread over salts, each with a state of its own; the sample is the least
n of what all salts have written, which is what `dedupe.sample_per_key` takes
from all events at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import AtomicType, BinaryType, StringType, StructField, StructType

from ..operators.dedupe import sample_mark, sample_per_key
from .jobs import batch_sink, start_batches

KEYS = ("host", "severity", "app")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_in_rocksdb(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which `transformWithState` needs, in so many partitions.

    The number of partitions is fixed by the first start of a checkpoint.
    """
    wanted = {PROVIDER: ROCKSDB, **({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class LeastMarks(StatefulProcessor):
    """Passes on the rows that come among the n least marks of their key."""

    def __init__(self, n: int, columns: list[str]):
        self.n, self.columns = n, columns

    def init(self, handle) -> None:
        self.marks = handle.getValueState("marks", "marks array<string>")

    def handleInputRows(self, key, rows, timerValues):
        old = list(self.marks.get()[0]) if self.marks.exists() else []
        kept, least = None, old
        for frame in rows:  # a chunk at a time: a task holds n rows of a key beside it
            if len(least) >= self.n:
                frame = frame[frame["mark"] < least[-1]]
            if not len(frame):
                continue
            kept = frame if kept is None else pd.concat([kept, frame])
            kept = kept.sort_values("mark", kind="stable").head(self.n)
            least = sorted([*old, *kept["mark"]])[: self.n]
        if kept is not None:
            self.marks.update((least,))
            yield kept.loc[kept["mark"] <= least[-1], self.columns]

    def close(self) -> None:
        pass


def sampled_events(events: DataFrame, keys=KEYS, n: int = 200, seed: int = 0, salts: int = 8) -> DataFrame:
    """Stream of the events that were among the n least of their key and salt when they came."""
    # As text, since pandas would turn whole numbers with nulls into floats; plain names, since rows pass as named tuples.
    text = [isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, (BinaryType, StringType)) for f in events.schema]
    names = [f"c{i}" for i in range(len(text))]
    passed = StructType([StructField(c, StringType() if t else f.dataType) for c, f, t in zip(names, events.schema, text, strict=True)])
    mark = sample_mark(["event_id"], seed)
    marked = events.select(
        *[F.col(f.name).cast(p.dataType).alias(p.name) for f, p in zip(events.schema, passed, strict=True)],
        mark.alias("mark"), F.pmod(F.xxhash64(mark), F.lit(salts)).alias("salt"),
        *[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)],
    )
    by_key = marked.groupBy("salt", *[f"key{i}" for i in range(len(keys))])
    found = by_key.transformWithStateInPandas(LeastMarks(n, names), passed, "append", "none")
    return found.select(*[F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(names, events.schema, strict=True)])


def start_sample(
    events: DataFrame, path: str, checkpoint: str, keys=KEYS, n: int = 200, seed: int = 0, salts: int = 8, once: bool = True,
    partitions: int | None = None,
):
    """Write the events that enter the sample, one folder per batch; `current_sample` reads the sample off them.

    `partitions` are those of the state (the session's shuffle partitions where
    none are given): adaptive execution does not join small ones in a stream.
    """
    with state_in_rocksdb(events.sparkSession, partitions):
        return start_batches(sampled_events(events, keys, n, seed, salts), batch_sink(path), checkpoint, once)


def current_sample(spark: SparkSession, path: str, keys=KEYS, n: int = 200, seed: int = 0) -> DataFrame:
    """The n events of each key with the least marks, of all batches so far."""
    return sample_per_key(spark.read.parquet(path).drop("batch"), keys, n, seed, by_md5=True)
