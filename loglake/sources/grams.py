"""Which stored files can hold a text: three-byte grams of the searched text of each file.

The index has, per file of an events table, a bitmap of the hashed grams of all its
rows, and the times of its first and last event.  A file in which one gram of a
search text is missing cannot hold it and is not read.  Grams are those of the
UTF-8 bytes, so every text that contains another has all of its grams; texts under
three bytes have none and are looked for in all files of the time range.

Bitmaps are merged by Spark's own bitmap aggregate in parts of 4,096 bytes, so a
large file can be read by several tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

GRAM = 3
PART_BITS = 4096 * 8  # what Spark's bitmap aggregates take
PARTS = 8
BITS = PART_BITS * PARTS
HELD_FILES = 32
PLACE = 3  # a file is known by its last names: day, hour, file
INDEX_SCHEMA = "file string, part int, bits binary, n long, first timestamp_ntz, last timestamp_ntz"


def gram_bits(text: bytes) -> np.ndarray:
    """Bits of the grams of a text, each once."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(b) < GRAM:
        return np.zeros(0, np.int64)
    code = b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]
    mixed = code * np.uint64(0x9E3779B97F4A7C15)
    return np.unique((mixed >> np.uint64(64 - 18)).astype(np.int64))


def _file(path: Column) -> Column:
    return F.substring_index(path, "/", -PLACE)


def _place(path: str) -> str:
    return "/".join(path.split("/")[-PLACE:])


def _bitmaps(batches):
    """Rows of the index from rows (file, text, ts); a file's rows may come in several."""
    held: dict = {}

    def rows():
        names, parts, maps, n, first, last = [], [], [], [], [], []
        for name, (bits, count, low, high) in held.items():
            packed = np.packbits(bits.reshape(PARTS, PART_BITS), axis=1, bitorder="little")
            for part in range(PARTS):
                names.append(name)
                parts.append(part)
                maps.append(packed[part].tobytes())
                n.append(count)
                first.append(low)
                last.append(high)
        times = pa.timestamp("us")
        return pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array(parts, pa.int32()), pa.array(maps, pa.binary()), pa.array(n, pa.int64()),
             pa.array(first, times), pa.array(last, times)], ["file", "part", "bits", "n", "first", "last"]
        )

    for batch in batches:
        files = batch.column("file").dictionary_encode()
        for k, name in enumerate(files.dictionary.to_pylist()):
            own = batch.filter(pc.equal(files.indices, k))
            bits, count, low, high = held.get(name, (np.zeros(BITS, bool), 0, None, None))
            # Texts stand apart by a zero byte; grams across it only let more files pass.
            bits[gram_bits("\0".join(own.column("text").to_pylist()).encode())] = True
            times = pc.min_max(own.column("ts")).as_py()
            low = min((t for t in (low, times["min"]) if t is not None), default=None)
            high = max((t for t in (high, times["max"]) if t is not None), default=None)
            held[name] = (bits, count + own.num_rows, low, high)
        if len(held) > HELD_FILES:
            yield rows()
            held.clear()
    if held:
        yield rows()


def index_files(events: DataFrame, text: Column, index: str) -> int:
    """Add the files of a stored events table (`dt`/`hr` folders) that the index does not have; returns how many.

    `text` is the text that searches look into, in lower case.
    """
    spark = events.sparkSession
    known = set()
    if storage._exists(spark, f"{index}/_SUCCESS"):
        known = {r.file for r in spark.read.schema(INDEX_SCHEMA).parquet(index).where("part = 0").select("file").collect()}
    new = [p for p in events.inputFiles() if _place(p) not in known]
    if not new:
        return 0
    root = new[0].rsplit("/", PLACE)[0]
    rows = spark.read.schema(events.schema).option("basePath", root).parquet(*new).select(
        _file(F.col("_metadata.file_path")).alias("file"), F.coalesce(text, F.lit("")).alias("text"), F.col("ts").cast("timestamp_ntz").alias("ts")
    )
    merged = rows.mapInArrow(_bitmaps, INDEX_SCHEMA).groupBy("file", "part").agg(
        F.bitmap_or_agg("bits").alias("bits"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    merged.write.mode("append").parquet(index)
    return len(new)


def may_hold(index: DataFrame, text: str) -> DataFrame:
    """Rows (file, n, first, last) of the files that can hold a text, given in lower case."""
    bits = gram_bits(text.encode())
    wanted = F.lit(True)
    for part in sorted(set((bits // PART_BITS).tolist())):
        own = F.lit(True)
        for bit in (bits[bits // PART_BITS == part] % PART_BITS).tolist():
            byte = F.conv(F.hex(F.substring("bits", bit // 8 + 1, 1)), 16, 10).cast("int")
            own = own & (byte.bitwiseAND(F.lit(1 << bit % 8)) != 0)
        wanted = wanted & ((F.col("part") != part) | own)
    return index.groupBy("file").agg(
        F.every(wanted).alias("passes"), F.max("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")
    ).where("passes").drop("passes")


def files_to_read(
    spark: SparkSession, events: DataFrame, index: str, text: str, start: Column | None = None, end: Column | None = None
) -> tuple[list[str], int]:
    """(files that can hold the text between two times, number of all files); files not in the index are among them."""
    files = {_place(p): p for p in events.inputFiles()}
    rows = spark.read.schema(INDEX_SCHEMA).parquet(index)
    indexed = {r.file for r in rows.where("part = 0").select("file").collect()}
    found = may_hold(rows, text.lower())
    if start is not None:
        found = found.where(F.col("last") > start)
    if end is not None:
        found = found.where(F.col("first") <= end)
    chosen = {r.file for r in found.select("file").collect()}
    return sorted(p for name, p in files.items() if name in chosen or name not in indexed), len(files)
