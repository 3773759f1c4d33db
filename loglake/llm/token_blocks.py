"""Token ids in files of patched frame-of-reference blocks.

`write_tokens` encodes texts and stores all ids in ascending document order;
`read_tokens` gives them back.  The files are Parquet, so that Spark's commit
protocol covers them on any store; each row holds one shard in the format
below, and its other columns tell where the shard stands.

A shard is a byte string: a header of four little-endian u32 (magic, number of
ids, number of blocks, number of documents), one u32 per document (its ids),
one u32 per block (its start in the payload), and the payload.  A block holds
up to 128 ids: u32 minimum, u8 width, u8 number of ids - 1, u8 number of
exceptions, the differences to the minimum packed at that width, then the
exceptions as u8 places and u32 differences.  The width is the least that
holds the chosen percentile of the differences; what is wider is an exception
and counts as 0 in the packed part.

Defined results: a null or empty text has the end id only; rows without a
document id come first; repeated ids are ordered by text; an empty table gives
no rows.  All other columns of the input are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch
from .tokens import Encoder
from .words import text_slices

MAGIC = 0x4F465031
BLOCK = 128
PERCENTILE = 90
SHARDS = "part int, seq int, n_tokens long, n_docs int, doc_ids binary, no_id binary, shard binary"
DOCS = "part int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long, ids array<int>"


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """(block starts, payload) of a run of ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    table = np.empty((blocks, BLOCK), np.uint32)
    table.reshape(-1)[:n] = ids
    table.reshape(-1)[n:] = ids[-1] if n else 0
    low = table.min(axis=1)
    table -= low[:, None]
    rank = np.sort(table, axis=1)[:, (BLOCK - 1) * percentile // 100]
    width = np.where(rank > 0, np.floor(np.log2(np.maximum(rank, 1))).astype(np.int64) + 1, 0)
    used = np.full(blocks, BLOCK)
    if blocks:
        used[-1] = n - (blocks - 1) * BLOCK
    out: list = [b""] * blocks
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        part = table[rows]
        wide = part >= np.uint64(1) << np.uint64(w)
        kept = np.where(wide, 0, part)
        bits = (kept[:, :, None] >> np.arange(w, dtype=np.uint32)) & 1
        packed = np.packbits(bits.astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
        for k, r in enumerate(rows.tolist()):
            at = np.flatnonzero(wide[k])
            head = np.array([low[r]], "<u4").tobytes() + bytes([w, used[r] - 1, len(at)])
            out[r] = b"".join([head, packed[k].tobytes(), at.astype(np.uint8).tobytes(), part[k][at].astype("<u4").tobytes()])
    sizes = np.fromiter(map(len, out), np.int64, blocks)
    return (np.cumsum(sizes) - sizes).astype("<u4"), b"".join(out)


def unpack(starts: np.ndarray, payload: bytes) -> np.ndarray:
    """The ids of blocks packed by `pack`."""
    data = np.frombuffer(payload, np.uint8)
    starts = starts.astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint32)
    low = data[starts[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width, used, n_wide = (data[starts + 4 + k].astype(np.int64) for k in range(3))
    used += 1
    out = np.empty((len(starts), BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        packed = data[starts[rows, None] + 7 + np.arange(w * BLOCK // 8)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        out[rows] = (bits.astype(np.uint32) << np.arange(w, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)
    for r in np.flatnonzero(n_wide).tolist():
        at = starts[r] + 7 + width[r] * BLOCK // 8
        places = data[at : at + n_wide[r]]
        out[r, places] = np.frombuffer(payload, "<u4", n_wide[r], at + n_wide[r])
    out += low[:, None]
    full = out.reshape(-1)
    return full[: (len(starts) - 1) * BLOCK + used[-1]]


def shard_bytes(ids: np.ndarray, counts: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    starts, payload = pack(ids, percentile)
    head = np.array([MAGIC, len(ids), len(starts), len(counts)], "<u4")
    return b"".join([head.tobytes(), counts.astype("<u4").tobytes(), starts.tobytes(), payload])


def shard_ids(shard: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each document) of a shard."""
    magic, n, blocks, docs = np.frombuffer(shard, "<u4", 4).tolist()
    if magic != MAGIC:
        raise ValueError("not a token shard")
    counts = np.frombuffer(shard, "<u4", docs, 16)
    starts = np.frombuffer(shard, "<u4", blocks, 16 + 4 * docs)
    ids = unpack(starts, shard[16 + 4 * docs + 4 * blocks :])
    if len(ids) != n:
        raise ValueError("a token shard is damaged")
    return ids, counts


def _writer(tokenizer: str, end_id: int, percentile: int, plain: bool):
    def shards(batches):
        encoder, part, seq = Encoder.of(tokenizer, plain), TaskContext.get().partitionId(), 0
        for batch in batches:
            names = batch.column("doc_id")
            for first, end, data, offsets in text_slices(batch.column("text")):
                ids, before = encoder.ids(data, offsets)
                ids, counts = np.insert(ids, before[1:], end_id), np.diff(before) + 1
                own = names.slice(first, end - first)
                yield pa.RecordBatch.from_pylist([{
                    "part": part, "seq": seq, "n_tokens": len(ids), "n_docs": len(counts),
                    "doc_ids": own.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
                    "no_id": np.packbits(own.is_null().to_numpy(zero_copy_only=False)).tobytes(),
                    "shard": shard_bytes(ids, counts, percentile),
                }], schema=pa.schema([
                    ("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("n_docs", pa.int32()),
                    ("doc_ids", pa.binary()), ("no_id", pa.binary()), ("shard", pa.binary()),
                ]))
                seq += 1

    return shards


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, percentile: int = PERCENTILE, plain: bool = False) -> None:
    """Encode `text` of (doc_id, text) rows and write all ids in ascending doc_id order.

    Rows are range-partitioned by document id, each partition is one run of
    shards (`plain`: see `Encoder`), and the number of a partition is its place in that order.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(_writer(tokenizer, end_id, percentile, plain), SHARDS).write.parquet(path)


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, counts = shard_ids(row["shard"])
                ends = np.cumsum(counts.astype(np.int64))
                starts = ends - counts
                view = ids.astype("<u4").tobytes()
                bounds = list(zip(starts.tolist(), ends.tolist(), strict=True))
                missing = np.unpackbits(np.frombuffer(row["no_id"], np.uint8))[: len(counts)].astype(bool)
                columns = [
                    pa.array(np.full(len(counts), row["part"], np.int32)),
                    pa.array(np.full(len(counts), row["seq"], np.int32)),
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=missing),
                    pa.array(starts), pa.array(counts.astype(np.int64)),
                    pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in bounds], pa.int64()),
                    pa.array([ids[a:b].astype(np.int32) if with_ids else None for a, b in bounds], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32", "ids"]
                )

    table = spark.read.schema(SHARDS).parquet(path)
    # Ids before each shard: first before each partition (as many rows as files), then within it.
    shards = table.select("part", "seq", "n_tokens")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start")
    )
    starts = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("in_part"))
    starts = starts.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("base"))
    out = table.select("part", "seq", "doc_ids", "no_id", "shard").mapInArrow(documents, DOCS).join(starts, ["part", "seq"])
    columns = ["doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"]
    return out.select(*columns, *(["ids"] if with_ids else []))


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, with_ids: bool = False, plain: bool = False) -> DataFrame:
    """Write the ids of all documents to a new folder in the shared place, and read them back."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, plain=plain)
    return read_tokens(docs.sparkSession, path, with_ids)
