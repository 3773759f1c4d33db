"""Packing documents into training sequences by vector best-fit.

Documents become pieces of at most `length` tokens; only longer ones are cut,
from the end, so that the first piece may be shorter.  A sequence is a bin
with three capacities: tokens, documents, and attention cost (the sum of
squared piece lengths).  Pieces are taken from the largest down, and each goes
to the open sequence that holds it under every capacity and is left with the
smallest weighted residual norm; if there is none, a new sequence is opened.

Pieces are dealt at random into groups of about `GROUP` pieces, and each group
is packed alone, so the work per piece is bounded and no group grows with the
input.  A group leaves a few sequences partly filled, out of thousands.

Defined results: a null or empty text is one piece of the end id alone; rows
with the same or no id are packed as documents of their own; an empty table
gives no rows.  All other columns of the input are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .tokens import Encoder
from .words import text_slices

LENGTH = 2048
MAX_DOCS = 1024
WEIGHTS = (1.0, 0.05, 0.05)  # of residual tokens, documents and attention cost
GROUP = 8000
SLICE_BYTES = 1 << 20  # of text encoded at once
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, with_ids: bool = True, plain: bool = False) -> DataFrame:
    """Pieces of all documents: place in the document, length, checksum and (little-endian u32) ids."""
    def cut(batches):
        encoder = Encoder.of(tokenizer, plain)
        for batch in batches:
            names = batch.column("doc_id")
            for first, end, data, offsets in text_slices(batch.column("text"), SLICE_BYTES):
                ids, before = encoder.ids(data, offsets)
                ids, sizes = np.insert(ids, before[1:], end_id), np.diff(before) + 1
                n = -(-sizes // length)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = sizes - (n - 1) * length  # of the first piece
                size = np.where(piece == 0, head[doc], length)
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * length)
                ends = np.cumsum(size)
                view = ids.astype("<u4").tobytes()
                parts = [view[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    names.slice(first, end - first).take(pa.array(doc)).cast(pa.int64()),
                    pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(size.astype(np.int64)),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    pa.array(parts if with_ids else [None] * len(parts), pa.binary()),
                ], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, length: int, max_docs: int, max_cost: float, weights=WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece of one group."""
    capacity = np.array([length, max_docs, max_cost], float)
    scale = np.array(weights) / capacity**2
    order = np.argsort(-lengths, kind="stable")
    left = np.empty((len(lengths), 3))  # of open sequences
    number = np.empty(len(lengths), np.int64)
    open_, made = 0, 0
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = int(lengths.min()) if len(lengths) else 0
    for i in order.tolist():
        need = np.array([lengths[i], 1, float(lengths[i]) ** 2])
        best = -1
        if open_:
            after = left[:open_] - need
            fits = (after >= 0).all(axis=1)
            if fits.any():
                norm = np.where(fits, (after * after) @ scale, np.inf)
                best = int(norm.argmin())
        if best < 0:
            best, left[open_], number[open_] = open_, capacity, made
            open_, made = open_ + 1, made + 1
        sequence[i], offset[i] = number[best], length - int(left[best, 0])
        left[best] -= need
        if (left[best] < (least, 1, float(least) ** 2)).any():  # nothing fits any more
            open_ -= 1
            left[best], number[best] = left[open_], number[open_]
    return sequence, offset


def place(cut: DataFrame, length: int = LENGTH, max_docs: int = MAX_DOCS, max_cost: float | None = None, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to stored pieces."""
    cost = float(length) ** 2 if max_cost is None else max_cost
    groups = -(-cut.count() // group) or 1
    kept = [c for c in cut.columns]

    def packed(table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_numpy()
        sequence, offset = best_fit(sizes, length, max_docs, cost)
        ids = sequence + (table.column("_group")[0].as_py() << 32)
        return table.select(kept).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    dealt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).alias("_group")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return cut.select("*", dealt).groupBy("_group").applyInArrow(packed, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, max_docs: int = MAX_DOCS, with_ids: bool = True, plain: bool = False) -> DataFrame:
    """One row per piece with its sequence and offset; `ids` too, unless told otherwise."""
    cut = pieces(docs, tokenizer, end_id, length, with_ids, plain)
    return place(stored(cut if with_ids else cut.drop("ids"), "pieces"), length, max_docs)
