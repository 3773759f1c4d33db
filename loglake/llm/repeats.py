"""Removing passages that stand earlier in the corpus, word for word.

A window is 20 consecutive words.  Each word in a window whose words also
start earlier (in a document with a smaller id, or earlier in the same one) is
removed.  Windows are judged on the input.

Difference cover: of every 13 word positions only 0, 1, 3 and 9 carry an
anchor, the hash of the 8 words from there.  The differences of these four
residues give every number modulo 13, so for any two positions some step of 0
to 12 words leads to an anchor position in both; 12 + 8 words are a window, so
two equal windows share an aligned anchor.  Only 4 of 13 positions are hashed
and shuffled to find anchors that occur again; then each such anchor is
extended to the windows around it, whose full hashes (80 bits, besides those
that choose the bucket) settle which is the earliest.

Groups: both hash tables are split by hash into buckets of bounded size.  A
slice of texts sends an anchor once however often it holds it, and a group of
documents sends a window once, so a passage that stands in a third of all
documents loads its bucket with one record per slice.

Defined results: null texts have no words; rows without an id come before all
others and count as one document, as do rows with the same id (of equal places
in them none is earlier); texts under 20 words are kept whole; an empty table
gives no rows.  All other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Words, mix, text_slices, windows

WINDOW = 20
PERIOD = 13
COVER = np.isin(np.arange(PERIOD), [0, 1, 3, 9])
ANCHOR = WINDOW - PERIOD + 1
BUCKET_BYTES = 16 << 20  # text per bucket
NO_ID = -(1 << 63)
OTHER = np.uint64(0xA0761D6478BD642F)

ANCHORS = "bucket int, tag_low binary, tag_high binary, doc binary, pos binary"
PLACES = "bucket int, doc binary, variant binary, pos binary"
WINDOWS = "bucket int, tag_low binary, tag_high binary, doc binary, variant binary, pos binary"


def bucket_of(doc_id: Column, n: int) -> Column:
    return F.pmod(doc_id.bitwiseXOR(F.shiftright(doc_id, 7)).bitwiseXOR(F.shiftright(doc_id, 17)), F.lit(n)).cast("int")


def _bucket_of(doc_id: np.ndarray, n: int) -> np.ndarray:
    return (doc_id ^ (doc_id >> 7) ^ (doc_id >> 17)) % n


def _split(bucket: np.ndarray, columns: list, names: list[str], n: int):
    """One record batch with a row per bucket; each column holds the bucket's values as bytes."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.diff(bucket[order], prepend=bucket[order[0]] - 1))
    ends = np.append(at[1:], len(order))
    arrays = [pa.array(bucket[order[at]].astype(np.int32))]
    for c in columns:
        if c is None:
            arrays.append(pa.nulls(len(at), pa.binary()))
            continue
        c = c[order]
        view, size = c.tobytes(), c.itemsize
        arrays.append(pa.array([view[size * a : size * b] for a, b in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary()))
    yield pa.RecordBatch.from_arrays(arrays, ["bucket", *names])


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), kind)


def _anchors(n: int):
    names = ["tag_low", "tag_high", "doc", "pos"]

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, end, data, offsets in text_slices(batch.column("text")):
                words = Words(data, offsets)
                hashes = windows(words.hashes(), ANCHOR)
                doc = np.repeat(np.arange(end - first), words.counts)[: len(hashes)]
                pos = np.arange(len(doc)) - words.first[doc]
                at = np.flatnonzero(COVER[pos % PERIOD] & (pos + ANCHOR <= words.counts[doc]) & (words.counts[doc] >= WINDOW))
                if not len(at):
                    continue
                key, doc, pos = hashes[at], ids[first + doc[at]], pos[at].astype("<u4")
                unique, one, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                again = count[inverse] > 1  # known to be shared already
                yield from _split(
                    (unique & np.uint64(0xFFFFFFFF)).astype(np.int64) % n,
                    [(unique >> np.uint64(16)).astype("<u4"), (unique >> np.uint64(48)).astype("<u2"), doc[one].astype("<i8"), pos[one]],
                    names, n,
                )
                own = np.full(int(again.sum()), -1 - int(key[0] % np.uint64(n)), np.int64)
                yield from _split(own, [None, None, doc[again].astype("<i8"), pos[again]], names, n)

    return run


def _shared_anchors(n: int):
    """Places of anchors that occur in several slices, or again in one."""
    def run(table: pa.Table) -> pa.Table:
        doc, pos = _joined(table, "doc", "<i8"), _joined(table, "pos", "<u4")
        if table.column("bucket")[0].as_py() >= 0:
            tag = _joined(table, "tag_low", "<u4").astype(np.uint64) | _joined(table, "tag_high", "<u2").astype(np.uint64) << np.uint64(32)
            _, inverse, count = np.unique(tag, return_inverse=True, return_counts=True)
            doc, pos = doc[count[inverse] > 1], pos[count[inverse] > 1]
        return _places(doc, None, pos, n)

    return run


def _places(doc, variant, pos, n: int) -> pa.Table:
    schema = pa.schema([("bucket", pa.int32()), ("doc", pa.binary()), ("variant", pa.binary()), ("pos", pa.binary())])
    return pa.Table.from_batches(_split(_bucket_of(doc, n), [doc, variant, pos], ["doc", "variant", "pos"], n), schema)


def _variants(docs: pa.Table) -> np.ndarray:
    """0 for the only text of an id; rows of one id with several texts are numbered by text."""
    ids = docs.column("doc_id").to_numpy()
    out = np.zeros(len(ids), np.uint16)
    values, count = np.unique(ids, return_counts=True)
    repeated = set(values[count > 1].tolist())
    if repeated:
        texts: dict = {}
        rows = [i for i, x in enumerate(ids.tolist()) if x in repeated]
        for i in rows:
            texts.setdefault(int(ids[i]), set()).add(docs.column("text")[i].as_py() or "")
        number = {d: {t: k for k, t in enumerate(sorted(s))} for d, s in texts.items()}
        for i in rows:
            out[i] = number[int(ids[i])][docs.column("text")[i].as_py() or ""]
    return out


def _extended(n: int):
    """Windows around shared anchors: the earliest of each to its bucket, the rest as settled places."""
    names = ["tag_low", "tag_high", "doc", "variant", "pos"]
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in names)])

    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        anchor_doc, anchor_pos = _joined(flags, "doc", "<i8"), _joined(flags, "pos", "<u4").astype(np.int64)
        order = np.argsort(anchor_doc, kind="stable")
        anchor_doc, anchor_pos = anchor_doc[order], anchor_pos[order]
        ids, variants = docs.column("doc_id").to_numpy(), _variants(docs)
        found = []
        lo, hi = np.searchsorted(anchor_doc, ids), np.searchsorted(anchor_doc, ids, "right")
        rows = np.flatnonzero(hi > lo)
        texts = docs.column("text").take(pa.array(rows)) if len(rows) else pa.chunked_array([], pa.string())
        for first, end, data, offsets in text_slices(texts):
            words = Words(data, offsets)
            own = rows[first:end]
            size = hi[own] - lo[own]
            doc = np.repeat(np.arange(end - first), size)
            take = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[own], size)
            at = anchor_pos[take]
            good = (at + ANCHOR <= words.counts[doc]) & (words.counts[doc] >= WINDOW)
            doc, at = doc[good], at[good]
            begin = words.first[doc] + np.maximum(at - (PERIOD - 1), 0)
            last = words.first[doc] + np.minimum(at, words.counts[doc] - WINDOW)
            step = np.zeros(len(words.starts) + 2, np.int64)
            np.add.at(step, begin[begin <= last], 1)
            np.add.at(step, last[begin <= last] + 1, -1)
            start = np.flatnonzero(np.cumsum(step)[:-2] > 0)
            if not len(start):
                continue
            hashes = words.hashes()
            doc = np.searchsorted(words.first, start, "right") - 1
            found.append((
                windows(hashes, WINDOW)[start], windows(mix(hashes ^ OTHER), WINDOW)[start],
                ids[own[doc]], variants[own[doc]], (start - words.first[doc]).astype("<u4"),
            ))
        if not found:
            return schema.empty_table()
        one, two, doc, variant, pos = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((pos, doc, two, one))
        one, two, doc, variant, pos = (x[order] for x in (one, two, doc, variant, pos))
        later = _later(one, two, doc, pos)
        sent = ~later
        batches = list(_split(
            (two[sent] & np.uint64(0xFFFFFFFF)).astype(np.int64) % n,
            [one[sent].astype("<u8"), (two[sent] >> np.uint64(48)).astype("<u2"), doc[sent].astype("<i8"), variant[sent], pos[sent]],
            names, n,
        ))
        if later.any():
            own = np.full(int(later.sum()), -1 - docs.column("bucket")[0].as_py(), np.int64)
            batches += _split(own, [None, None, doc[later].astype("<i8"), variant[later], pos[later]], names, n)
        return pa.Table.from_batches(batches, schema)

    return run


def _later(one, two, doc, pos) -> np.ndarray:
    """Of windows sorted by hash and place: whether an equal one stands earlier."""
    if not len(one):
        return np.zeros(0, bool)
    new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (doc != doc[head]) | (pos != pos[head])


def _repeated(n: int):
    """Places of windows that are not the earliest of their kind."""
    def run(table: pa.Table) -> pa.Table:
        doc, variant, pos = _joined(table, "doc", "<i8"), _joined(table, "variant", "<u2"), _joined(table, "pos", "<u4")
        if table.column("bucket")[0].as_py() >= 0:
            one, two = _joined(table, "tag_low", "<u8"), _joined(table, "tag_high", "<u2")
            order = np.lexsort((pos, doc, two, one))
            one, two, doc, variant, pos = (x[order] for x in (one, two, doc, variant, pos))
            later = _later(one, two, doc, pos)
            doc, variant, pos = doc[later], variant[later], pos[later]
        return _places(doc, variant, pos, n)

    return run


def _kept(with_text: bool):
    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        doc, variant, pos = _joined(flags, "doc", "<i8"), _joined(flags, "variant", "<u2"), _joined(flags, "pos", "<u4")
        order = np.lexsort((variant, doc))
        doc, variant, pos = doc[order], variant[order], pos[order].astype(np.int64)
        ids, variants = docs.column("doc_id").to_numpy(), _variants(docs)
        lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
        out = []
        for i, text in enumerate(docs.column("text")):
            words = (text.as_py() or "").encode().split()
            n_words = len(words)
            if hi[i] > lo[i]:
                at = pos[lo[i] : hi[i]][variant[lo[i] : hi[i]] == variants[i]]
                step = np.zeros(n_words + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + WINDOW, -1)
                words = list(compress(words, (np.cumsum(step)[:-1] == 0).tolist()))
            kept = b" ".join(words)
            out.append((n_words, n_words - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        columns = list(zip(*out, strict=True))
        return pa.Table.from_arrays([
            pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
            pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()),
        ], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and, unless told otherwise, the kept text.

    The documents are shuffled once: both steps that need the texts are
    co-grouped on the same exchange.
    """
    spark = docs.sparkSession
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    source = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES + 1)

    anchors = source.mapInArrow(_anchors(n), ANCHORS)
    shared = anchors.groupBy("bucket").applyInArrow(_shared_anchors(n), PLACES)
    placed = source.withColumn("bucket", bucket_of(F.col("doc_id"), n))
    near = placed.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(_extended(n), WINDOWS)
    repeated = near.groupBy("bucket").applyInArrow(_repeated(n), PLACES)
    out = placed.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(
        _kept(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )
    return out if with_text else out.drop("kept")
