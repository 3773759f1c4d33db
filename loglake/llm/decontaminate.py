"""Documents that hold benchmark items, up to a few edited words.

A document holds an item of n words if one of its windows, of any number of
words, is within k = floor(0.2 n) word edits of it.  Words are
runs of letters, digits and non-ASCII characters in lower case.

1. CGK embedding: a walk reads a word sequence of length n in 3 n steps; at
   each step it notes the word it stands on, and a random function of (step,
   word) says whether it moves on.  Sequences a few edits apart fall into step
   again, so their embeddings differ in few places: edit distance becomes
   Hamming distance.
2. Bit sampling: a table's key is the notes of `SAMPLED` random steps.  There
   are `WALKS` walks of `TABLES` tables each.  Windows and items that share a
   key in any table are candidates.
3. Banded alignment settles each candidate exactly.  Where no window of n words
   (clipped at the end of the text) is close enough, the candidates are widened
   by k words on both sides and the item is aligned with free ends, so that
   words left out or put in count once.

Only windows that can match are embedded: with k edits at most, n - k words of
the window are words of the item, hence of some item of n words.

Items are taken in blocks of `BLOCK` and sent to the tasks that read the
documents; the documents are neither shuffled nor joined.

Defined results: null texts have no words; items under `LEAST` words are too
short to tell and are left out; items without an id keep a null id; repeated
rows are reported again, repeated items too; among windows of one item those
of its own size come first, then the closest, then the earliest, then the
shortest; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, LOWER, Words, edit_distance, ends_costs, text_slices

DISTANCE = 0.2
LEAST = 5
BLOCK = 500
WALKS, TABLES, SAMPLED = 4, 12, 3
SLICE = 2 << 20  # bytes of text searched at a time
ODD = np.uint64(0x9FB21C651E98DF25)
LOGGED = 32 << 20  # bytes of walks kept at a time


def allowed(n: int, distance: float = DISTANCE) -> int:
    return int(n * distance + 1e-9)


@cache
def sampled_steps(n: int) -> list:
    """Steps of each (walk, table) for sequences of n words; the same on every machine.

    A walk takes about two steps a word; later notes would stand after the end.
    """
    return np.random.default_rng(n).integers(0, 2 * n, (WALKS, TABLES, SAMPLED)).tolist()


def common_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words each row of a has in common with that of b, repeated ones as often as both have them."""
    if not a.size:
        return np.zeros(len(a), np.int64)

    def numbered(rows):
        """Words with their occurrence numbers."""
        rows = np.sort(rows, axis=1)
        at = np.broadcast_to(np.arange(rows.shape[1]), rows.shape)
        first = np.where(np.insert(rows[:, 1:] != rows[:, :-1], 0, True, axis=1), at, 0)
        return rows * rows.shape[1] + at - np.maximum.accumulate(first, axis=1)

    both = np.sort(np.concatenate([numbered(a), numbered(b)], axis=1), axis=1)
    return (both[:, 1:] == both[:, :-1]).sum(axis=1)


class Items:
    """A block of items, ready to be looked for.

    Words are numbered: those of the items from 0, then one number for all
    other words and one for what stands after the end of a sequence.
    """

    def __init__(self, rows: list[tuple], distance: float = DISTANCE):
        self.distance = distance
        texts = pa.array([text or "" for _, text in rows], pa.string())
        self.ids, own = [], []
        for first, _, data, offsets in text_slices(texts):
            words = Words(LOWER[data], offsets, ALNUM)
            hashes = words.hashes()
            for i, n in enumerate(words.counts.tolist()):
                if n >= LEAST:
                    self.ids.append(rows[first + i][0])
                    own.append(hashes[words.first[i] : words.first[i] + n])
        self.known = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        self.words = [np.searchsorted(self.known, w) for w in own]
        self.holds = np.zeros((len(own), len(self.known) + 2), bool)
        for i, w in enumerate(self.words):
            self.holds[i, w] = True
        self.sizes = np.array([len(w) for w in own], np.int64)
        longest = int(self.sizes.max()) if own else 0
        self.seeds = np.random.default_rng(1).integers(1, 2**63, (WALKS, 2 * longest), dtype=np.uint64)
        self.by_size, self.used = {}, {}
        self.flat, self.row = {}, np.zeros(len(own), np.int64)  # words of the items of a size, and the place of each item there
        for n in np.unique(self.sizes).tolist():
            which = np.flatnonzero(self.sizes == n)
            self.used[n] = self.holds[which].any(axis=0)
            flat = np.concatenate([self.words[i] for i in which])
            self.flat[n], self.row[which] = flat.reshape(len(which), n), np.arange(len(which))
            start = np.arange(len(which)) * n
            logs = self.walks(flat, start, 2 * n)
            tables = []
            for key in self.keys(flat, start, start + n, logs, slice(None), n):
                order = np.argsort(key, kind="stable")
                tables.append((which[order], key[order]))
            self.by_size[n] = tables

    def walks(self, numbers: np.ndarray, start: np.ndarray, steps: int) -> list[np.ndarray]:
        """For each walk, how far from its start it stands at each step."""
        names = np.append(self.known, np.array([1, 2], np.uint64))
        padded = np.append(numbers, np.full(steps + 1, len(self.known) + 1))
        kind = np.uint16 if steps < 1 << 16 else np.uint32
        out = []
        for seeds in self.seeds:
            at = start.copy()
            log = np.empty((steps, len(start)), kind)
            for step in range(steps):
                log[step] = at - start
                moves = ((names ^ seeds[step]) * ODD) >> np.uint64(63)
                at += moves.astype(np.int64)[padded[at]]
            out.append(log)
        return out

    def keys(self, numbers, start, stop, logs, columns, n: int) -> Iterator[np.ndarray]:
        """Keys of the sequences [start, stop) of numbers, one array per table."""
        base, ended = len(self.known) + 2, len(self.known) + 1
        for log, tables in zip(logs, sampled_steps(n), strict=True):
            for steps in tables:
                key = np.zeros(len(start), np.int64)
                for step in steps:
                    at = start + log[step, columns]
                    key = key * base + np.where(at < stop, numbers[np.minimum(at, len(numbers) - 1)], ended)
                yield key

    def matches(self, words: Words) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, words, distance) of the best window of each item in each text."""
        hashes = words.hashes()
        if not len(hashes) or not len(self.known):
            return []
        numbers = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        numbers[self.known[numbers] != hashes] = len(self.known)
        doc = np.repeat(np.arange(len(words.counts)), words.counts)
        end = words.first[doc + 1]
        starts = {}
        used = np.zeros(len(hashes), bool)
        longest = int(self.sizes.max())
        before = np.zeros(len(hashes) + 1 + longest, np.int32)
        for n in self.by_size:
            least = n - allowed(n, self.distance)
            np.cumsum(self.used[n][numbers], out=before[1 : len(hashes) + 1])
            before[len(hashes) + 1 :] = before[len(hashes)]
            # Windows over the end of their text count words of the next one too, so they are counted again.
            start = np.flatnonzero(before[n : n + len(hashes)] - before[: len(hashes)] >= least)
            stop = np.minimum(start + n, end[start])
            starts[n] = start[before[stop] - before[start] >= least]
            used[starts[n]] = True
        used = np.flatnonzero(used)
        best: dict = {}
        wide: dict = {}  # (text, item): candidates whose own window is not close enough
        steps = 2 * longest
        chunk = max(1, LOGGED // (8 * steps * WALKS))
        for first in range(0, len(used), chunk):
            part = used[first : first + chunk]
            logs = self.walks(numbers, part, steps)
            for n, tables in self.by_size.items():
                low, high = np.searchsorted(starts[n], [part[0], part[-1] + 1])
                start = starts[n][low:high]
                if len(start):
                    stop = np.minimum(start + n, end[start])
                    keys = self.keys(numbers, start, stop, logs, np.searchsorted(part, start), n)
                    self._settle(numbers, start, stop, n, zip(tables, keys, strict=True), doc, best, wide)
        for (text, item), ranges in wide.items():
            if (text, item) not in best:
                found = self._widened(numbers, sorted(ranges), item, int(words.first[text]), int(words.first[text + 1]))
                if found is not None:
                    best[text, item] = found
        return [(text, item, a - int(words.first[text]), b - a, cost) for (text, item), (cost, a, b) in sorted(best.items())]

    def _settle(self, numbers, start, stop, n: int, tables, doc, best: dict, wide: dict) -> None:
        """Align windows with the items that share a key with them."""
        most = allowed(n, self.distance)
        pairs = []
        for (which, own), keys in tables:
            low = np.searchsorted(own, keys)
            hit = np.flatnonzero(own[np.minimum(low, len(own) - 1)] == keys)
            low = low[hit]
            size = np.searchsorted(own, keys[hit], "right") - low
            take = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
            pairs.append(np.repeat(hit, size) * len(self.words) + which[take])
        window, which = np.divmod(np.unique(np.concatenate(pairs)), len(self.words))
        # With k edits at most, n - k words of the window are words of this very item.
        inside = start[window, None] + np.arange(n)
        inside = np.where(inside < stop[window, None], numbers[np.minimum(inside, len(numbers) - 1)], len(self.known) + 1)
        close = np.flatnonzero(self.holds[which[:, None], inside].sum(axis=1) >= n - most)
        # They have as many in common with repeated words counted; what has not is not aligned.
        can = common_words(inside[close], self.flat[n][self.row[which[close]]]) >= n - most
        for w, item, near in zip(window[close].tolist(), which[close].tolist(), can.tolist(), strict=True):
            a, b = int(start[w]), int(stop[w])
            cost = edit_distance(numbers[a:b].tolist(), self.words[item].tolist(), most) if near else most + 1
            text = int(doc[a])
            if cost <= most:
                if (text, item) not in best or (cost, a, b) < best[text, item]:
                    best[text, item] = (cost, a, b)
            elif (text, item) not in best:
                wide.setdefault((text, item), []).append((a, b))

    def _widened(self, numbers, ranges: list, item: int, low: int, high: int):
        """(distance, start, stop) of the closest window around the ranges, of any size, or None."""
        own = self.words[item].tolist()
        most = allowed(len(own), self.distance)
        joined: list = []
        for a, b in ranges:
            a, b = max(low, a - most), min(high, b + most)
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        found = None
        for a, b in joined:
            text = numbers[a:b].tolist()
            # From the right, so that each cost belongs to a start.
            costs = ends_costs(text[::-1], own[::-1])[::-1]
            cost = min(costs)
            if cost <= most and (found is None or cost < found[0]):
                s = costs.index(cost)
                size = next(m for m in range(max(0, len(own) - cost), len(own) + cost + 1) if edit_distance(text[s : s + m], own, cost) == cost)
                found = cost, a + s, a + s + size
        return found


def item_blocks(items: DataFrame, distance: float = DISTANCE) -> Iterator[Items]:
    """The items in blocks of bounded size, one at a time at the driver."""
    block: list = []
    for row in items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        block.append((row.item_id, row.text))
        if len(block) == BLOCK:
            yield Items(block, distance)
            block = []
    if block:
        yield Items(block, distance)


def _texts(batch):
    for first, _, data, offsets in text_slices(batch.column("text"), SLICE):
        yield first, Words(LOWER[data], offsets, ALNUM)


def find_items(docs: DataFrame, items: DataFrame, distance: float = DISTANCE) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, start, n_words, distance, similarity."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.withColumn("item_id", F.col("item_id").cast("long"))
    schema = "doc_id long, item_id long, start long, n_words long, distance long, similarity double"
    out = spark.createDataFrame([], schema)
    for block in item_blocks(items, distance):
        shared = spark.sparkContext.broadcast(block)

        def found(batches, shared=shared):
            block = shared.value
            for batch in batches:
                for first, words in _texts(batch):
                    rows = block.matches(words)
                    if rows:
                        text, item, start, n, cost = (np.array(c) for c in zip(*rows, strict=True))
                        size = np.array([len(block.words[i]) for i in item.tolist()])
                        yield pa.RecordBatch.from_arrays([
                            batch.column("doc_id").take(pa.array(first + text)),
                            pa.array([block.ids[i] for i in item.tolist()], pa.int64()),
                            pa.array(start), pa.array(n), pa.array(cost), pa.array(1 - cost / size),
                        ], ["doc_id", "item_id", "start", "n_words", "distance", "similarity"])

        out = out.unionByName(source.mapInArrow(found, schema))
    return out


def drop_documents(docs: DataFrame, items: DataFrame, distance: float = DISTANCE) -> DataFrame:
    """The rows of `docs`, with all columns, that hold no item."""
    for block in item_blocks(items.withColumn("item_id", F.lit(0)), distance):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, words in _texts(batch):
                    for text, *_ in shared.value.matches(words):
                        keep[first + text] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
