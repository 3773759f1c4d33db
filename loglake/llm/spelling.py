"""Spelling variants: words one edit apart, found by Gram matrices of letter counts.

One edit changes a word's letter counts by a squared distance of at most two:
one for a letter more or less, two for a letter in place of another.  Words
are vectors of letter counts; the NumPy product of two blocks of them gives
all squared distances of the block at once, and only pairs at most two apart
are compared letter by letter.

Blocks hold neighbouring lengths m and m + 1 and words that agree in their
first m // 2 letters or in their last m - m // 2: an edit changes only one of
the two, so every pair one edit apart meets in a block.  A block of more than
BLOCK words is dealt out again by the letters of each of three groups of the
alphabet: an edit touches at most two letters, so one group's counts stay the
same.  What is still too large is cut by a hash of the word, and every two
cuts meet in a tile.  A pair counts only in the first block it meets in, so
nothing has to be made distinct afterwards.

A word's form is its near word of the largest count, if that is at least
RATIO times its own.  Counts grow by that ratio along a chain of forms, so a
chain has at most 19 steps and doubling reaches its end in five rounds.

Defined results: a null text has no words; a null id stands as the empty
string before the colon of the hash; every row counts, equal ones too; an
empty table gives no rows.  A text is searched in parts of about PART bytes
that end between words, so a task holds one text and the distinct words of a
part, whatever the text's length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .words import text_slices

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
CUT_EVERY = 31  # one word in so many loses a letter
PART = 1 << 20
HELD_WORDS = 200_000  # distinct words a task counts before it passes them on
BLOCK = 4096
PACK = 512  # words of small blocks multiplied together
TILE_BYTES = 4 << 20
COLUMNS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)])  # letters of words
# Three groups of letters with about the same share of a text each.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz" + "".join(map(chr, range(0xC0, 0x100)))
GROUPS = [LETTERS[g::3] for g in range(3)]

RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
BETWEEN = re.compile(rb"[\x00-\x60\x7b-\x7f\xc2\xc4-\xff]")  # bytes that start no letter of a run


def parts(text: bytes) -> Iterator[bytes]:
    """Pieces of a text that cut no word."""
    at = 0
    while at < len(text):
        found = BETWEEN.search(text, at + PART) if len(text) - at > PART else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def spelled(name: str, run: bytes) -> str:
    """A lower-cased word as it counts: one in CUT_EVERY, by its hash, loses a letter."""
    word = run.decode()
    h = zlib.crc32(run, zlib.crc32(f"{name}:".encode()))
    if h % CUT_EVERY == 0:
        at = h % len(word)
        word = word[:at] + word[at + 1 :]
    return word


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): words of LEAST_LENGTH letters or more that occur LEAST_COUNT times or more."""
    def run(batches):
        kinds = pa.schema([("word", pa.string()), ("n", pa.int64())])

        def out(counts):
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=kinds
            )

        counts: Counter = Counter()
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, end, data, offsets in text_slices(batch.column("text")):
                for i in range(end - first):
                    text = data[offsets[i] : offsets[i + 1]].tobytes().lower()
                    name = "" if names[first + i] is None else str(names[first + i])
                    for part in parts(text):
                        for found, n in Counter(RUN.findall(part)).items():
                            if len(found) >= LEAST_LENGTH:
                                word = spelled(name, found)
                                if len(word) >= LEAST_LENGTH:
                                    counts[word] += n
                        if len(counts) > HELD_WORDS:
                            yield out(counts)
                            counts.clear()
        if counts:
            yield out(counts)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


# -- blocks ----------------------------------------------------------------------

def in_blocks(words: DataFrame) -> DataFrame:
    """Each word once per block it belongs to: key, side and letter group of the block, its own cut, both cuts equal."""
    length, m = F.length("word"), F.col("m")
    rows = words.withColumn("m", F.explode(F.array(length, length - 1))).where(m >= LEAST_LENGTH)
    rows = rows.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    first = F.expr("substring(word, 1, cast(floor(m / 2) AS int))")
    last = F.expr("substring(word, -cast(m - floor(m / 2) AS int))")
    rows = rows.withColumn("key", F.concat_ws("|", m, "side", F.when(F.col("side") == 0, first).otherwise(last)))
    rows = rows.select("word", "n", "m", "side", "key")

    sizes = rows.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.col("count").alias("size"))
    marked = rows.join(sizes, "key", "left")
    small = marked.where(F.col("size").isNull()).withColumn("g", F.lit(-1))
    parts_ = F.array(*[
        F.struct(
            F.lit(g).alias("g"),
            F.array_join(F.array_sort(F.split(F.regexp_replace("word", f"[^{letters}]", ""), "")), "").alias("letters"),
        )
        for g, letters in enumerate(GROUPS)
    ])
    large = marked.where(F.col("size").isNotNull()).withColumn("part", F.explode(parts_))
    large = large.withColumn("g", F.col("part.g")).withColumn("key", F.concat_ws("|", "key", "g", "part.letters"))
    again = large.groupBy("key").count().where(F.col("count") > BLOCK)
    cuts = again.select("key", F.ceil(F.col("count") * 2 / BLOCK).cast("int").alias("cuts"))
    large = large.join(cuts, "key", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    large = large.withColumn("cut", F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    tile = F.concat_ws("|", "key", F.least("cut", "other"), F.greatest("cut", "other"))
    large = large.withColumn("key", F.when(F.col("cuts") > 1, tile).otherwise(F.col("key")))
    columns = ["key", "m", "side", "g", "cut", "same", "word", "n"]
    small = small.withColumn("cut", F.lit(0)).withColumn("same", F.lit(True))
    large = large.withColumn("same", F.col("cut") == F.col("other"))
    return small.select(columns).unionByName(large.select(columns))


class Block:
    """Words of one or more small blocks as letter matrices."""

    def __init__(self, words: list[bytes], n_letters: int):
        n = len(words)
        self.sizes = np.fromiter(map(len, words), np.int64, n)
        self.letters = np.array(words, f"S{n_letters}").view(np.uint8).reshape(n, n_letters)
        cells = np.repeat(np.arange(n) * 256, self.sizes) + np.frombuffer(b"".join(words), np.uint8)
        self.counts = np.bincount(cells, minlength=n * 256).reshape(n, 256)[:, COLUMNS].astype(np.float32)
        self.squares = (self.counts * self.counts).sum(1)


def one_edit(a: Block, i: np.ndarray, b: Block, j: np.ndarray) -> np.ndarray:
    """Whether the words of each pair differ by exactly one letter in place, more or less."""
    out = np.zeros(len(i), bool)
    difference = a.sizes[i] - b.sizes[j]
    same = np.flatnonzero(difference == 0)
    out[same] = (a.letters[i[same]] != b.letters[j[same]]).sum(1) == 1
    for x, y, u, v, rows in ((a, b, i, j, difference == -1), (b, a, j, i, difference == 1)):
        rows = np.flatnonzero(rows)
        if not len(rows):
            continue
        short, long_ = x.letters[u[rows]], y.letters[v[rows]]
        m = x.sizes[u[rows]]
        width = short.shape[1]
        inside = np.arange(width) < m[:, None]
        ahead = (short != long_) & inside  # letters from the start
        behind = (short[:, : width - 1] != long_[:, 1:]) & inside[:, : width - 1]  # and from the end, past one letter
        head = np.where(ahead.any(1), ahead.argmax(1), m)
        last = width - 1 - behind[:, ::-1].argmax(1)
        tail = np.where(behind.any(1), m - last, m)
        out[rows] = head + tail >= m
    return out


def block_pairs(words: list[bytes], marks: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of words one edit apart that belong to this block and to no earlier one."""
    width = max(map(len, words)) + 1
    step = max(2, min(1024, TILE_BYTES // width))
    blocks = [Block(words[at : at + step], width) for at in range(0, len(words), step)]
    found_i, found_j = [], []
    for x, a in enumerate(blocks):
        for y in range(x, len(blocks)):
            b = blocks[y]
            squared = a.squares[:, None] + b.squares[None, :] - 2 * (a.counts @ b.counts.T)
            i, j = np.nonzero(squared <= 2)
            u, v = i + x * step, j + y * step
            good = (u < v) & (marks["block"][u] == marks["block"][v])
            good &= marks["same"][u] | (marks["cut"][u] != marks["cut"][v])
            good &= np.minimum(a.sizes[i], b.sizes[j]) == marks["m"][u]
            i, j, u, v = i[good], j[good], u[good], v[good]
            many = max(1, TILE_BYTES // width)
            for at in range(0, len(i), many):
                p, q = i[at : at + many], j[at : at + many]
                good = one_edit(a, p, b, q)
                p, q = p[good], q[good]
                good = _first_meeting(marks, p + x * step, a, p, b, q)
                found_i.append(p[good] + x * step)
                found_j.append(q[good] + y * step)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found_i or none), np.concatenate(found_j or none)


def _first_meeting(marks: dict[str, np.ndarray], u: np.ndarray, a: Block, p: np.ndarray, b: Block, q: np.ndarray) -> np.ndarray:
    """Pairs that agree in the first half meet there, not in the last; so do letter groups, in order."""
    half = marks["m"][u] // 2
    most = int(half.max(initial=0))
    differ = (a.letters[p, :most] != b.letters[q, :most]) & (np.arange(most) < half[:, None])
    good = (marks["side"][u] == 0) | differ.any(1)
    for g, letters in enumerate(GROUPS[:-1]):
        at = np.isin(COLUMNS, [ord(c) for c in letters])
        rows = np.flatnonzero(good & (marks["g"][u] > g))
        good[rows] = (a.counts[p[rows]][:, at] != b.counts[q[rows]][:, at]).any(1)
    return good


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every two words one edit apart, once from either side."""
    def run(batches):
        kinds = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

        def pairs(table: pa.Table):
            names = table.column("word").combine_chunks()
            letters = [w.encode("latin-1") for w in names.to_pylist()]
            key = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            marks = {c: table.column(c).to_numpy() for c in ("m", "side", "g", "cut", "same")}
            edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(edges[1:], len(key))
            at = 0
            while at < len(edges):
                first, end = edges[at], ends[at]
                at += 1
                wide = len(letters[first]) + 1
                while at < len(edges) and ends[at] - first <= PACK and wide * PACK <= TILE_BYTES:
                    wide = max(wide, len(letters[edges[at]]) + 1)
                    end = ends[at]
                    at += 1
                if end - first < 2:
                    continue
                own = {c: m[first:end] for c, m in marks.items()}
                i, j = block_pairs(letters[first:end], {**own, "block": key[first:end]})
                if len(i):
                    n = table.column("n").slice(first, end - first).combine_chunks()
                    w = names.slice(first, end - first)
                    x, y = pa.array(np.append(i, j)), pa.array(np.append(j, i))
                    yield pa.RecordBatch.from_arrays([w.take(x), w.take(y), n.take(y)], schema=kinds)

        held = None  # rows of the last block so far: it may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            key = table.column("key")
            cut = pc.sum(pc.not_equal(key, key[len(key) - 1])).as_py()
            yield from pairs(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield from pairs(held)

    rows = in_blocks(words).repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "word string, near string, near_n long")


# -- forms -----------------------------------------------------------------------

def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last form of each chain, found by doubling its steps."""
    reached = stored(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = reached.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        reached = stored(step, "roots")
        if not reached.where("moved").limit(1).count():
            return reached.select("word", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """Per word: its form, the root of its chain of forms, its count, its near words, and its form's count."""
    words = stored(count_words(docs), "words")
    near = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"),
    )
    best = -F.col("best.minus")
    enough = best >= F.col("n") * RATIO
    known = stored(
        words.join(near, "word", "left").select(
            "word",
            F.when(enough, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, best).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(known.where(F.col("form").isNotNull()))
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
