"""Periodic runs of words: every longest stretch that repeats itself.

A run is a stretch of consecutive words with smallest period q, at least
max(LEAST, 2 * q) words long, that no neighbouring word extends.

A document is laid out in overlapping tiles, once for each octave of periods
[P, 2 * P): a boundary every P words, with 2 * P words to the left and up to
4 * P to the right of it.  A run of such a period is at least two periods long, so
it holds a boundary b with b + q inside it.  At a boundary two Z-functions, one
forwards from it and one backwards, give for every period of the octave how
far the words agree with those q further on, which is the part of the run in
that tile.  Tiles are solved on their own.  Since the agreement to one side is at least
half of what is needed, a tile is solved only if a window of that half occurs again
at a distance in the octave: hashes of windows tell, and the Z-functions compare the words.

Parts are shuffled by document and period, and those that overlap by a period
are stitched.  Of equal stretches the one with the smallest period counts: a
period q of a stretch of two periods is a multiple of the smallest one.

Documents of up to LONG words are tiled and solved where they are read.
Longer ones are cut into spans of SPAN words with the margins of their octave
and dealt out, so that no task solves all tiles of a long document.  Documents
without any part are finished in the first pass; only the others, and the parts, are
shuffled.

Defined results: a null text has no words, and so no runs; a document with a
null id is not rewritten; equal rows give equal rows; an empty table gives no
rows; all other columns of the input are left out.  A task holds the words of
the longest document, about 100 bytes a word, when it numbers them and when
it collapses it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .words import text_slices, windows

LEAST = 12
LONG = 1 << 14  # words of a document that is solved where it is read
SPAN = 1 << 13  # a power of two, so that boundaries stand at the same places in all spans
SLICE_BYTES = 1 << 20
FIRST = (1, 8, 4, 16)  # the first octave: periods 1 to 7, a boundary every 4 words, 16 words of margin


def octaves(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(least period, end of the periods, distance of boundaries, margin) for documents of n words."""
    if n >= LEAST:
        yield FIRST
    p = FIRST[1]
    while 2 * p <= n:
        yield p, 2 * p, p, 2 * p
        p *= 2


def needed(period: int) -> int:
    """Words of a run beyond its first period."""
    return max(LEAST, 2 * period) - period


def z_function(s: list) -> list[int]:
    """For each place, how many elements from there on agree with those from the start."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def solve_tile(words: np.ndarray, b: int, lo: int, hi: int, margin: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the parts of runs that hold the boundary b and the place a period further."""
    begin = max(0, b - margin)
    ahead = words[b : b + hi - 1 + margin].tolist()
    forward = z_function(ahead)
    left = words[begin:b][::-1].tolist()
    # The words before b + q, read backwards, against those before b.
    onto = words[begin : b + hi - 1][::-1].tolist()
    backward = z_function([*left, None, *onto])
    at = len(left) + len(onto) - (b - begin)  # where b + q stands in `backward` for q = 0
    for q in range(lo, min(hi, len(ahead))):
        f, g = min(forward[q], margin), min(backward[at + 1 - q], margin)
        if f + g >= needed(q):
            yield q, b - g, b + q + f


def promising(words: np.ndarray, lo: int, hi: int, step: int) -> np.ndarray:
    """Boundaries, multiples of `step`, at which a window of half the needed words occurs again at a period of the octave."""
    n = len(words)
    half = -(-min(map(needed, range(lo, hi))) // 2) if lo == 1 else -(-lo // 2)
    # Places without a window get values of their own: they agree with nothing.
    hashes = np.arange(n + 2 * hi + half, dtype=np.uint64)
    own = windows(words.astype(np.uint64) + np.uint64(1), half)
    hashes[half : half + len(own)] = own  # hashes[i + half] is that of the window at i
    bounds = np.arange(0, n, step)
    good = np.zeros(len(bounds), bool)
    for shift in (half, 0):  # the window after the boundary, and the one before it
        if lo == 1:
            for q in range(lo, hi):
                good |= hashes[bounds + shift] == hashes[bounds + q + shift]
        else:
            table = hashes[shift : shift + (len(bounds) + 1) * step].reshape(len(bounds) + 1, step)
            good |= (table[1:] == table[:-1, :1]).any(1)
    return bounds[good]


def stitched(parts: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Parts (owner, period, start, end) of one task, joined where they overlap by a period; the smallest period of equal ones."""
    whole: list[list[int]] = []
    for owner, q, start, end in sorted(parts):
        last = whole[-1] if whole else None
        if last and last[0] == owner and last[1] == q and start <= last[3] - q:
            last[3] = max(last[3], end)
        else:
            whole.append([owner, q, start, end])
    least: dict = {}
    for owner, q, start, end in whole:
        at = (owner, start, end)
        if q < least.get(at, q + 1):
            least[at] = q
    return [(owner, q, start, end) for (owner, start, end), q in least.items()]


def solve(texts: list[np.ndarray], kinds: list[tuple[int, int, int, int]] | None = None) -> list[tuple[int, int, int, int]]:
    """Parts (text, period, start, end) of all tiles of texts given as word numbers.

    The texts are solved in one row, each followed by a number of its own that
    no run can cross.  `kinds` limits the octaves.
    """
    found = []
    most = max(map(len, texts), default=0)
    for lo, hi, step, margin in kinds if kinds is not None else octaves(most):
        least = max(LEAST, 2 * lo)
        owners = [i for i, t in enumerate(texts) if len(t) >= least]
        if not owners:
            continue
        row = np.concatenate([x for i in owners for x in (texts[i], np.array([-1 - i]))])
        ends = np.cumsum([len(texts[i]) + 1 for i in owners])
        for b in promising(row, lo, hi, step).tolist():
            for q, start, end in solve_tile(row, b, lo, hi, margin):
                k = int(np.searchsorted(ends, start, "right"))
                base = int(ends[k - 1]) if k else 0
                found.append((owners[k], q, start - base, end - base))
    return stitched(found)


def spans(n: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(first octave, end of the octaves, first word, end) of the spans of a document of n words."""
    kinds = list(octaves(n))
    small = sum(1 for k in kinds if 8 * k[0] <= size)  # these go together
    for first, end in [(0, small)] * (small > 0) + [(k, k + 1) for k in range(small, len(kinds))]:
        step, margin = kinds[end - 1][2], kinds[end - 1][3]
        width = max(size, step)
        for at in range(0, n, width):
            yield first, end, max(0, at - margin), min(n, at + width + margin + 2 * step)


# -- documents -------------------------------------------------------------------

def rewritten_places(name: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place, for documents whose end is made periodic."""
    if name is None or not n:
        return None
    h = zlib.crc32(str(name).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


DONE, TEXT, PART, SPAN_ROW = range(4)  # kinds of rows of the first pass
PASS_SCHEMA = "kind int, key binary, doc_id long, text string, sha256 string, period long, start long, stop long, words binary, first int, last int"
PASS_TYPES = pa.schema([
    ("kind", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()), ("text", pa.string()), ("sha256", pa.string()),
    ("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("words", pa.binary()), ("first", pa.int32()), ("last", pa.int32()),
])


def _pass_rows(names: list, raws: list[bytes], plain: bool, long_words: int, span: int) -> list[tuple]:
    """Rows of the first pass for some documents."""
    known: dict = {}
    lists, numbers = [], []
    for name, raw in zip(names, raws, strict=True):
        words = raw.split()
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        places = None if plain else rewritten_places(name, len(words))
        if places is not None:
            words, ids = [words[k] for k in places.tolist()], ids[places]
        lists.append(words)
        numbers.append(ids)
    short = [i for i, ids in enumerate(numbers) if len(ids) <= long_words]
    parts: dict[int, list] = {}
    for k, q, start, end in solve([numbers[i] for i in short]):
        parts.setdefault(short[k], []).append((q, start, end))
    rows = []
    for i, (name, words) in enumerate(zip(names, lists, strict=True)):
        text = b" ".join(words)
        long_ = len(words) > long_words
        if not long_ and i not in parts:
            rows.append((DONE, None, name, None, hashlib.sha256(text).hexdigest(), *[None] * 6))
            continue
        key = hashlib.blake2b(str(name).encode() + b":" + text, digest_size=16).digest()
        rows.append((TEXT, key, name, text.decode(), *[None] * 7))
        rows += [(PART, key, None, None, None, q, start, end, None, None, None) for q, start, end in parts.get(i, ())]
        if long_:
            own = np.unique(numbers[i], return_inverse=True)[1].astype(np.int32)
            for first, last, start, end in spans(len(own), span):
                rows.append((SPAN_ROW, key, None, None, None, len(own), start, end, own[start:end].tobytes(), first, last))
    return rows


def first_pass(docs: DataFrame, plain: bool = False, long_words: int = LONG, span: int = SPAN) -> DataFrame:
    """Finished documents, texts of the others, parts of their runs, and spans of long ones."""
    def run(batches):
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, end, data, offsets in text_slices(batch.column("text"), SLICE_BYTES):
                raws = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(end - first)]
                rows = _pass_rows(names[first:end], raws, plain, long_words, span)
                size = 0
                held: list = []
                for row in rows:  # spans of a long document are many times its size
                    held.append(row)
                    size += len(row[3] or "") + len(row[8] or b"") + 100
                    if size > 4 * SLICE_BYTES:
                        yield _batch(held, PASS_TYPES)
                        held, size = [], 0
                if held:
                    yield _batch(held, PASS_TYPES)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, PASS_SCHEMA)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds
    )


def span_parts(rows: DataFrame) -> DataFrame:
    """Parts of the runs in the spans of long documents, dealt out by span."""
    kinds = pa.schema([("key", pa.binary()), ("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], np.int32).astype(np.int64)
                chosen = list(octaves(row["period"]))[row["first"] : row["last"]]
                found = solve([words], chosen)
                if found:
                    yield _batch([(row["key"], q, a + row["start"], b + row["start"]) for _, q, a, b in found], kinds)

    dealt = rows.where(F.col("kind") == SPAN_ROW).select("key", "period", "start", "words", "first", "last")
    return dealt.repartition("key", "first", "start").mapInArrow(run, "key binary, period long, start long, stop long")


def stitch(parts: DataFrame) -> DataFrame:
    """(key, runs) from parts (key, period, start, stop): whole runs of each document by start and period."""
    before = Window.partitionBy("key", "period").orderBy("start", "stop")
    reach = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach - F.col("period")), 1).otherwise(0)
    marked = parts.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(before))
    whole = marked.groupBy("key", "period", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    least = whole.groupBy("key", "start", "stop").agg(F.min("period").alias("period"))
    run = F.struct("start", (F.col("stop") - F.col("start")).alias("length"), "period")
    return least.groupBy("key").agg(F.sort_array(F.collect_list(run)).alias("runs"))


RESULT_SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, collapsed string"
)
NO_RUNS = hashlib.sha256(b"").hexdigest()


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The text without what any run repeats after its first period."""
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        steps[start + q] += 1
        steps[start + length] -= 1
    gone = np.cumsum(steps[:-1]) > 0
    return " ".join(w for w, drop in zip(words, gone.tolist(), strict=True) if not drop)


def find_runs(
    docs: DataFrame, with_text: bool = True, plain: bool = True, long_words: int = LONG, span: int = SPAN
) -> DataFrame:
    """Per document: its runs, the longest of them, and its text without what they repeat.

    `runs` lists all runs by start and period; `runs_sha256` digests them and
    `collapsed_sha256` the collapsed text, which `with_text` adds.  Without
    `plain`, documents chosen by a hash of their id get a periodic end first.
    """
    kinds = pa.schema([
        ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")),
        ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("collapsed", pa.string()),
    ])

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                runs = [(r["start"], r["length"], r["period"]) for r in row["runs"] or ()]
                text = collapsed(row["text"].split(" ") if row["text"] else [], runs)
                best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
                rows.append((
                    row["doc_id"], len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
                    hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(),
                    text if with_text else None,
                ))
            if rows:
                yield _batch(rows, kinds)

    rows = stored(first_pass(docs, plain, long_words, span), "periods")
    parts = rows.where(F.col("kind") == PART).select("key", "period", "start", "stop")
    runs = stitch(parts.unionByName(span_parts(rows)))
    texts = rows.where(F.col("kind") == TEXT).select("key", "doc_id", "text")
    found = texts.join(runs, "key", "left").select("doc_id", "text", "runs").mapInArrow(run, RESULT_SCHEMA)
    none = F.lit(None)
    finished = rows.where(F.col("kind") == DONE).select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"),
        *(none.cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")),
        F.lit(NO_RUNS).alias("runs_sha256"), F.col("sha256").alias("collapsed_sha256"), none.cast("string").alias("collapsed"),
    )
    out = found.unionByName(finished)
    return out if with_text else out.drop("collapsed")
