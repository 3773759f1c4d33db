"""Near-duplicate documents by order MinHash and banded alignment.

Two documents are near copies if the edit similarity of their word sequences
(1 - edit distance / words of the longer one) is at least `SIMILARITY`.  Words
are runs of letters, digits and non-ASCII characters, in lower case.

The ranges of word counts below are laid out for a similarity of 0.8 or more.

1. Documents with the same words are one class, so copies cost nothing later.
2. Keys that near copies share.  Texts of up to `SHORT` words: all that is
   left when up to as many words are taken out as may be edited; near copies
   have one of these in common for certain.  Longer texts: order MinHash, where
   every run of words is labelled with its occurrence number in the text; a
   sketch takes the 2 labelled runs with the least hashes and keeps them in text
   order, and `SKETCHES` sketches are taken.  Runs have 2 words up to `MIDDLE`
   words and 3 words above.  The ranges overlap by as much as near copies can
   differ in length, so that any two of them have keys of one kind.
3. Classes that share a key form a bucket.  Each is aligned with the bucket's
   leader first, `LEADERS` times over with another leader; a bucket's next leader
   is the least member that the links so far do not connect with the last one.
4. What is still in different groups within a bucket is compared in blocks of
   `BLOCK` classes.  Smaller buckets are one block; blocks of others hold one level of word counts and meet those of the
   same and of the neighbouring levels; the largest group of a bucket meets the
   others only, and buckets with the same members are one.  Buckets that hold
   much the same classes, as those of one common passage do, are joined into a
   pool first, so that a pair is met once and not in each of them.  The words
   come along, so that a block aligns its pairs itself and hands on links only,
   fewer than it has groups; pairs whose word counts rule out the similarity and
   pairs that its links have connected by then are left out.  Blocks are bounded
   in words too.  So every pair that shares a key is connected by links or aligned.
5. Alignment keeps to a band around the diagonal as wide as the similarity
   allows, and gives the exact edit distance within it.
6. Linked classes form groups (connected components, labels passed along links
   and shortened until nothing changes).

Recall is that of the keys: 1 for texts of up to `SHORT` words; above, a pair
whose runs have Jaccard similarity J (in the same order) shares a sketch with
probability 1 - (1 - J**2)**60.  With 20 % of the words changed J is about 0.34
for changes at random places, which gives 0.999, and 0.25 where no two changes
are within a run, which gives 0.98.

Defined results: a null text counts as empty; texts without words are copies
only if they are equal; rows without an id or with repeated ids are rows of
their own, and the first of a group is the one with the least id (none first),
then the least hash of its text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_batches, stored
from .words import ALNUM, LOWER, Words, edit_distance, mix, powers, text_slices, windows

LEAST, SHORT, MIDDLE = 4, 14, 31  # words
RUNS = ((2, 12, MIDDLE), (3, 26, None))  # words of a run, and of the texts it is used for
SAMPLED = 2
SKETCHES = 60
SIMILARITY = 0.8
LEADERS = 2
BLOCK = 256
BLOCK_WORDS = 1 << 18  # of the texts of a block, unless one text has more
SLICE_BYTES = 1 << 20  # of text sketched at once
BINS = 256  # of word counts
MOST = np.uint64(2**64 - 1)
SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
OTHER = np.uint64(0xA0761D6478BD642F)


def _sums(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each text's whole word sequence."""
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    spread = (total[first[1:]] - total[first[:-1]]) * down[first[:-1]]
    return mix(spread ^ np.diff(first).astype(np.uint64) * OTHER)


def order_sketches(hashes: np.ndarray, first: np.ndarray, n: int, sampled: int = SAMPLED, run: int = RUNS[-1][0]) -> np.ndarray:
    """n sketches of each text with `run` words or more; zeros for shorter ones."""
    counts = np.diff(first)
    out = np.zeros((len(counts), n), np.uint64)
    long_ = np.flatnonzero(counts >= run)
    if not len(long_):
        return out
    runs = windows(hashes, run)
    text = np.repeat(np.arange(len(counts)), counts)[: len(runs)]
    inside = np.arange(len(runs)) + run <= first[text + 1]
    runs, text = runs[inside], text[inside]
    begin = np.searchsorted(text, long_)
    size = np.diff(np.append(begin, len(text)))
    # Number equal runs of a text 0, 1, 2 ... in text order.
    key = mix(runs ^ mix(text.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    at = np.arange(len(key))
    number = at - at[new][np.cumsum(new) - 1]
    label = np.empty(len(key), np.uint64)
    label[order] = number.astype(np.uint64) * OTHER
    label += runs
    for s in range(n):
        values = mix(label ^ SEEDS[s])
        least, places = [], []
        for _ in range(sampled):
            low = np.minimum.reduceat(values, begin)
            hit = np.flatnonzero(values == np.repeat(low, size))
            hit = hit[np.append(True, text[hit[1:]] != text[hit[:-1]])]
            values[hit] = MOST
            least.append(low)
            places.append(hit)
        by_place = np.argsort(np.array(places), axis=0, kind="stable")
        in_order = np.take_along_axis(np.array(least), by_place, axis=0)
        sketch = np.full(len(long_), SEEDS[s])
        for row in in_order:
            sketch = mix(sketch * np.uint64(3) + row)
        out[long_, s] = sketch
    return out


def left_overs(words: np.ndarray, most: int) -> np.ndarray:
    """Keys of what is left of a text when up to `most` words are taken out."""
    kept = [np.delete(words, gone) for k in range(most + 1) for gone in combinations(range(len(words)), k)]
    return np.unique(_sums(np.concatenate(kept), np.cumsum([0, *map(len, kept)])))


def keys_of_texts(hashes: np.ndarray, first: np.ndarray, n: int, similarity: float = SIMILARITY) -> list[np.ndarray | None]:
    """The keys each text shares with its near copies; none for texts that have no other near copy."""
    counts = np.diff(first)
    out: list = [[] for _ in counts]
    for i in np.flatnonzero((counts >= LEAST) & (counts <= SHORT)).tolist():
        out[i].append(left_overs(hashes[first[i] : first[i + 1]], allowed(int(counts[i]), similarity)))
    for run, low, high in RUNS:
        fits = (counts >= low) & (counts <= (high or counts.max(initial=0)))
        if fits.any():
            which = np.flatnonzero(fits)
            inside = np.repeat(fits, counts)
            starts = np.append(0, np.cumsum(counts[which]))
            sketches = order_sketches(hashes[inside], starts, n, run=run) * OTHER + np.uint64(run)
            for i, own in zip(which.tolist(), sketches, strict=True):
                out[i].append(own)
    return [np.concatenate(keys) if keys else None for keys in out]


def _sketched(n: int, similarity: float):
    def run(batches):
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column("text"), SLICE_BYTES):
                lower = LOWER[data]
                words = Words(lower, offsets, ALNUM)
                hashes = words.hashes()
                classes = [
                    hashlib.blake2b(hashes[a:b].tobytes() or b"text" + data[c:d].tobytes(), digest_size=16).digest()
                    for a, b, c, d in zip(words.first, words.first[1:], offsets, offsets[1:], strict=False)
                ]
                keys = keys_of_texts(hashes, words.first, n, similarity)
                own = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([
                    own.column("doc_id"), own.column("text_hash"),
                    pa.array(classes, pa.binary()),
                    pa.array(words.counts.astype(np.int64)),
                    pa.array([k if k is None else k.view(np.int64) for k in keys], pa.list_(pa.int64())),
                ], ["doc_id", "text_hash", "key", "n_words", "sketches"])

    return run


def _sequences(batches):
    """Word hashes (u32) of texts."""
    for batch in batches:
        for first, end, data, offsets in text_slices(batch.column("text"), SLICE_BYTES):
            words = Words(LOWER[data], offsets, ALNUM)
            hashes = (words.hashes() >> np.uint64(32)).astype("<u4")
            view = hashes.tobytes()
            bounds = words.first.tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column("key").slice(first, end - first),
                pa.array([view[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary()),
            ], ["key", "words"])


def _aligned(similarity: float):
    def run(batches):
        for batch in batches:
            near = []
            for a, b in zip(batch.column("words").to_pylist(), batch.column("leader_words").to_pylist(), strict=True):
                a, b = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                most = allowed(max(len(a), len(b)), similarity)
                near.append(edit_distance(a.tolist(), b.tolist(), most) <= most)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("leader"), pa.array(near, pa.bool_())], ["key", "leader", "near"]
            )

    return run


def _apart(similarity: float):
    """Links between different labels within each run of rows of one block; a link that others imply is left out."""
    def links(rows: pa.Table, p: int, q: int):
        keys = rows.column("key").to_pylist()
        label = np.unique(np.array(rows.column("label").to_pylist(), object), return_inverse=True)[1]
        block = rows.column("block").to_numpy()
        words = [np.frombuffer(w, "<u4") for w in rows.column("words").to_pylist()]
        n = np.array([len(w) for w in words])
        bins = np.array([np.bincount(w % BINS, minlength=BINS) for w in words], np.int32)
        for i in range(len(n) - 1):
            j = np.arange(i + 1, len(n))
            j = j[(label[j] != label[i]) & ((p == q) | (block[j] != block[i]))]
            most = (np.maximum(n[i], n[j]) * (1 - similarity) + 1e-9).astype(np.int64)
            fits = np.abs(n[j] - n[i]) <= most
            j, most = j[fits], most[fits]
            # An edit adds one word at most and takes one away.
            more = bins[j] - bins[i]
            apart = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
            fits = np.flatnonzero(apart <= most)
            fits = fits[np.argsort(apart[fits], kind="stable")]  # the likeliest first: they spare others
            for k, limit in zip(j[fits].tolist(), most[fits].tolist(), strict=True):
                if label[k] != label[i] and edit_distance(words[i].tolist(), words[k].tolist(), limit) <= limit:
                    yield min(keys[i], keys[k]), max(keys[i], keys[k])
                    label[label == label[k]] = label[i]

    def settled(rows: pa.Table):
        found = list(links(rows, rows.column("p")[0].as_py(), rows.column("q")[0].as_py()))
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["key", "leader"]
        )

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            if not table.num_rows:
                continue
            place = np.stack([table.column(c).to_numpy() for c in ("bucket", "p", "q")])
            starts = np.append(0, np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1)
            for a, b in zip(starts, starts[1:], strict=False):
                yield settled(table.slice(a, b - a))
            held = table.slice(starts[-1])
        if held is not None and held.num_rows:
            yield settled(held)

    return run


def allowed(n_words: int, similarity: float) -> int:
    """Most edits between texts of which the longer has n words."""
    return int(n_words * (1 - similarity) + 1e-9)


def word_level(n_words: Column, similarity: float) -> Column:
    """Levels of word counts; those of near copies are the same or neighbours.  The number of levels is logarithmic."""
    step = max(-math.log(similarity), 0.001) * 1.0001  # a little wider, so that rounding parts no pair
    return F.floor(F.log(F.greatest(n_words, F.lit(1))) / step).cast("int")


def _block(level: Column, large: Column, number: Column) -> Column:
    return (level.cast("long") * 2 + large.cast("long")) * (1 << 32) + number


def components(links: DataFrame) -> DataFrame:
    """(key, label) of all nodes of links (key, leader): the least key of each component.

    Each node goes to its least neighbour, and on to where that one leads.
    Links are then taken between those ends; links within one are gone, so
    that a round has half of the nodes of the one before at most.
    """
    links = stored(links.select("key", F.col("leader").alias("other")).distinct(), "links")
    found = None
    while True:
        both = links.unionByName(links.select(F.col("other").alias("key"), F.col("key").alias("other")))
        labels = stored(both.groupBy("key").agg(F.least(F.col("key"), F.min("other")).alias("label")), "labels")
        while True:
            ahead = labels.select(F.col("key").alias("label"), F.col("label").alias("next"))
            moved = stored(labels.join(ahead, "label").select("key", F.col("label").alias("was"), F.col("next").alias("label")), "labels")
            labels = moved.select("key", "label")
            if moved.where("was <> label").isEmpty():
                break
        if found is None:
            found = labels
        else:
            ends = labels.select(F.col("key").alias("label"), F.col("label").alias("end"))
            found = stored(found.join(ends, "label", "left").select("key", F.coalesce("end", "label").alias("label")), "labels")
        sides = links.join(labels.select("key", F.col("label").alias("from")), "key").join(
            labels.select(F.col("key").alias("other"), F.col("label").alias("to")), "other"
        ).where("from <> to")
        links = stored(sides.select(F.least("from", "to").alias("key"), F.greatest("from", "to").alias("other")).distinct(), "links")
        if links.isEmpty():
            return found


def relabelled(known: DataFrame, links: DataFrame) -> DataFrame:
    """(key, label) of `known` after more links; only links between different labels are passed along."""
    sides = links.join(known.select("key", F.col("label").alias("from")), "key").join(
        known.select(F.col("key").alias("leader"), F.col("label").alias("to")), "leader"
    ).where("from <> to")
    moved = components(sides.select(F.least("from", "to").alias("key"), F.greatest("from", "to").alias("leader")).distinct())
    moved = moved.select(F.col("key").alias("label"), F.col("label").alias("moved"))
    return stored(known.join(moved, "label", "left").select("key", F.coalesce("moved", "label").alias("label")), "labels")


def pooled(left: DataFrame) -> DataFrame:
    """Buckets (bucket, key, n_words, label) of which those with much the same members are one.

    A class is at home in its largest bucket.  A bucket of which half the
    members or more are at home in one other goes into that one's pool with all
    its members, so no pair is lost.  Pools that would hold more pairs than
    their buckets together are not made.
    """
    sizes = stored(left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sized = left.join(sizes, "bucket")
    homes = sized.groupBy("key").agg(F.max(F.struct("n", "bucket")).alias("home"))
    each = left.join(stored(homes.select("key", "home.bucket"), "homes").withColumnRenamed("bucket", "home"), "key")
    most = each.groupBy("bucket", "home").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(
        F.max(F.struct("n", "home")).alias("most"), F.sum("n").alias("n")
    ).where("2 * most.n >= n")
    most = stored(most.select("bucket", F.col("most.home").alias("pool"), "n"), "pools")
    rows = left.join(most, "bucket", "left")
    pools = stored(rows.where("pool is not null").select("pool", "key", "n_words", "label").distinct(), "pooled")
    own = most.groupBy("pool").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    good = pools.groupBy("pool").agg(F.count(F.lit(1)).cast("double").alias("n")).join(own, "pool").where("n * n <= pairs")
    good = stored(good.select("pool"), "good")
    kept = rows.join(good.withColumn("made", F.lit(True)), "pool", "left").where("made is null")
    # A pool is named by a hash, as its home can stay a bucket of its own.
    named = F.xxhash64("pool", F.lit("pool")).alias("bucket")
    return kept.select(left.columns).unionByName(pools.join(good, "pool").select(named, "key", "n_words", "label"))


def sketch_documents(docs: DataFrame, n: int = SKETCHES, similarity: float = SIMILARITY) -> DataFrame:
    """Stored rows of (doc_id, text_hash, key, n_words, sketches); key stands for the words of the text."""
    return stored(_source(docs).mapInArrow(
        _sketched(n, similarity), "doc_id long, text_hash long, key binary, n_words long, sketches array<long>"
    ), "sketches")


def _source(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def near_labels(docs: DataFrame, sketched: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, label) of the classes of documents with the same words that share a key with others.

    Near copies that share a key are linked, or connected by other links;
    linked classes have the same label, the least of their keys.
    """
    classes = stored(
        sketched.where("sketches is not null").groupBy("key").agg(
            F.min(F.struct("doc_id", "text_hash")).alias("one"), F.max("n_words").alias("n_words"),
            F.first("sketches").alias("sketches"),
        ), "classes",
    )
    members = classes.select("key", F.explode("sketches").alias("bucket"))
    shared = stored(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "shared")
    known = classes.select("key", "one", "n_words")
    members = stored(members.join(shared, "bucket"), "together")
    wanted = stored(members.select("key").distinct().join(known, "key"), "wanted")
    members = stored(members.join(wanted, "key").select("bucket", "key", "one", "n_words"), "members")
    texts = _source(docs).join(
        wanted.select("key", F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash")),
        F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("text_hash") == F.col("one_hash")),
    ).select("key", "text")
    sequences = stored(texts.mapInArrow(_sequences, "key binary, words binary"), "words").dropDuplicates(["key"])
    sequences = stored(sequences, "words")

    def near(pairs: DataFrame) -> DataFrame:
        return stored(
            pairs.join(sequences, "key").join(
                sequences.select(F.col("key").alias("leader"), F.col("words").alias("leader_words")), "leader"
            ).select("key", "leader", "words", "leader_words")
            .mapInArrow(_aligned(similarity), "key binary, leader binary, near boolean").where("near").select("key", "leader"),
            "near",
        )

    def mixed_buckets(found: DataFrame) -> DataFrame:
        """Members of buckets that hold several labels."""
        rows = stored(members.join(found, "key"), "labelled")
        mixed = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        return stored(rows.join(stored(mixed.select("bucket"), "mixed"), "bucket"), "left")

    left = members.withColumn("label", F.col("key"))
    labels = wanted.select("key", F.col("key").alias("label"))
    lead = F.min(F.struct("one", "key", "n_words", "label"))
    led = None  # labels of the last leaders
    for _ in range(LEADERS):
        rest = left if led is None else left.join(led, "bucket").where("label <> led")
        leads = stored(rest.groupBy("bucket").agg(lead.alias("lead")), "leads")
        shorter, longer = F.least("n_words", "lead.n_words"), F.greatest("n_words", "lead.n_words")
        pairs = left.join(leads, "bucket").where(
            (F.col("label") != F.col("lead.label")) & (longer - shorter <= longer * (1 - similarity) + 1e-9)
        ).select("key", F.col("lead.key").alias("leader")).distinct()
        labels = relabelled(labels, near(pairs))
        left = mixed_buckets(labels)
        if left.isEmpty():
            return labels
        now = left.select("key", "label").distinct()
        led = stored(leads.select("bucket", F.col("lead.key").alias("key")).join(now, "key").select(
            "bucket", F.col("label").alias("led")
        ), "led")
    # Buckets with the same members are one; what is near has word counts in the same or in neighbouring levels.
    marks = [F.bit_xor(F.xxhash64("key")).alias("mark"), F.bit_xor(F.xxhash64("key", "key")).alias("mark2"), F.count(F.lit(1)).alias("n")]
    once = left.groupBy("bucket").agg(*marks).groupBy("mark", "mark2", "n").agg(F.min("bucket").alias("bucket")).select("bucket")
    left = stored(pooled(stored(left.join(stored(once, "once"), "bucket").select("bucket", "key", "n_words", "label"), "left")), "left")
    # The largest label of a bucket is set against the others only, never against itself.
    each = left.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("n_words"))
    most = stored(each.groupBy("bucket").agg(
        F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.sum("n_words").alias("n_words")
    ).select("bucket", F.col("most.label").alias("largest"), ((F.col("n") > BLOCK) | (F.col("n_words") > BLOCK_WORDS)).alias("split")), "largest")
    left = left.join(most, "bucket").select(
        "bucket", "key", "n_words", "label", (F.col("split") & (F.col("label") == F.col("largest"))).alias("large"),
        F.when(F.col("split"), word_level(F.col("n_words"), similarity)).otherwise(0).alias("level"),
    )
    blocks = left.groupBy("bucket", "level", "large").agg(F.least(F.count(F.lit(1)), F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_words") / BLOCK_WORDS)
    )).cast("int").alias("blocks"))
    sizes = blocks.groupBy("bucket").agg(F.collect_list(F.struct("level", "large", "blocks")).alias("sizes"))
    met = F.filter("sizes", lambda s: (F.abs(s.level - F.col("level")) <= 1) & ~(s.large & F.col("large")))
    own = F.filter("sizes", lambda s: (s.level == F.col("level")) & (s.large == F.col("large")))[0]
    dealt = left.join(stored(sizes, "sizes"), "bucket").select(
        "bucket", "key", "label",
        _block(F.col("level"), F.col("large"), F.pmod(F.xxhash64("key"), own.blocks)).alias("block"),
        F.explode(F.flatten(F.transform(met, lambda s: F.transform(
            F.sequence(F.lit(0), s.blocks - 1), lambda i: _block(s.level, s.large, i)
        )))).alias("other"),
    ).select("bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "key", "label")
    dealt = stored(dealt, "dealt").join(sequences, "key").select("bucket", "p", "q", "block", "key", "label", "words")
    apart = dealt.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInArrow(
        _apart(similarity), "key binary, leader binary"
    ).distinct()
    return relabelled(labels, stored(apart, "apart"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, class_id, group_id, group_docs, kept.

    class_id is the least id among documents with the same words, group_id
    that of the group of near copies; `kept` marks the first row of each group.
    """
    small_batches(docs.sparkSession)
    sketched = sketch_documents(docs, similarity=similarity)
    labels = near_labels(docs, sketched, similarity)
    rows = sketched.select("doc_id", "text_hash", "key", "n_words")
    labelled = rows.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    first = F.min(F.struct("doc_id", "text_hash"))
    # Written first: a join with a table can split the rows of a large group over many tasks,
    # a join with an aggregate on the same key cannot.
    classes = stored(rows.groupBy("key").agg(F.min("doc_id").alias("class_id")), "class_ids")
    groups = stored(labelled.groupBy("label").agg(first.alias("first"), F.count(F.lit(1)).alias("group_docs")), "groups")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return labelled.join(classes, "key").join(groups, "label").select(
        "doc_id", "text_hash", "n_words", "class_id", F.col("first.doc_id").alias("group_id"), "group_docs", kept.alias("kept")
    )


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs`, with all columns, that are the first of their group; equal rows stay once."""
    kept = near_duplicates(docs, similarity).where("kept").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    kept = kept.select(F.struct("doc_id", "text_hash", "copies").alias("_kept"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_hash")
    )
    found = stored(rows.join(
        kept, F.col("_id").eqNullSafe(F.col("_kept.doc_id")) & (F.col("_hash") == F.col("_kept.text_hash"))
    ).select("_row", "_kept"), "kept")
    once = found.where("_kept.copies > 1").groupBy("_kept").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return found.where("_kept.copies = 1").select("_row").unionByName(once.select("_row")).select("_row.*")
