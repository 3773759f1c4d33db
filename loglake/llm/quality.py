"""Quality scores learned from trusted positives and unlabelled text.

Positive-unlabelled learning: only documents marked as good are trusted; the
rest of the web is a mixture of good and bad.  With the class prior p (the
share of good documents) the risk of a classifier on the bad ones follows from
the unlabelled and the good ones.  The non-negative estimate

    p E_good[loss(g)] + max(0, E_all[loss(-g)] - p E_good[loss(-g)])

is minimised by gradient steps; where the second part falls below zero, the
step goes back up instead, which stops overfitting.  The prior is estimated
first, as the least ratio of unlabelled to good documents above a threshold of
a plain good-against-all score.  Documents fall into two halves by a hash of
their id; each half is scored with the fit on the other one, and all documents
that are not held out are counted, in bins of the score.

A score depends on the shape of the text alone: lengths, shares of character
classes, repetition of words and windows.  Each measure is spread over
piecewise linear bumps at its quantiles over all those documents (to 0.4 %),
and the model is linear in those.

The gradient steps take at most `SAMPLE` good and `SAMPLE` unlabelled documents, chosen
by a hash of their id; every document is scored.  Held-out documents are never
part of the fit.  Measures of the others are written once, 15 numbers each.

Defined results: a null text counts as empty, and empty texts are scored like
all others; documents without an id are held in (their remainder is null) but
never labelled; of repeated label rows the least quality counts; without any
trusted positive every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .words import SPACED, Words, byte_class, mix, text_slices, windows

SAMPLE = 10_000
FOLDS = 5
CUTOFF = 0.3
KNOTS = 8
STEPS = 300
RATE = 0.2
DECAY = 2e-5
BINS = 1200  # of the good-against-all score
CUT_BITS = 15  # of a float of 32 bits: values are counted to 8 binary digits

SLICE = 1 << 20  # bytes of text measured at a time

CLASSES = {
    "upper": byte_class(range(0x41, 0x5B)),
    "letters": byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B)]),
    "digits": byte_class(range(0x30, 0x3A)),
    "signs": byte_class(b"#*$%&|<>@^_~=+\\/{}[]"),
    "calls": byte_class(b"!"),
    "stops": byte_class(b".,;:?"),
    "high": byte_class(range(0x80, 0x100)),
    "lines": byte_class(b"\n"),
}
SIGN_END = byte_class(b"#*$%&|!<>")


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of measures per text of a slice."""
    words = Words(data, offsets, SPACED)
    n_texts, n = len(offsets) - 1, words.counts
    size = np.maximum(np.diff(offsets), 1)
    many = np.maximum(n, 1)
    total = {}
    for name, members in CLASSES.items():
        total[name] = np.diff(np.append(0, np.cumsum(members[data], dtype=np.int32))[offsets])
    text = np.repeat(np.arange(n_texts), n)
    hashes = words.hashes()
    salt = mix(text.astype(np.uint64))
    sign_end = np.bincount(text, SIGN_END[data[words.ends - 1]], n_texts)
    single = np.bincount(text, words.ends - words.starts == 1, n_texts)
    _, at, count = np.unique(hashes ^ salt, return_index=True, return_counts=True)
    distinct = np.bincount(text[at], minlength=n_texts)
    top = np.zeros(n_texts, np.int64)
    np.maximum.at(top, text[at], count)
    same = np.bincount(text[1:], (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1]), n_texts) if len(text) else np.zeros(n_texts)
    runs = windows(hashes, 3)
    inside = np.arange(len(runs)) + 3 <= words.first[text[: len(runs)] + 1]
    owner = text[: len(runs)][inside]
    _, at = np.unique(runs[inside] ^ salt[: len(runs)][inside], return_index=True)
    kinds = np.bincount(owner[at], minlength=n_texts)
    n_runs = np.maximum(n - 2, 1)
    columns = [
        np.log1p(n), size / many, total["upper"] / np.maximum(total["letters"], 1), total["digits"] / size,
        total["signs"] / size, total["calls"] / size, total["stops"] / size, total["high"] / size,
        total["lines"] / many, distinct / many * np.log1p(n), top / many, same / many, 1 - kinds / n_runs,
        sign_end / many, single / many,
    ]
    return np.stack(columns, axis=1).astype(np.float64)


class Model:
    """Bumps and weights; `score` gives the probability of being good."""

    def __init__(self, knots: list[np.ndarray]):
        self.knots = knots
        self.weights = np.zeros(1 + sum(map(len, knots)))

    def spread(self, x: np.ndarray) -> np.ndarray:
        columns = [np.ones((len(x), 1))]
        for j, k in enumerate(self.knots):
            v = np.clip(x[:, j], k[0], k[-1])
            if len(k) == 1:
                columns.append(np.ones((len(x), 1)))
                continue
            right = np.clip(np.searchsorted(k, v, "right"), 1, len(k) - 1)
            part = (v - k[right - 1]) / (k[right] - k[right - 1])
            bumps = np.zeros((len(x), len(k)))
            rows = np.arange(len(x))
            bumps[rows, right - 1] = 1 - part
            bumps[rows, right] += part
            columns.append(bumps)
        return np.hstack(columns)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.spread(x) @ self.weights)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(weights: np.ndarray, gradient, steps: int) -> np.ndarray:
    """Adam; the constant has no decay."""
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    keep = np.full_like(weights, DECAY)
    keep[0] = 0
    for t in range(1, steps + 1):
        g = gradient(weights) + keep * weights
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        weights = weights - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return weights


def halves_scores(good: np.ndarray, good_half: np.ndarray, all_: np.ndarray, all_half: np.ndarray, model: Model) -> list[np.ndarray]:
    """Weights of good-against-all scores for each half, fitted to the other half."""
    p, u, out = model.spread(good), model.spread(all_), []
    for half in (0, 1):
        own, other = p[good_half != half], u[all_half != half]

        def gradient(w, own=own, other=other):
            return (own.T @ (sigmoid(own @ w) - 1)) / len(own) + (other.T @ sigmoid(other @ w)) / len(other)

        known = len(own) and len(other)
        out.append(descend(np.zeros(p.shape[1]), gradient, STEPS // 2) if known else np.zeros(p.shape[1]))
    return out


def score_bins(z: np.ndarray) -> np.ndarray:
    return np.minimum((np.clip(z, -30, 30) + 30) * (BINS / 60), BINS - 1).astype(np.int64)


def class_prior(own: np.ndarray, every: np.ndarray) -> float | None:
    """Share of good documents, from the counts of trusted and of all documents by score bin; None if there are none."""
    n_own, n_all = own.sum(), every.sum()
    if not n_own or not n_all:
        return None
    at = np.flatnonzero(own)
    above = own[::-1].cumsum()[::-1][at] / n_own
    found = every[::-1].cumsum()[::-1][at] / n_all
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(n_own) + 1 / np.sqrt(n_all))
    enough = above > max(0.05, 2 * slack)
    best = int(np.argmin(np.where(enough, (found + slack) / above, np.inf)))
    return float(np.clip(found[best] / above[best], 0.05, 0.95))


def knots_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of the bumps of one measure, from its ascending values and how often each occurs."""
    total = counts.cumsum()
    at = np.minimum(np.searchsorted(total, np.linspace(0, 1, KNOTS) * total[-1]), len(values) - 1)
    return np.unique(np.concatenate([values[at], np.linspace(values[0], values[-1], 4)]))


def fit(good: np.ndarray, all_: np.ndarray, knots: list[np.ndarray] | None = None, prior: float = 0.5) -> Model:
    """Model for measures of trusted and of unlabelled documents."""
    if knots is None:
        knots = [knots_of(*np.unique(column, return_counts=True)) for column in np.vstack([good, all_]).T]
    model = Model(knots)
    model.prior = prior
    p, u = model.spread(good), model.spread(all_)

    def gradient(w):
        return risk_gradient(w, p, u, prior)

    model.weights = descend(model.weights, gradient, STEPS)
    return model


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the non-negative risk; back up the second part where that is below zero."""
    gp, gu = p @ w, u @ w
    bad = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    of_good = prior * (p.T @ (sigmoid(gp) - 1)) / len(p)
    of_bad = (u.T @ sigmoid(gu)) / len(u) - prior * (p.T @ sigmoid(gp)) / len(p)
    return of_good + of_bad if bad >= 0 else -of_bad


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def _measured(batches):
    for batch in batches:
        for first, end, data, offsets in text_slices(batch.column("text"), SLICE):
            values = measures(data, offsets)
            lists = pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], values.ravel())
            own = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("half"), lists], ["doc_id", "half", "x"])


def _matrix(batch) -> np.ndarray:
    lists = batch.column("x")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _value_counts(batches):
    """How often each value of a measure occurs, cut to few digits."""
    for batch in batches:
        if batch.num_rows:
            for j, column in enumerate(_matrix(batch).T):
                cut, n = np.unique(column.astype(np.float32).view(np.uint32) >> CUT_BITS, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), j)), pa.array(cut.astype(np.int64)), pa.array(n)], ["j", "cut", "n"])


def _bin_counts(model: Model, weights: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, half = model.spread(_matrix(batch)), batch.column("half").to_numpy()
                z = np.where(half == 0, x @ weights[0], x @ weights[1])
                at, n = np.unique(half * BINS + score_bins(z), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["at", "n"])

    return run


def sampled(measured: DataFrame, ids: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Measures and halves of the documents whose ids come first by hash; at most `sample` rows."""
    wanted = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id").distinct()
    rows = measured.join(F.broadcast(wanted), "doc_id", "left_semi").select("x", "half").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0)), np.zeros(0, int)
    x, half = np.array([r.x for r in rows], float), np.array([r.half for r in rows])
    order = np.lexsort(x.T)  # the same order in every run
    return x[order], half[order]


def fit_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on documents that are not held out; None without trusted positives."""
    doc_id = F.col("doc_id").cast("long")
    held_in = docs.where(F.coalesce(remainder(doc_id) != 0, F.lit(True))).select(
        doc_id.alias("doc_id"), F.pmod(F.xxhash64(doc_id, F.lit(1)), F.lit(2)).alias("half"), F.col("text").cast("string").alias("text")
    )
    measured = stored(held_in.mapInArrow(_measured, "doc_id long, half long, x array<double>"), "measures")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    trusted = known.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").where(remainder(F.col("doc_id")) != 0)
    good, good_half = sampled(measured, trusted.select("doc_id"), sample)
    if not len(good):
        return None
    all_, all_half = sampled(measured, measured.where("doc_id IS NOT NULL").select("doc_id"), sample)
    counts = measured.mapInArrow(_value_counts, "j long, cut long, n long").groupBy("j", "cut").agg(F.sum("n").alias("n"))
    found = np.array(sorted(counts.collect()))
    values = (found[:, 1] << CUT_BITS).astype(np.uint32).view(np.float32).astype(float)
    knots = [knots_of(values[found[:, 0] == j], found[found[:, 0] == j, 2]) for j in range(good.shape[1])]
    model = Model(knots)
    weights = halves_scores(good, good_half, all_, all_half, model)
    binned = measured.mapInArrow(_bin_counts(model, weights), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    every = np.zeros(2 * BINS, np.int64)
    for at, n in binned:
        every[at] = n
    shares = []
    for half in (0, 1):
        own = np.bincount(score_bins(model.spread(good[good_half == half]) @ weights[half]), minlength=BINS)
        mine = every[half * BINS : (half + 1) * BINS]
        shares.append((class_prior(own, mine), mine.sum()))
    shares = [(prior, n) for prior, n in shares if prior is not None]
    prior = sum(prior * n for prior, n in shares) / sum(n for _, n in shares) if shares else 0.5
    return fit(good, all_, knots, prior)


def _scores(model: Model | None, texts) -> np.ndarray:
    parts = [
        np.full(end - first, 0.5) if model is None else model.score(measures(data, offsets))
        for first, end, data, offsets in text_slices(texts, SLICE)
    ]
    return np.concatenate(parts) if parts else np.zeros(0)


def score_documents(docs: DataFrame, model: Model | None, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    def run(batches):
        for batch in batches:
            score = _scores(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= cutoff).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"), F.coalesce(remainder(doc_id) == 0, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model | None, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of `docs`, with all columns, that score at least the cutoff."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column("text")) >= cutoff))

    return docs.mapInArrow(run, docs.schema)
