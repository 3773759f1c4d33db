"""Token counts of texts by rank-synchronous merging of byte pairs.

Texts are split into pre-tokens by the pattern of the tokenizer file.  Those a
task has not met before are held together as one ragged array of symbols; each
round looks up the rank of every neighbouring pair, takes the lowest of each
sequence, and merges all places of that pair at once, from left to right.  A
sequence without a known pair is done, and the symbols left are its tokens.

Merging all places of the lowest pair at once is the same as merging them one
by one because every pair that holds a merged symbol ranks after the pair that
made it; the tables are checked for that when they are read.  A pre-token of
more than LONG bytes would need a round for each of its different pairs over
its whole length, so it is merged with a queue of its pairs instead.

Defined results: a null text counts as empty and has no tokens; strings of
added tokens inside a text stand for those tokens, one each; a null id stays
null; equal rows give equal rows; an empty table gives no rows; all other
columns of the input are left out.  Texts over SLICE characters are split
piece by piece, so that a task holds a text and a bounded number of its
pre-tokens, whatever its length.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SLICE = 1 << 20  # characters split at once
PIECES = 200_000  # pre-tokens of one long text held at once
KEPT = 500_000  # pre-tokens whose counts a process remembers, about 60 MB
KEPT_SIZE = 64  # longer pre-tokens are not remembered
BATCH = 1 << 20  # bytes merged together
LONG = 2048
NONE = np.int32(np.iinfo(np.int32).max)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if it is printable, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Merges:
    """The pair table of a byte-level tokenizer file, as arrays sorted by pair."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex", True):
            raise ValueError(f"not a byte-level pair tokenizer: {path}")
        options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        if spec["normalizer"] or split.get("add_prefix_space") or any(model.get(k) for k in options):
            raise ValueError(f"options that change texts or merges: {path}")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"added tokens that take in their surroundings: {path}")
        strings = sorted((t["content"] for t in added if t["content"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, strings))) if strings else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.tokenizer = Tokenizer.from_file(path)

        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int32)
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        born = np.full(self.size, -1, np.int64)
        born[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError(f"a pair ranks before the pair that makes its parts: {path}")
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]
        self.known: dict[str, int] = {}
        self.plain: set[str] = set()

    @staticmethod
    @cache
    def of(path: str) -> Merges:
        """One per process and file."""
        return Merges(path)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, place in the table) of pairs; rank NONE where there is no such pair."""
        keys = left.astype(np.int64) * self.size + right
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.rank[place], NONE), place

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece, all pieces merged together."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        left_over = np.zeros(len(pieces), np.int64)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        symbols = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        if not len(symbols):
            return left_over
        # Rank and table place of the pair that starts at each symbol; none at the end of a sequence.
        rank, place = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
        rank[:-1], place[:-1] = self.ranks(symbols[:-1], symbols[1:])
        rank[:-1][owner[:-1] != owner[1:]] = NONE
        while len(symbols):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            length = np.diff(np.append(first, len(symbols)))
            lowest = np.minimum.reduceat(rank, first)
            done = lowest == NONE
            if done.any():
                left_over[owner[first[done]]] = length[done]
                stay = np.repeat(~done, length)
                symbols, owner, rank, place = symbols[stay], owner[stay], rank[stay], place[stay]
                lowest, length = lowest[~done], length[~done]
            if not len(symbols):
                break
            hits = np.flatnonzero(rank == np.repeat(lowest, length))
            # In a row of overlapping places every other one is merged, from the left.
            fresh = np.append(True, np.diff(hits) != 1)
            in_row = np.arange(len(hits)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hits = hits[in_row % 2 == 0]
            symbols[hits] = self.made[place[hits]]
            stay = np.ones(len(symbols), bool)
            stay[hits + 1] = False
            # The merged symbol takes over that its right half was the last of the sequence.
            hits = hits - np.arange(len(hits))
            symbols, owner, rank, place = symbols[stay], owner[stay], rank[stay], place[stay]
            stale = np.unique(np.concatenate([hits, hits[hits > 0] - 1]))
            rank[stale] = NONE
            stale = stale[stale < len(symbols) - 1]
            stale = stale[owner[stale] == owner[stale + 1]]
            rank[stale], place[stale] = self.ranks(symbols[stale], symbols[stale + 1])
        return left_over

    def merge_long(self, piece: bytes) -> int:
        """Symbols left of one long piece: its pairs in a queue by rank and place."""
        symbols = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        table = self._table()
        queue = [(*table[pair], i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in table]
        heapq.heapify(queue)
        left = n
        while queue:
            rank, made, i = heapq.heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j >= n or table.get((symbols[i], symbols[j]), (None,))[0] != rank:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            left -= 1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (symbols[a], symbols[b]) in table:
                    heapq.heappush(queue, (*table[symbols[a], symbols[b]], a))
        return left

    @cache  # noqa: B019 - one object per process and file
    def _table(self) -> dict[tuple[int, int], tuple[int, int]]:
        parts = zip((self.keys // self.size).tolist(), (self.keys % self.size).tolist(), strict=True)
        return dict(zip(parts, zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))

    def counts(self, pieces: list[bytes]) -> list[int]:
        """Tokens of each piece, merged in batches of bounded size."""
        out = [0] * len(pieces)
        batch: list[int] = []
        size = 0
        for i, piece in enumerate(pieces):
            if len(piece) > LONG:
                out[i] = self.merge_long(piece)
                continue
            batch.append(i)
            size += len(piece)
            if size > BATCH:
                for k, n in zip(batch, self.merge([pieces[k] for k in batch]).tolist(), strict=True):
                    out[k] = n
                batch, size = [], 0
        for k, n in zip(batch, self.merge([pieces[k] for k in batch]).tolist(), strict=True):
            out[k] = n
        return out

    def total(self, lists: list[list[str]]) -> list[int]:
        """Tokens of each list of pre-tokens."""
        new = [p for p in set().union(*lists) if p not in self.known]
        long_ = {p for p in new if len(p) > KEPT_SIZE}
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = list(set().union(*lists))
        counted = dict(zip(new, self.counts([p.encode() for p in new]), strict=True))
        self.known.update((p, n) for p, n in counted.items() if p not in long_)
        if not long_:
            return [sum(map(self.known.__getitem__, pieces)) for pieces in lists]
        look = {**self.known, **counted} if len(self.known) < len(counted) else None
        if look is not None:
            return [sum(map(look.__getitem__, pieces)) for pieces in lists]
        return [sum(counted[p] if p in counted else self.known[p] for p in pieces) for pieces in lists]

    def split(self, text: str) -> Iterable[str]:
        """Pre-tokens of a text without added tokens.

        Characters that this Python's Unicode tables do not have yet can be
        letters to one pattern library and not to the other: a text with one
        is split by the tokenizer's own library.
        """
        if not text.isascii():
            new = set(text) - self.plain
            odd = {c for c in new if unicodedata.category(c) == "Cn"}
            self.plain |= new - odd
            if odd:
                found = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
                return [text[a:b] for _, (a, b) in found]
        if len(text) <= SLICE:
            return self.pattern.findall(text)
        return (m[0] for m in self.pattern.finditer(text))

    def parts(self, text: str) -> tuple[int, list[str]]:
        """(number of added tokens, texts between them)."""
        if self.added is None or not self.added.search(text):
            return 0, [text]
        between = self.added.split(text)
        return len(between) - 1, between

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, for texts that are small together."""
        n_added, lists = [], []
        for text in texts:
            n, parts = self.parts(text)
            n_added.append(n)
            lists.append([p for part in parts for p in self.split(part)])
        return [a + b for a, b in zip(n_added, self.total(lists), strict=True)]

    def count_long(self, text: str) -> int:
        n, parts = self.parts(text)
        for part in parts:
            pieces = iter(self.split(part))
            while held := list(islice(pieces, PIECES)):
                n += self.total([held])[0]
        return n


def grouped(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts that have at most SLICE characters together, or a single one."""
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > SLICE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, the UTF-8 bytes of its text, its tokens, and whether they are more than `limit`."""
    def run(batches):
        merges = Merges.of(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts: list[int] = []
            for held in grouped(texts):
                counts += [merges.count_long(held[0])] if len(held[0]) > SLICE else merges.count(held)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    source = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).cast("string").alias("text"),
    )
    counted = source.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
