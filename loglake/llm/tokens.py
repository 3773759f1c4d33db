"""Token ids of many texts: only words not seen before go through the tokenizer.

A text is cut at places where the tokenizer's own pre-split always cuts:
before white space that follows other text, after a single line feed, and between an
ASCII letter or digit and ASCII punctuation.  The ids of a text are then the
ids of its pieces, and equal pieces are encoded once per task process.
"""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

from .words import DIGEST_OVER, byte_class, digests, mix, powers, running_sums

SPACE = byte_class([0x20, *range(0x09, 0x0E)])
ASCII_WORD = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
ASCII_SIGN = byte_class([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
LEARNED = 4096  # pieces encoded at once; the tokenizer's own results take much more than ids
KEPT_PIECES = 2_000_000  # pieces a process remembers: about 60 MB


class Encoder:
    """Ids of slices of texts for one tokenizer file.

    With `plain`, ids are those of the tokenizer as it comes from its file: the
    strings of special tokens stand for those tokens.  Without it they are
    ordinary text.  A text with the string of a token that the tokenizer takes
    out before its pre-split is encoded whole.  White space other than
    ASCII's, and the separators 0x1C-0x1F, can join a run of white space that
    the cuts would split: a text with one of them is encoded whole.
    """

    _made: dict = {}

    def __init__(self, path: str, plain: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not plain
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.strings = [t.content.encode() for t in added if t.content and (plain or not t.special)]
        self._forget()

    def _forget(self) -> None:
        """Known pieces: sorted keys, and where in `flat` the ids of each stand."""
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.uint32)
        self.size = np.zeros(0, np.uint32)
        self.flat = np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str, plain: bool = False) -> Encoder:
        """One per process, file and kind."""
        if (path, plain) not in cls._made:
            cls._made[path, plain] = cls(path, plain)
        return cls._made[path, plain]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encode pieces not known yet; their keys are sorted."""
        encoded = [
            e.ids for k in range(0, len(pieces), LEARNED)
            for e in self.tokenizer.encode_batch_fast(pieces[k : k + LEARNED], add_special_tokens=False)
        ]
        size = np.fromiter(map(len, encoded), np.uint32, len(encoded))
        first = np.cumsum(size, dtype=np.uint32) - size + np.uint32(len(self.flat))
        new = np.fromiter((i for ids in encoded for i in ids), np.uint32, int(size.sum()))
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.first = np.insert(self.first, place, first)
        self.size = np.insert(self.size, place, size)
        self.flat = np.concatenate([self.flat, new])

    def _known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of keys among the known ones, whether they are there)."""
        place = np.searchsorted(self.keys, keys)
        there = place < len(self.keys)
        there[there] = self.keys[place[there]] == keys[there]
        return place, there

    def _with_strings(self, view: bytes, offsets: np.ndarray) -> list[int]:
        """Texts with the string of an added token."""
        hits = []
        for string in self.strings:
            at = view.find(string)
            while at >= 0:
                hits.append(at)
                at = view.find(string, at + 1)
        return np.unique(np.searchsorted(offsets, np.array(hits, np.int64), "right") - 1).tolist()

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids before each text and in all) of a slice."""
        n_texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_texts + 1, np.int64)
        space, word = SPACE[data], ASCII_WORD[data]
        cut = np.zeros(len(data), bool)
        # A line feed that ends a longer run of white space is split off by look-ahead alone.
        longer = np.append(False, space[:-2])[: len(data) - 1]
        cut[1:] = (space[1:] & ~space[:-1]) | (word[:-1] & ASCII_SIGN[data[1:]]) | (
            (data[:-1] == 0x0A) & ~space[1:] & ~longer
        )
        view = data.tobytes()
        for i in {*odd_texts(data, offsets).tolist(), *self._with_strings(view, offsets)}:
            cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        up, down = powers(len(data) + 1)
        total = running_sums(data, up)
        keys = mix((total[ends] - total[starts]) * down[starts])
        del total
        long_ = np.flatnonzero(ends - starts > DIGEST_OVER)
        keys[long_] = digests(data, starts[long_], ends[long_])
        unique, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        place, there = self._known(unique)
        if not there.all():
            new = np.flatnonzero(~there)
            if len(self.keys) + len(new) > KEPT_PIECES:
                self._forget()
                new = np.arange(len(unique))
            self._learn(unique[new], [view[starts[k] : ends[k]].decode() for k in at[new].tolist()])
            place, there = self._known(unique)
        first, sizes = self.first[place].astype(np.int64), self.size[place].astype(np.int64)
        size = sizes[inverse]
        done = np.cumsum(size)
        take = np.arange(done[-1]) + np.repeat(first[inverse] - (done - size), size)
        before = np.append(0, done)
        return self.flat[take], before[np.searchsorted(starts, offsets)]


def odd_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with white space beyond 0x09-0x0D and 0x20."""
    hit = (data >= 0x1C) & (data <= 0x1F)
    high = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(high):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = padded[high], padded[high + 1], padded[high + 2]
        blank = (
            ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)))
            | ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
            | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
            | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
            | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        )
        hit[high[blank]] = True
    return np.unique(np.searchsorted(offsets, np.flatnonzero(hit), "right") - 1)
