"""Words of many texts at once: positions, hashes, windows and edit distances.

The functions run inside Spark tasks on slices of an Arrow text column.  A
slice holds whole texts of a few megabytes, so the arrays made from it stay
small however large a partition is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64


def byte_class(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


# Words between white space, and words of letters, digits and non-ASCII characters.
SPACED = ~byte_class([0x20, *range(0x09, 0x0E)])
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finalizer in the manner of splitmix)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


DIGEST_OVER = 32  # bytes: sums of powers modulo 2**64 can be made equal for long strings, digests cannot


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digests of byte ranges, for the few that are long."""
    parts = [hashlib.blake2b(data[a:b].tobytes(), digest_size=8).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(parts), "<u8").astype(np.uint64)


_POWERS: dict = {}
POWER_STEP = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        size = -(-n // POWER_STEP) * POWER_STEP
        for name, base in (("up", BASE), ("down", inverse)):
            p = np.full(size, base)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def running_sums(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * up before each place and in all; made in place, 8 bytes a byte of text."""
    total = np.zeros(len(data) + 1, np.uint64)
    total[1:] = data
    total[1:] += np.uint64(1)
    total[1:] *= up[: len(data)]
    np.add.accumulate(total, out=total)
    return total


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of up to `limit` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):  # an empty column stays chunked
        texts = pa.array([], pa.string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """The words of a slice: byte ranges, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, members: np.ndarray = SPACED):
        inside = members[data]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        start[edge] = inside[edge]
        end[:-1] &= ~inside[1:]
        end[edge[edge > 0] - 1] = inside[edge[edge > 0] - 1]
        self.data = data
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        up, down = powers(len(self.data) + 1)
        total = running_sums(self.data, up)
        out = mix((total[self.ends] - total[self.starts]) * down[self.starts])
        long_ = np.flatnonzero(self.ends - self.starts > DIGEST_OVER)
        out[long_] = digests(self.data, self.starts[long_], self.ends[long_])
        return out


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; windows may cross texts, callers mask those."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(hashes) - n + 1])


def edit_distance(a, b, most: int) -> int:
    """Edit distance of two sequences, or most + 1 if it is larger.

    Banded alignment: only cells within `most` of the main diagonal can be on
    a path of that cost.  The band of one column is a machine integer, bit t
    standing for row column - most + t, and a column follows from the one
    before with a few bit operations.  The cost is followed along the diagonal
    that ends in the last cell.
    """
    a, b = list(a), list(b)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    if not b:
        return len(a)
    most = min(most, len(a))
    width = 2 * most + 1
    full = (1 << width) - 1
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    final = 1 << (len(a) - len(b) + most)
    cost = len(a) - len(b)
    up, down = ((1 << most) - 1) << (most + 1), 0  # steps of +1 and -1 from the row above
    for j, x in enumerate(b, 1):
        same = at.get(x, 0)
        shift = j - most - 1
        same = (same >> shift if shift >= 0 else same << -shift) & full
        up, down = up >> 1 | 1 << (width - 1), down >> 1
        level = ((((same & up) + up) ^ up) | same | down) & full  # no step along the diagonal
        right_up = (down | ~(level | up)) & full
        right_down = level & up
        if not level & final:
            cost += 1
            if cost > most:
                return most + 1
        right_up = (right_up << 1 | 1) & full
        right_down = right_down << 1 & full
        up = (right_down | ~(level | right_up)) & full
        down = level & right_up
    return cost


def ends_costs(text, pattern) -> list[int]:
    """For each prefix of `text`, none first: the least edit distance of `pattern` to one of its ends.

    As in `edit_distance`, with a column of the whole pattern as one machine
    integer, and free starts: no cost for what stands before.
    """
    n = len(pattern)
    at: dict = {}
    for i, x in enumerate(pattern):
        at[x] = at.get(x, 0) | 1 << i
    full, final = (1 << n) - 1, 1 << (n - 1)
    up, down, cost = full, 0, n
    out = [cost]
    for x in text:
        same = at.get(x, 0)
        level = ((((same & up) + up) ^ up) | same | down) & full
        right_up, right_down = (down | ~(level | up)) & full, level & up
        cost += bool(right_up & final) - bool(right_down & final)
        right_up, right_down = right_up << 1 & full, right_down << 1 & full
        up, down = (right_down | ~(level | right_up)) & full, level & right_up
        out.append(cost)
    return out
