"""Secrets in texts: keyword prefilter, anchored patterns, checksums.

An Aho-Corasick automaton looks for keywords in the lower-cased text; only
where one stands is a pattern tried, anchored there.  Long hexadecimal runs
have no keyword and are found from the byte classes of the whole slice.  Kinds
with an embedded check must pass it: tokens that end in a base-62 CRC32 of the
rest, signed web tokens whose header is JSON, key blocks that are base64.

Matches of a kind are leftmost and do not overlap; a match that fails a length
or checksum still uses up its characters.  Offsets count code points.

Defined results: a null text counts as empty; equal rows give equal results;
an empty table gives no rows.  `find_secrets` leaves out all other columns,
`mask_secrets` keeps every column and every row.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, byte_class, text_slices

HEX = byte_class(b"0123456789abcdef")
MASK = "<secret>"
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST_HEX = 32


def crc_tail(token: bytes) -> bool:
    """The last six characters are the CRC32 of what stands between the prefix and them, in base 62."""
    body, tail = token[token.index(b"_") + 1 : -6], token[-6:]
    value = 0
    for c in tail.decode():
        value = value * 62 + DIGITS62.index(c)
    return value == zlib.crc32(body)


def json_header(token: bytes) -> bool:
    head = token.split(b".")[0]
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4))), dict)
    except (ValueError, binascii.Error):
        return False


def base64_block(block: bytes) -> bool:
    body = b"".join(block.split(b"-----")[2].split())
    try:
        return len(base64.b64decode(body, validate=True)) > 0
    except binascii.Error:
        return False


# kind: keywords, pattern, group that is the secret, check.  The first three kinds are the base ones, in order.
KINDS = {
    "assign": (
        ["password", "passwd", "secret", "token", "apikey", "api_key"],
        re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE),
        2, lambda secret: len(secret) >= 8,
    ),
    "access": (["akia"], re.compile(rb"AKIA[A-Z0-9]+"), 0, lambda secret: len(secret) >= 16),
    "hex": ([], None, 0, None),
    "checked": (
        ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"],
        re.compile(rb"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), 0, crc_tail,
    ),
    "webtoken": (["eyj"], re.compile(rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 0, json_header),
    "keyblock": (
        ["-----begin "],
        re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"), 0, base64_block,
    ),
}
TOKEN_RUN = re.compile(rb"[A-Za-z0-9_-]*")
ORDER = {kind: i for i, kind in enumerate(KINDS)}
BASE = ("assign", "access", "hex")


@cache
def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for kind, (keywords, *_) in KINDS.items():
        for word in keywords:
            made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


def spans(raw: bytes, hex_runs: list[tuple[int, int]]) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) in bytes, by start and then kind."""
    out = [(a, b, "hex", a) for a, b in hex_runs]
    used: dict = {}
    hits = [(end - size + 1, kind) for end, (kind, size) in automaton().iter(raw.lower().decode("latin-1"))]
    for at, kind in sorted(hits):
        if at < used.get(kind, 0):
            continue
        _, pattern, group, valid = KINDS[kind]
        found = pattern.match(raw, at)
        if found:
            used[kind] = found.end()
            if valid(found[group]):
                out.append((at, found.end(), kind, found.start(group)))
        elif kind == "webtoken":
            # A later start within the same run of token characters fails as this one did.
            used[kind] = TOKEN_RUN.match(raw, at).end()
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def _scanned(texts):
    """(row, text bytes, spans in code points) of each text of a column; the spans' own byte places last."""
    for first, end, data, offsets in text_slices(texts):
        words = Words(data, offsets, HEX)
        long_ = np.flatnonzero(words.ends - words.starts >= LEAST_HEX)
        owner = np.searchsorted(words.first, long_, "right") - 1
        runs: dict = {}
        for k, d in zip(long_.tolist(), owner.tolist(), strict=True):
            runs.setdefault(d, []).append((int(words.starts[k] - offsets[d]), int(words.ends[k] - offsets[d])))
        for i in range(end - first):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            yield first + i, raw, spans(raw, runs.get(i, []))


def _points(raw: bytes, found: list) -> list[tuple[int, int, str]]:
    if not found or raw.isascii():
        return [(a, b, kind) for a, b, kind, _ in found]
    before = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
    return [(int(before[a]), int(before[b]), kind) for a, b, kind, _ in found]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document the number of spans of each base kind, a digest of those, and all spans as kind:start:end."""
    def run(batches):
        for batch in batches:
            names, rows = batch.column("doc_id").to_pylist(), []
            for i, raw, found in _scanned(batch.column("text")):
                texts = [(kind, f"{kind}:{a}:{b}") for a, b, kind in _points(raw, found)]
                base = ",".join(t for kind, t in texts if kind in BASE)
                counts = [sum(kind == k for kind, _ in texts) for k in BASE]
                rows.append((names[i], *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(t for _, t in texts)))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA)


def masked(raw: bytes, found: list) -> str:
    """The text with each secret replaced."""
    out, at = [], 0
    for begin, end in sorted((s, b) for _, b, _, s in found):
        if begin >= at:
            out += [raw[at:begin], MASK.encode()]
        at = max(at, end)
    return b"".join([*out, raw[at:]]).decode()


def mask_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns, with the secrets in `text` masked; `n_chars`, if there, counts the new text."""
    def run(batches):
        for batch in batches:
            column = batch.column("text")
            new = {i: masked(raw, found) for i, raw, found in _scanned(column) if found}
            if new:
                texts = column.to_pylist()
                for i, text in new.items():
                    texts[i] = text
                place = batch.schema.get_field_index("text")
                batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, column.type))
            yield batch

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        count = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
        out = out.withColumn("n_chars", count)
    return out
