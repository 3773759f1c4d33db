"""Licence notices and SPDX tags in texts.

Texts are reduced to words of [0-9a-z] and non-ASCII characters (A-Z in lower
case) joined by single spaces, and an Aho-Corasick automaton finds notice
phrases in one pass, whatever stood between their words.  Where the phrase of
an identifier tag is found, the expression after the tag is read from the text
itself: a shunting-yard parser brings it to postfix order and it is evaluated:
`and` needs every part, so the least permission counts, `or` leaves the
choice, so the greatest, and `with` adds an exception to a licence.

The score is the permission that the findings leave together: 1 for permissive
ones down to 0; texts without a finding score 0.

Defined results: a null text counts as empty; an expression that does not
parse adds no label and counts in n_bad; equal rows give equal results; an
empty table gives no rows.  All other columns of the input are left out.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and labels that every result counts.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Further notices and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
TAG_IN_TEXT = re.compile(r"SPDX-License-Identifier[^\S\r\n]*:[^\S\r\n]*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
CLOSING = re.compile(r"\s*(?:\*/|-->|#+|\*+)\s*$")

# Permission of labels, by the first that the label starts with.
PERMISSIONS = [
    ("agpl", 0.2), ("lgpl", 0.5), ("gpl", 0.3), ("mpl", 0.6), ("epl", 0.6),
    ("cc-by-nc", 0.1), ("cc-by-nd", 0.1), ("cc-by-sa", 0.5), ("cc-by", 0.9), ("reserved", 0.0),
    ("apache", 1.0), ("mit", 1.0), ("bsd", 1.0), ("isc", 1.0), ("bsl", 1.0), ("cc0", 1.0),
    ("public-domain", 1.0), ("unlicense", 1.0), ("zlib", 1.0),
]
UNKNOWN = 0.4
EXCEPTION = 0.1  # what an exception adds
BINDING = {"or": 1, "and": 2, "with": 3}

TO_WORDS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def permission(label: str) -> float:
    return next((p for start, p in PERMISSIONS if label.startswith(start)), UNKNOWN)


def postfix(expression: str) -> list[str]:
    """Licence expression in postfix order; ValueError if it is none."""
    out, waiting, operand_next, at = [], [], True, 0
    expression = expression.rstrip()
    while at < len(expression):
        found = TOKEN.match(expression, at)
        if not found:
            raise ValueError(expression)
        at, mark, name = found.end(), found[1], (found[2] or "").lower()
        if mark == "(" and operand_next:
            waiting.append(mark)
        elif mark == ")" and not operand_next:
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError(expression)
            waiting.pop()
        elif name in BINDING and not operand_next:
            while waiting and BINDING.get(waiting[-1], 0) >= BINDING[name]:
                out.append(waiting.pop())
            waiting.append(name)
            operand_next = True
        elif name and name not in BINDING and operand_next:
            out.append(name)
            operand_next = False
        else:
            raise ValueError(expression)
    if operand_next or "(" in waiting:
        raise ValueError(expression)
    return out + waiting[::-1]


def evaluate(expression: str) -> tuple[set[str], float]:
    """(licences named, permission) of an expression."""
    stack: list = []
    for name in postfix(expression):
        if name not in BINDING:
            stack.append(({name}, permission(name)))
            continue
        (right, q), (left, p) = stack.pop(), stack.pop()
        if name == "with":
            stack.append((left, min(1.0, p + EXCEPTION)))
        else:
            stack.append((left | right, min(p, q) if name == "and" else max(p, q)))
    return stack.pop()


@cache
def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase in [*BASE_PHRASES, *NOTICES, TAG]:
        made.add_word(f" {phrase} ", phrase)
    made.make_automaton()
    return made


def scan(text: str) -> dict:
    """Findings in one text."""
    words = text.encode().translate(TO_WORDS).split()
    plain = b" " + b" ".join(words) + b" "
    spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 0x20)
    first = last = None
    n_base, n_tags, n_bad = 0, 0, 0
    base, labels, scores = set(), set(), []
    for end, phrase in automaton().iter(plain.decode("latin-1")):
        if phrase == TAG:
            n_tags += 1
        elif phrase in NOTICES:
            labels.add(NOTICES[phrase])
        else:
            word = int(np.searchsorted(spaces, end - len(phrase) - 1))
            first = word if first is None else min(first, word)
            last = word if last is None else max(last, word)
            n_base += 1
            base.add(BASE_PHRASES[phrase])
    expressions = []
    if n_tags:
        for found in TAG_IN_TEXT.finditer(text):
            expression = CLOSING.sub("", found[1]).strip()
            try:
                named, score = evaluate(expression)
            except ValueError:
                n_bad += 1
                continue
            labels |= named
            scores.append(score)
            expressions.append(expression)
    # A longer notice says more than the phrase it starts with.
    notices = labels | base
    plainer = {"cc-by"} if notices & {"cc-by-nc", "cc-by-sa", "cc-by-nd"} else set()
    scores += [permission(x) for x in (notices - plainer)] if not expressions else [permission(x) for x in base - plainer]
    return {
        "n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last,
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(notices)),
        "score": min(scores, default=0.0), "expressions": expressions, "n_bad": n_bad,
    }


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, expressions array<string>, n_bad long"
)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Findings per document; see `scan`."""
    def run(batches):
        kinds = pa.schema([
            ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")),
            ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
            ("expressions", pa.list_(pa.string())), ("n_bad", pa.int64()),
        ])
        for batch in batches:
            rows = [
                {"doc_id": d, **scan(text or "")}
                for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA)
