"""Small tables for the tests of the llm part."""

from __future__ import annotations

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so", "ba", "ni") for b in ("ra", "den", "lux", "tor", "vi", "pan", "gos", "min", "sel")]


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed", "ing"]) for _ in range(n)]


def edited(words: list[str], seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    out = list(words)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.6:
            out[at] = "changed" + str(rng.randrange(10**6))
        elif kind < 0.8:
            del out[at]
        else:
            out.insert(at, "added" + str(rng.randrange(10**6)))
    return out


ODD_TEXTS = [
    None, "", "   ", "\n", "one", "a b", "x" * 70000, "word " * 30000,
    "tab\tand\x0bfeed\x0c\r\n end", "no-break space  and more", "é ́x ŌΣ. ΣΑ 日本 語。",
    "<|endoftext|> <|startoftext|>", "\x1c\x1d a \x85 b", "it's we'll (a) \"b\",c...!! d", "#*$%&|<> ### !!!",
]


def frame(spark, rows, extra: bool = True):
    """documents with clashing extra columns, in several partitions."""
    rows = [(d, t, "en", "s", len(t) if t is not None else None, 0.5, "x", True, 7) for d, t in rows]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, "
        "score double, bucket string, kept boolean, _row int"
    )
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def edge_rows():
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    return rows + [(3, "\n"), (3, "another text of the same id"), (None, "no id"), (None, None), (2, "   ")]


def levenshtein(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]
