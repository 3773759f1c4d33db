"""Token counts, spelling variants and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD_TEXTS, edge_rows, frame, levenshtein, prose
from tokenizers import Tokenizer

from loglake.llm import periods, queries, spelling, token_counts

BYTES_50K = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile("[A-Za-zÀ-ÿ]+")


def mixed(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    letters = ["a", "b", "the", " ", " ", "\n", "\t", "'s", "é", "日", "՘", "\U000187f8", "1", "٣", "!", "\x1c", "\x85",
               "　", "<|endoftext|>", "\U0001f600", "aa", "'ll", "...", "​"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]


# -- token counts -----------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES_50K)


def test_counts_are_those_of_the_library(spark, library):
    texts = [*ODD_TEXTS, *mixed(1, 400), "a" * 3000, "ab" * 1500, "=-" * 900, "a1" * 800_000]
    rows = [*enumerate(texts), (3, "\n"), (None, "no id"), (None, None)]
    got = token_counts.count_tokens(frame(spark, rows), BYTES_50K, 1024)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = []
    for name, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((name, len((text or "").encode()), n, n > 1024))
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert token_counts.count_tokens(frame(spark, rows).limit(0), BYTES_50K, 9).count() == 0


def test_long_pre_tokens_with_a_queue_and_in_rounds(library):
    merges = token_counts.Merges.of(BYTES_50K)
    rng = random.Random(3)
    for letters in ("ab", "aab", "etaoinshr", "=-", " \n", "日本"):
        piece = "".join(rng.choice(letters) for _ in range(1500)).encode()
        assert merges.merge_long(piece) == merges.merge([piece, b"x", b"", piece])[3] == merges.merge([piece])[0]


def test_known_pieces_are_forgotten(monkeypatch, library):
    merges = token_counts.Merges(BYTES_50K)
    monkeypatch.setattr(token_counts, "KEPT", 50)
    texts = [" ".join(prose(i, 60)) for i in range(20)]
    assert [merges.count([t])[0] for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(merges.known) <= 200


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        token_counts.Merges(public_tokenizers.path("word_bpe_49k.json"))


# -- spelling variants ------------------------------------------------------------

def brute_spelling(rows) -> set:
    counts: Counter = Counter()
    for name, text in rows:
        for found in WORD.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in found)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and levenshtein(v, w) == 1] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def spelling_rows():
    rng = random.Random(8)
    base = ["information", "Informations", "señaladó", "straßeñas", "letterbox", "chattering", "abcdefg", "aaaaaaa", "aaaaaaaa", "bacdefg", "×÷éàüßöë"]
    rows = []
    for i in range(120):
        out = []
        for _ in range(40):
            word = rng.choice(base[: 1 + rng.randrange(len(base))])
            if rng.random() < 0.2:
                at = rng.randrange(len(word))
                word = word[:at] + rng.choice(["", "x", word[at] * 2, "é"]) + word[at + 1 :]
            out.append(word)
        rows.append((i - 3, rng.choice([" ", "-", "日", "1"]).join(out)))
    return rows + edge_rows() + [(7, "verylongword" * 40 + " " + "verylongword" * 39 + "verylongwor")] * 2


@pytest.mark.parametrize("block", [4096, 6])
def test_spelling(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "PART", 300)
    rows = spelling_rows()
    got = spelling.group_variants(frame(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = list(map(tuple, got.collect()))
    assert len(found) == len(set(found)) and set(found) == brute_spelling(rows)
    assert spelling.group_variants(frame(spark, rows).limit(0)).count() == 0


def test_chains_of_forms(spark):
    counts = {"abcdefgh": 2, "abcdefgi": 20, "abcdefji": 200, "abcdekji": 2000, "abcdlkji": 20000}
    links = spark.createDataFrame([(a, b) for a, b in zip(counts, list(counts)[1:], strict=False)], "word string, form string")
    assert {r.root for r in spelling.roots(links).collect()} == {"abcdlkji"}


# -- periodic runs ----------------------------------------------------------------

def smallest_period(words) -> int:
    return next(r for r in range(1, len(words) + 1) if all(words[k] == words[k + r] for k in range(len(words) - r)))


def brute_runs(words) -> list:
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q) and j > i and smallest_period(words[i : j + q]) == q:
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out)


def brute_document(name, text) -> tuple:
    words = (text or "").encode().split()
    n, h = len(words), None if name is None else zlib.crc32(str(name).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    return (
        name, len(runs), *best, best[1] * 1000 // best[2] if best[1] else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def period_rows():
    rng = random.Random(4)
    rows = [(i, t) for i, t in edge_rows() if t is None or len(t) < 20_000]
    for i in range(150):
        k, n = rng.choice([1, 2, 3, 30]), rng.randrange(rng.choice([12, 60, 250]))
        words = [f"w{rng.randrange(k)}" for _ in range(n)]
        if rng.random() < 0.4 and n:
            a, p = rng.randrange(n), 1 + rng.randrange(40)
            words = words[:a] + [words[a + (x - a) % p] for x in range(a, n)]
        rows.append((i - 20, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


@pytest.mark.parametrize(("long_words", "span"), [(1 << 14, 1 << 13), (40, 16), (100, 64)])
def test_runs(spark, long_words, span):
    rows = period_rows()
    got = periods.find_runs(frame(spark, rows), with_text=False, plain=False, long_words=long_words, span=span)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_document(d, t) for d, t in rows)


def test_runs_of_an_empty_table_and_a_long_text(spark):
    assert periods.find_runs(frame(spark, edge_rows()).limit(0)).count() == 0
    row = periods.find_runs(frame(spark, [(1, "again " * 50_000 + "and so on"), (2, "x y")])).where("doc_id = 1").collect()
    assert [(r.n_runs, r.start, r.length, r.period) for r in row] == [(1, 0, 50_000, 1)]
    text = periods.find_runs(frame(spark, [(1, "again " * 500 + "and so on")])).first().collapsed
    assert text == "again and so on"


def test_z_function():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periods.z_function(s)[1:] == want[1:]
    assert [b.tolist() for b in [periods.promising(np.arange(40), *periods.FIRST[:3])]] == [[]]


def test_registered():
    assert {"op11_token_counts", "op12_spelling", "op13_periods"} <= set(queries.QUERIES)
