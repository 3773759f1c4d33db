"""Token files and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import ODD_TEXTS, edge_rows, frame, levenshtein, prose
from tokenizers import Tokenizer

from loglake.llm import near_dups, packing, repeats, token_blocks
from loglake.llm.tokens import Encoder
from loglake.llm.words import edit_distance, text_slices
from loglake.session import scratch

FILES = [public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]


def ids_of(path, text):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", FILES)
def test_pieces_give_the_ids_of_the_whole_text(path):
    rng = random.Random(4)
    signs = [" ", "  ", "\n", "\n\n", ", ", ".", "'s ", "'", " ", "\t", "é", "Ü, ", "12", "!!", " (", ")"]
    made = ["".join(rng.choice([*signs, *prose(i, 3)]) for _ in range(40)) for i in range(300)]
    texts = [t for t in ODD_TEXTS if t is None or len(t) < 5000] + made
    got = []
    for first, end, data, offsets in text_slices(pa.array(texts), 2000):
        ids, before = Encoder.of(path).ids(data, offsets)
        got += [ids[a:b].tolist() for a, b in zip(before, before[1:], strict=False)]
    assert got == [ids_of(path, t) for t in texts]


@pytest.mark.parametrize("path", FILES)
def test_ids_of_texts_with_strings_of_special_tokens(spark, path):
    tokenizer = Tokenizer.from_file(path)
    made = ["a b <|endoftext|> c", "x<|startoftext|>y, z\n<|endoftext|>", "<|endoftext|", "<|endoftext|>" * 3, "ends <|end", "oftext|> begins"]
    texts = [t or "" for t in ODD_TEXTS if t is None or len(t) < 5000] + made
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    docs = frame(spark, list(enumerate(texts)))
    got = token_blocks.encode_documents(docs, path, 2, with_ids=True, plain=True).collect()
    assert {r.doc_id: r.ids for r in got} == {i: [*ids, 2] for i, ids in want.items()}
    packed = packing.pack_documents(docs, path, 0, plain=True).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packed} == {i: [*ids, 0] for i, ids in want.items()}


def test_known_pieces_may_be_forgotten(monkeypatch):
    monkeypatch.setattr("loglake.llm.tokens.KEPT_PIECES", 5)
    encoder = Encoder(FILES[0])
    for text in ("one two three", "four five six seven eight nine ten", "one four"):
        ids, _ = encoder.ids(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == ids_of(FILES[0], text)


@pytest.mark.parametrize("percentile", [50, 90, 100])
def test_blocks_round_trip(percentile):
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 1000):
        for most in (0, 1, 300, 49407, 2**32 - 1):
            ids = np.minimum(rng.pareto(0.5, n) * 20, most).astype(np.uint32)
            shard = token_blocks.shard_bytes(ids, np.array([n]), percentile)
            got, counts = token_blocks.shard_ids(shard)
            assert got.tolist() == ids.tolist() and counts.tolist() == [n]
    with pytest.raises(ValueError):
        token_blocks.shard_ids(b"\0" * 16)


def test_token_files(spark):
    rows = edge_rows()
    path = scratch(spark, "tokens")
    token_blocks.write_tokens(frame(spark, rows), path, FILES[0], end_id=2)
    got = token_blocks.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for row, (doc_id, text) in zip(got, order, strict=True):
        ids = [*ids_of(FILES[0], text), 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc_id, at, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = token_blocks.encode_documents(frame(spark, []), FILES[0], 2)
    assert empty.count() == 0


def test_packing(spark):
    rows = edge_rows()
    packed = packing.pack_documents(frame(spark, rows), FILES[1], 0, length=64).collect()
    whole = {}
    for r in packed:
        whole.setdefault((r.doc_id, ), []).append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 <= 64
        assert r.piece == 0 or r.length == 64
    tokens = sum(len(ids_of(FILES[1], t)) + 1 for _, t in rows)
    assert sum(r.length for r in packed) == tokens
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(by_sequence) <= tokens / 64 + 2
    text = next(t for d, t in rows if d == 7)
    parts = sorted((r for r in packed if r.doc_id == 7), key=lambda r: r.piece)
    assert np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist() == [*ids_of(FILES[1], text), 0]
    assert packing.pack_documents(frame(spark, []), FILES[1], 0).count() == 0


@pytest.mark.parametrize("docs,cost", [(3, 1e9), (1000, 900.0), (2, 700.0)])
def test_every_capacity_holds(docs, cost):
    lengths = np.random.default_rng(2).integers(1, 25, 500)
    sequence, _ = packing.best_fit(lengths, 50, docs, cost)
    for s in np.unique(sequence):
        own = lengths[sequence == s]
        assert own.sum() <= 50 and len(own) <= docs and (own.astype(float) ** 2).sum() <= cost


def test_edit_distance():
    rng = random.Random(5)
    for _ in range(3000):
        a = [rng.randrange(4) for _ in range(rng.randrange(14))]
        b = [x for x in a if rng.random() < 0.8] if rng.random() < 0.5 else [rng.randrange(4) for _ in range(rng.randrange(14))]
        most = rng.randrange(10)
        assert edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_strings_with_equal_sums_of_powers(spark):
    """Sums of powers modulo 2**64 agree on these two whatever the base; ids and words must not."""
    one = thue_morse(2048)
    texts = [one, one.translate(str.maketrans("ab", "ba"))]
    for file in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(file)
        plain = Tokenizer.from_file(path)
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        ids, before = Encoder.of(path, plain=True).ids(data, np.array([0, 2048, 4096]))
        for i, text in enumerate(texts):
            assert ids[before[i] : before[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids
    rows = [(1, " ".join([texts[0], *"cdefghijklmnopqrstuvw"])), (2, " ".join([texts[1], *"cdefghijklmnopqrstuvw"]))]
    gone = repeats.remove_repeats(frame(spark, rows), with_text=False).collect()
    assert {r.doc_id: r.n_removed for r in gone} == {1: 0, 2: 21}
    letters = [(k, " ".join(t[:1024])) for k, t in enumerate(texts)]  # as words: texts of the same sums
    found = near_dups.near_duplicates(frame(spark, letters)).collect()
    assert len({r.class_id for r in found}) == 2
