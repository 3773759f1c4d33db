"""Registered queries: SQL where there is some, preference pairs, and the pipeline against brute force."""

import os

import pytest
from helpers import edited, prose

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, connect
from loglake.llm import decontaminate, near_dups, preferences, quality, queries

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
HERE = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not there")


def test_all_are_registered():
    names = entry.queries()
    assert [n for n in range(1, 14) if not any(k.startswith(f"op{n}_") for k in names)] == [] and "pipeline" in names
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@HERE
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    columns, sql_columns, rows, sql_rows = compare(spark, connect(FOLDER), queries.QUERIES[name], queries.ORACLES[name], FOLDER)
    assert columns == sql_columns and rows == sql_rows


@HERE
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"op12_spelling"}))
def test_one_row_or_more_per_document(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER)
    docs = {r.doc_id for r in queries.documents(spark, FOLDER).select("doc_id").collect()}
    ids = {r.doc_id for r in rows.select("doc_id").collect()}
    assert ids <= docs if name == "op3_decontaminate" else ids == docs


# -- preference pairs -----------------------------------------------------------

def test_preferences(spark):
    turns = [
        (1, 0, "system", "be kind", "x"), (1, 1, "user", "hi é", "x"), (1, 2, "assistant", "hello", "x"), (1, 3, "user", "bye", "x"),
        (0, 0, "user", "q", "x"), (0, 1, "assistant", "a", "x"), (0, 1, "assistant", "a", "x"),
        (2, 5, "user", None, "x"), (2, 6, None, "t", "x"), (4, 0, "assistant", None, "x"), (None, 0, "assistant", "lost", "x"),
    ]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, chosen string")
    got = {r.pair_id: r for r in preferences.format_pairs(preferences.swapped_pairs(table)).collect()}
    assert set(got) == {0, 1, 4}
    one = got[1]
    assert one.n_prefix == 2 and one.prompt == "<|system|>\nbe kind<|end|>\n<|user|>\nhi é<|end|>\n"
    assert one.chosen == "<|assistant|>\nhello<|end|>\n<|user|>\nbye<|end|>\n"
    assert one.rejected == "<|assistant|>\na<|end|>\n<|user|>\nbye<|end|>\n"
    assert one.chosen_mask == "m14 t13 m20" and one.rejected_mask == "m14 t9 m20"
    assert got[4].prompt == "" and got[4].chosen == "<|assistant|>\n<|end|>\n" and got[4].rejected == ""
    assert preferences.format_pairs(preferences.swapped_pairs(table.limit(0))).count() == 0


def test_equal_conversations_leave_empty_completions(spark):
    turn = "array<struct<turn:long,role:string,text:string>>"
    same = [(0, "user", "a"), (1, "assistant", "b")]
    pairs = spark.createDataFrame([(1, same, same), (2, same, same[:1]), (3, [], same)], f"pair_id long, chosen {turn}, rejected {turn}")
    got = {r.pair_id: r for r in preferences.format_pairs(pairs).collect()}
    assert (got[1].n_prefix, got[1].chosen, got[1].rejected) == (2, "", "")
    assert got[2].n_prefix == 1 and got[2].rejected == "" and got[2].chosen.startswith("<|assistant|>")
    assert got[3].n_prefix == 0 and got[3].prompt == got[3].chosen == "" and got[3].rejected


# -- pipeline -------------------------------------------------------------------

@pytest.fixture
def folder(spark, tmp_path):
    good = {i: ". ".join(" ".join(prose(i * 9 + k, 9)).capitalize() for k in range(8)) + "." for i in range(400)}
    bad = {1000 + i: " ".join(w.upper() + "!!" for w in prose(i, 20)) * 3 for i in range(80)}
    item = " ".join(prose(7777, 25))
    plants = {
        2000: " ".join(edited(good[0].split(), 1, 3)), 2001: good[1], 2002: good[2] + " " + item,
        2003: good[3] + " Password=abcdefgh12345 and so on. " + ". ".join(" ".join(prose(8000 + k, 9)).capitalize() for k in range(24)) + ".",
    }
    rows = [(d, t, "en", "s", len(t)) for d, t in {**good, **bad, **plants}.items()] + [(5000, None, None, None, None), (5001, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, 1, 0) for d in good if d % 2] + [(d, 0, 0) for d in bad if d % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), {d: t for d, t, *_ in rows}, good, bad


def test_pipeline(spark, folder):
    path, texts, good, bad = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    kept, columns = set(texts), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        rows = {r.doc_id: r for r in docs.collect()}
        if name == "quality":
            model = quality.fit_documents(spark.read.parquet(f"{path}/documents.parquet"), labels)
            scores = quality.score_documents(spark.read.parquet(f"{path}/documents.parquet"), model)
            assert set(rows) == {r.doc_id for r in scores.collect() if r.score >= 0.3}
            assert set(good) <= set(rows) and len(set(bad) & set(rows)) <= 4
            kept = set(rows)
            assert set(texts) - set(bad) - {5000, 5001} <= kept
        elif name == "near_dups":
            assert {2000, 2001} & set(rows) == set() and set(good) <= set(rows)
            groups = near_dups.near_duplicates(docs).collect()
            assert all(r.group_docs == 1 for r in groups) and set(rows) <= kept
            kept = set(rows)
        elif name == "decontamination":
            items = spark.read.parquet(f"{path}/benchmark.parquet")
            assert 2002 in kept and set(rows) == kept - {2002} and decontaminate.find_items(docs, items).count() == 0
            kept = set(rows)
        else:
            assert set(rows) == kept
            assert rows[2003].text == texts[2003].replace("abcdefgh12345", "<secret>") and rows[2003].n_chars == len(rows[2003].text)
            assert all(r.text == texts[d] for d, r in rows.items() if d != 2003)
    packed = corpus_pipeline.run(spark, path)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (
        ("documents", "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
