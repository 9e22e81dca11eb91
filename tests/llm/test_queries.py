"""The queries of the package: against their SQL, or against plain Python over the whole table."""

import math
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from compare import SF, compare, connect
from palimpsest.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.fixture(scope="module")
def documents(db):
    return db.sql("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    problems, n, _, _ = compare(spark, db, name, QUERIES[name], ORACLES[name], SF)
    assert not problems and n


def test_op4_base_and_counts(spark, documents):
    tokens = {i: WORD.findall(lower(t)) + [None] for i, t, _ in documents}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    found = rows(spark, "op4_hmm_likelihood")
    assert set(found) == set(tokens)
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(ws), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in ws)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0


def test_op5_base(spark, documents):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    found = rows(spark, "op5_license_rules")
    assert len(found) == len(documents)
    for i, text, _ in documents:
        words = ALNUM.findall(lower(text))
        places = [(k, k + len(p.split()) - 1, label) for p, label in phrases.items() for k in range(len(words))
                  if words[k : k + len(p.split())] == p.split()]
        r = found[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["first_word"] == min((a for a, _, _ in places), default=None)
        assert r["last_word"] == max((a for a, _, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, _, x in places}))
        assert {x for _, _, x in places} <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_op6_held_out_accuracy(spark, documents):
    found = rows(spark, "op6_piece_langid")
    assert len(found) == len(documents)
    right = total = 0
    for i, text, lang in documents:
        r = found[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and lang is not None:
            right, total = right + (r["lang_pred"] == lang), total + 1
    assert total and right / total >= 0.9


def test_op7_keeps_every_token(spark, documents):
    bins, pieces = {}, {}
    for r in QUERIES["op7_variable_packing"](spark, SF).collect():
        bins.setdefault(r["bin_id"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"]))
    for members in bins.values():
        held = sum(r["n_tokens"] for r in members)
        assert {r["bin_tokens"] for r in members} == {held}
        capacity = {r["bin_capacity"] for r in members}
        assert capacity == {min(c for c in (512, 1024, 2048, 4096, 8192) if c >= held)}
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    for i, text, _ in documents:
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at
            at += n
        assert at == len(WORD.findall(text or "")) + 1


def test_pipeline_stages_keep_the_columns(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names, name
    packed = corpus_pipeline.run(spark, SF).collect()
    kept = {r["doc_id"] for r in packed}
    assert kept and kept < {i for i, _, _ in documents}
    near = rows(spark, "op10_bbit_minhash")
    assert all(near[i]["kept"] for i in kept)
    leaked = rows(spark, "op8_prefix_set_join")
    whole = rows(spark, "op3_block_anchors")
    assert not [i for i in kept if leaked[i]["contaminated"] and not whole[i]["n_removed"]]


NULLS = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "one two three four five six " * 20, None, None, 7),
         (3, "one two three four five six " * 20, "en", "a", 3), (3, "one two three four five six " * 20, "en", "a", 3),
         (4, "7" * 30000, "de", "", 1)]


@pytest.mark.parametrize("given", [NULLS, []])
def test_nulls_repeats_and_empty_tables(spark, given, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, body string, mark int, row int, bucket int"
    spark.createDataFrame([(*r, "x", 1, 2, 3) for r in given], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, query in QUERIES.items():
        if int(re.match(r"op(\d+)_", name)[1]) > 10:
            continue  # over embeddings: test_vectors.py
        assert len({r["doc_id"] for r in query(spark, str(tmp_path)).collect()}) == len({r[0] for r in given}), name
    corpus_pipeline.run(spark, str(tmp_path)).collect()
