"""Each query with check SQL against DuckDB, the others against brute force, on the smallest tables."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import compare
from riskloom.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


@pytest.fixture(scope="module")
def texts(con):
    return {d: t or "" for d, t in con.sql("SELECT doc_id, text FROM documents").fetchall()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, sf_dir, con):
    s_cols, s_rows, d_cols, d_rows = compare.compare(QUERIES[name](spark, sf_dir), ORACLES[name], con)
    assert s_cols == d_cols
    assert s_rows == d_rows and s_rows


def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_against_the_library(spark, sf_dir, texts):
    t = tokenizer("byte_bpe_50k.json")
    rows = {r["doc_id"]: r for r in QUERIES["op9_bpe_encode_decode"](spark, sf_dir).collect()}
    assert set(rows) == set(texts)
    for doc, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert rows[doc]["n_tokens"] == len(ids)
        assert rows[doc]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert rows[doc]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_packing(rows, texts, length=2048):
    """Every token of every document once, sequences gapless and full at most; returns sequences and the least possible number."""
    t = tokenizer("word_bpe_49k.json")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    total = 0
    for doc, text in texts.items():
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        total += len(ids)
        pieces = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(math.ceil(len(ids) / length)))
        for p in pieces:
            cut = ids[p["start"] : p["start"] + p["length"]]
            assert p["start"] == p["piece"] * length and p["length"] == min(length, len(ids) - p["start"])
            assert p["ids_crc32"] == zlib.crc32(cut.tobytes())
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length
    return len(by_sequence), math.ceil(total / length)


def test_packing_whole_and_tight(spark, sf_dir, texts):
    rows = QUERIES["op4_best_fit_packing"](spark, sf_dir).collect()
    sequences, least = check_packing(rows, texts)
    assert sequences <= 1.03 * least + 1


def auc(rows, y):
    pairs = [(r["score"], y[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in y]
    good, bad = ([s for s, label in pairs if label == k] for k in (1, 0))
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize(
    "name, label, parts, held, cut, least", [("op2_toxicity", "toxic", 3, 1, 0.7, 0.85), ("op10_quality_classifier", "quality", 5, 0, 0.3, 0.97)]
)
def test_held_out_accuracy(name, label, parts, held, cut, least, spark):
    """On the middle tables, as the smallest have a handful of labels of the rarer class."""
    sf_dir = "/root/testdata/sf0.01"
    y = dict(compare.duck(sf_dir).sql(f"SELECT doc_id, {label} FROM labels").fetchall())
    rows = QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut)
    assert auc(rows, y) >= least
