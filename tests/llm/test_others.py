"""Top-k, sharding, encoding, packing and classifiers on fixtures."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import bpe, labels, packing, quality, sharding, topk, toxicity
from test_op_queries import check_packing, tokenizer  # noqa: F401

VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, block string"
DOCS = "doc_id long, text string, _id string, bin string, bits string, score string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], DOCS).repartition(3)


def brute(rows, k, every=10, scale=256):
    good = {(i, tuple(int(np.floor(float(np.float32(x)) * scale)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in sorted({i for i, _ in good if i % every == 0}):
        found = []
        for i, v in good:
            for j, w in good:
                if i == q and j != q and len(v) == len(w):
                    found.append((-sum(a * b for a, b in zip(v, w)), j))
        out |= {(q, r, j, -s) for r, (s, j) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize("k, bins, candidates, queries", [(5, 1024, 4096, 256), (3, 4, 16, 3), (200, 16, 50, 8)])
def test_top_k(spark, k, bins, candidates, queries):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.4, 6))]) for i in range(120)]
    rows += [(i, rows[40][1]) for i in range(200, 260)]  # a common vector: many ties
    rows += [(None, rows[0][1]), (300, None), (310, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (320, [float("nan")] * 6), (330, [float("inf")] * 6)]
    rows += [(340, [0.5, 0.25]), (341, [0.25, 0.5]), (350, []), rows[10], rows[11]]  # other lengths, none, repeated rows
    df = spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], VECTORS).repartition(3)
    got = topk.top_k(df, F.col("id") % 10 == 0, k=k, bins=bins, candidates=candidates, queries=queries).collect()
    assert {tuple(r) for r in got} == brute(rows, k) and len(got) == len(brute(rows, k))


def test_top_k_of_large_numbers_and_nothing(spark):
    df = spark.createDataFrame([(0, [8388608.0, 1e6], 0, "", "", ""), (1, [-8388608.0, 1.0], 0, "", "", ""), (2, [1e7, 1e6], 0, "", "", "")], VECTORS)
    got = topk.top_k(df, F.col("id") == 0, k=2).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 2147483648 * 2560000000 + 256000000**2), (1, -(2147483648**2) + 256000000 * 256)]
    assert topk.top_k(df.where("vec_id > 5"), F.col("id") == 0).count() == 0


def shard_oracle(rows, limit):
    def bits(key):
        return bin(int(hashlib.md5(key.encode()).hexdigest()[:15], 16))[2:].zfill(60)

    name = lambda i: "" if i is None else str(i)
    keys = [bits(name(i)) + bits(f"{name(i)}:{t or ''}") for i, t in rows]  # of these rows, none are equal
    items = [(k, len((t or "").encode())) for k, (_, t) in zip(keys, rows)]

    def split(prefix, items):
        size = sum(b for _, b in items)
        if size <= limit or len({k for k, _ in items}) == 1:
            return {k: (prefix, size, len(items), size <= limit) for k, _ in items}
        out = {}
        for bit in "01":
            if part := [x for x in items if x[0].startswith(prefix + bit)]:
                out |= split(prefix + bit, part)
        return out

    leaves = split("", items)
    return sorted((str(i), len((t or "").encode()), *leaves[k]) for k, (i, t) in zip(keys, rows))


@pytest.mark.parametrize("limit", [10**9, 5000, 700, 40])
def test_shards(spark, limit, monkeypatch):
    monkeypatch.setattr(sharding, "STRIDE", 3)
    rng = random.Random(3)
    rows = [(i, "é" * rng.randrange(120)) for i in range(200)] + [(7, "twice"), (None, "x"), (None, "y" * 30), (900, None), (901, ""), (902, "z" * 3000)]
    got = sharding.shard_rows(docs_of(spark, rows), limit=limit).collect()
    assert sorted((str(r["doc_id"]), r["bytes"], r["shard"], r["shard_bytes"], r["shard_rows"], r["fits"]) for r in got) == shard_oracle(rows, limit)
    assert sharding.shard_rows(docs_of(spark, []), limit=limit).count() == 0


def test_shards_of_one_id_and_of_equal_rows(spark, tmp_path):
    """Null ids, repeated ids and equal rows split further, until each shard fits."""
    rows = [(None, f"null {i}" + "x" * 40) for i in range(30)] + [(7, "y" * (20 + i)) for i in range(20)] + [(8, "same text " * 4)] * 25 + [(None, None)] * 3 + [(9, "long" * 60)]
    got = sharding.shard_rows(docs_of(spark, rows), limit=100).collect()
    assert len(got) == len(rows)
    sizes, members = {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["bytes"]
        members[r["shard"]] = members.get(r["shard"], 0) + 1
    assert all((r["shard_bytes"], r["shard_rows"]) == (sizes[r["shard"]], members[r["shard"]]) for r in got)
    assert [r["bytes"] for r in got if not r["fits"]] == [240] and all(r["fits"] == (r["shard_bytes"] <= 100) for r in got)
    small = sharding.shard_rows(docs_of(spark, [(None, "z" * 50)] * 5), limit=60).collect()
    assert all(r["fits"] and r["shard_rows"] == 1 for r in small) and len({r["shard"] for r in small}) == 5
    sharding.write_shards(docs_of(spark, rows), str(tmp_path / "out"), limit=100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in back.collect()) == sorted((str(i), str(t)) for i, t in rows)


def test_written_shards(spark, tmp_path):
    rows = [(i, "word " * i) for i in range(60)]
    docs = docs_of(spark, rows)
    sharding.write_shards(docs, str(tmp_path / "out"), limit=1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == rows
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] <= 1000 or r["n"] == 1 for r in sizes)


ODD = [
    None, "", " ", "a<|endoftext|>b  <|endoftext|>", "x\x1c\x1fy \x85\xa0  z  \n\n w", "aaaaaaaaaaa aaaaaa", "日本語 émoji 👍🏽 it's we'll I'M", "﻿​́a",
    "a" * 3000 + " " + "é " * 100 + "\x00\x01", "İ ΑΣ ΑΣ. ǅ ſ ﬁ <|startoftext|>hi", "é ́e x y", "don't 'S 12345 1a2b ...!?", "tick " * 500 + "\t\v\f",
]


def test_encoding_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = list(enumerate(ODD)) + [(3, ODD[3]), (None, "x")]
    got = bpe.encode_documents(docs_of(spark, rows), path).collect()
    library = Tokenizer.from_file(path)
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows)
    assert sorted((str(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    back = bpe.decode_documents(spark.createDataFrame([(r["ids"],) for r in got] + [(None,)], "ids array<int>"), path).collect()
    assert sorted(str(r["decoded"]) for r in back) == sorted([t for _, _, t in want] + ["None"])
    assert bpe.encode_documents(docs_of(spark, []), path).count() == 0


def test_decoding_of_partial_characters():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, vocab = Tokenizer.from_file(path), bpe.vocabulary(path)
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(1, 9))]
        assert vocab.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_merging_in_any_batch():
    """The index over many pieces gives what each piece gives alone, whatever is remembered."""
    vocab = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    pieces = ["".join(rng.choice(["aa", "a", "th", "e", "in", "é", " "]) for _ in range(rng.randrange(1, 12))).encode() for _ in range(400)]
    assert vocab.merge(pieces) == [vocab.merge([p])[0] for p in pieces]
    memory = bpe.Memory(10)
    for i in range(100):
        keys = {rng.randrange(12) for _ in range(4)}
        for k in memory.absent(keys):
            memory.young[k] = k
        assert all(memory.young[k] == k for k in keys) and len(memory.young) + len(memory.old) <= 20


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_packing_of_odd_texts(spark):
    rng = random.Random(5)
    rows = list(enumerate(ODD + ["w " * n for n in (2046, 2047, 2048, 2049, 5000)] + [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(400))) for _ in range(60)]))
    out = packing.pack_documents(docs_of(spark, rows), items=20).collect()
    sequences, least = check_packing(out, dict((i, t or "") for i, t in rows))
    assert sequences <= least + 3
    assert packing.pack_documents(docs_of(spark, [])).count() == 0
    twice = packing.pack_documents(docs_of(spark, [(1, "a b"), (1, "a b"), (None, "c")]), length=8).collect()
    assert len(twice) == 3 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 3


def test_packing_of_capitals_before_marks(spark):
    """Capitals whose small letters alone compose, and the vocabulary's own marks in other cases."""
    texts = ["H\u0331", "T\u0308", "J\u030c", "W\u030a", "<|EndOfText|>", "<|endoftext|>", "A<|StartOfText|>b <|startoftext|>.", "H\u0331. Plain WORDS, caf\u00c9"]
    rng = random.Random(10)
    texts += ["".join(rng.choice("HTJWAEhtjwa  .,\u0331\u0308\u030c\u030a\u0301\u0323É") for _ in range(60)) for _ in range(200)]
    out = packing.pack_documents(docs_of(spark, list(enumerate(texts)))).collect()
    check_packing(out, dict(enumerate(texts)))


def test_best_fit():
    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.randint(1, 50) for _ in range(rng.randrange(60))]
        bins = {}
        for size, b in zip(sizes, packing.best_fit(sizes, 50)):
            bins[b] = bins.get(b, 0) + size
        assert all(v <= 50 for v in bins.values())
        assert sum(2 * v <= 50 for v in bins.values()) <= 1  # two half-empty bins would be one


def noisy(rng, word):
    i = rng.randrange(len(word))
    return word[:i] + rng.choice("xyz") + word[i + 1 :]


def test_toxicity_finds_misspellings_in_long_texts(spark):
    rng = random.Random(7)
    prose = lambda n: [rng.choice(["lo", "ra", "mi", "ten"]) + rng.choice(["ka", "su", "ne"]) for _ in range(n)]
    bad = ["vilegrub", "foulmonger", "rotbrained"]
    rows, marks = [], []
    for i in range(240):
        w = prose(rng.choice([10, 60, 300]))
        toxic = i % 3 == 0
        for _ in range(2 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        marks.append((i, None, int(toxic)))
    learn = labels.fold("id", 3) != 1
    marked = spark.createDataFrame(marks + [(None, None, 1), (500, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs_of(spark, rows + [(None, "x"), (501, None)]), marked, learn)
    unseen = [(0, " ".join(prose(3000))), (1, ""), (2, None), (3, " ".join(prose(5)))] + [
        (10 + i, " ".join([*prose(1500), noisy(rng, w), *prose(1500)])) for i, w in enumerate(bad * 2)
    ]
    score = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs_of(spark, unseen), model).collect()}
    assert all(score[i] < 0.7 for i in range(4))
    assert sum(score[i] >= 0.7 for i in score if i >= 10) >= 5, score  # of six, each of one changed letter in 3,001 words
    kept = toxicity.drop_toxic(docs_of(spark, rows), marked)
    assert kept.columns == docs_of(spark, rows).columns
    left = {r["doc_id"] for r in kept.collect()}
    assert left == {i for i, _, t in marks if not t}


def bucket_of(data, n):
    """As bags() hashes an n-gram: the mixed sum of a value for each byte and place."""
    h = sum(int(toxicity._VALUES[j][b]) for j, b in enumerate(data)) + n
    return mix(h) >> 48


def mix(h):
    h %= 2**64
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 % 2**64
    h ^= h >> 27
    h = h * 0x94D049BB133111EB % 2**64
    return h ^ (h >> 31)


def toxic_by_hand(text, scorer):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    if not words:
        return 1 / (1 + math.exp(-scorer.prior))
    found = []
    for w in words:
        w = b"<" + bytes(c + 32 if 65 <= c <= 90 else c for c in w) + b">"
        whole = mix(sum(int(toxicity._VALUES[0][c]) * (2 * i + 1) for i, c in enumerate(w))) >> 48
        found.append([bucket_of(w[i : i + n], n) for n in toxicity.SIZES for i in range(len(w) - n + 1)] + [whole])
    best = -math.inf
    for i in range(max(1, len(found) - toxicity.SPAN + 1)):
        bag = [b for grams in found[i : i + toxicity.SPAN] for b in grams]
        best = max(best, sum(float(scorer.gram[b]) for b in bag) / len(bag) + scorer.bias)
    return 1 / (1 + math.exp(-best))


def test_toxicity_scores_against_plain_python(spark, sf_dir):
    docs, marks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, marks, labels.fold("id", 3) != 1)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = list(texts.items()) + [(-1, None), (-2, ""), (-3, " \n"), (-4, "One"), (-5, "two Words"), (-6, "é ÄÖ \u2028x"), (None, "a b c d")]
    got = toxicity.score_documents(docs_of(spark, rows), model).collect()
    want = {d: toxic_by_hand(t, model) for d, t in rows}
    assert len(got) == len(rows) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-6 for r in got)


def test_where_a_phrase_stands_does_not_matter(spark):
    """Words in front of a text change no verdict on it."""
    sf_dir = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, marks, labels.fold("id", 3) != 1)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect() if len((r["text"] or "").split()) >= 3]
    score = lambda rows: {r["doc_id"]: r["score"] >= toxicity.THRESHOLD for r in toxicity.score_documents(docs_of(spark, rows), model).collect()}
    plain = score(texts)
    for n in (1, 2, 3):
        moved = score([(i, "the of and"[: 3 * n + n // 3] + " " + t) for i, t in texts])
        assert sum(moved[i] != plain[i] for i, _ in texts) == 0


def test_samples_take_long_texts_and_fill_up(spark):
    rng = random.Random(9)
    long_prose = lambda w, n: " ".join(rng.choice(w) for _ in range(n))
    clean, vile = ["lora", "kasu", "mine", "tenka"], ["vilegrub", "foulmonger"]
    rows = [(i, long_prose(clean, 12_000) + (" " + " ".join(vile * 3) if i % 2 else "")) for i in range(20)]
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    sample, counts = labels.labelled_sample(docs, marks, "toxic", F.lit(True), 1000)
    assert len(sample) == 20 and counts == {0: 10, 1: 10}
    model = toxicity.fit(docs, marks, F.lit(True))
    assert all((r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] % 2 == 1) for r in toxicity.score_documents(docs, model).collect())
    size = len(rows[0][1].encode())
    some, _ = labels.labelled_sample(docs, marks, "toxic", F.lit(True), 1000, room=3 * size + size // 2)
    assert [sum(y == k for _, y in some) for k in (0, 1)] == [3, 3]
    few, _ = labels.labelled_sample(docs_of(spark, rows + [(100 + i, "short") for i in range(4)]), marks.union(spark.createDataFrame([(100 + i, 0, 0) for i in range(4)], marks.schema)),
                                    "toxic", F.col("id") != 1, 4, longest=1000 * 1000)
    assert [sum(y == k for _, y in few) for k in (0, 1)] == [4, 4]
    with pytest.raises(ValueError, match="longer than 1000 bytes"):
        labels.labelled_sample(docs, marks, "toxic", F.lit(True), 10, longest=1000)
    # Labels without a document are none to learn from, and no error; repeated rows count once.
    nothing, _ = labels.labelled_sample(docs.where("doc_id < 0"), marks, "toxic", F.lit(True), 10, longest=1000)
    twice, _ = labels.labelled_sample(docs.union(docs), marks, "toxic", F.lit(True), 1000)
    assert nothing == [] and len(twice) == 20


def test_classifiers_without_labels_or_classes(spark):
    docs = docs_of(spark, [(1, "a b c"), (2, None), (None, "")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for operator in (toxicity, quality):
        for marks in (none, one):
            model = operator.fit(docs, marks, F.lit(True))
            scores = [r["score"] for r in operator.score_documents(docs, model).collect()]
            assert len(scores) == 3 and all(0 <= s <= 1 for s in scores)
        assert operator.score_documents(docs_of(spark, []), operator.fit(docs, one, F.lit(True))).count() == 0


def test_quality_ranks_and_cuts(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["lo", "ra", "mi", "ten"]) + rng.choice(["ka", "su", "ne"]) for _ in range(n)) + "."
    rows = [(i, prose(50) if i % 4 else " ".join(w.upper() + "!!" for w in prose(40).split())) for i in range(200)]
    marks = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 200)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs_of(spark, rows), marks, labels.fold("id", 5) != 0)
    score = {r["doc_id"]: r["score"] for r in quality.score_documents(docs_of(spark, rows), model).collect()}
    assert all((score[i] >= 0.3) == (i % 4 != 0) for i in score)


KINDS = {"_LETTER": b"abcdefghijklmnopqrstuvwxyz", "_UPPER": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "_DIGIT": b"0123456789", "_END": b".", "_COMMA": b",;:",
         "_LOUD": b"!?", "_SIGN": b"#$%&*+=~^@\\", "_BAR": b"|<>[]{}/_"}


def features_by_hand(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    kind = lambda b: next((k for k, chars in KINDS.items() if b in chars), "_WIDE" if b >= 128 else "other")
    count = {}
    for w in words:
        for b in w:
            count[kind(b)] = count.get(kind(b), 0) + 1
    n, size = max(len(words), 1), max(sum(map(len, words)), 1)
    of = lambda k: count.get(k, 0)
    share = lambda test: sum(map(bool, map(test, words))) / n
    sizes = [len(w) for w in words]
    mean = sum(sizes) / n

    def repeats(k):
        runs = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        return (len(runs) - len(set(runs))) / max(len(runs), 1)

    return [
        of("_UPPER") / max(of("_UPPER") + of("_LETTER"), 1), share(lambda w: sum(kind(b) == "_UPPER" for b in w) >= max(2, len(w) // 2)),
        *(of(k) / size for k in ("_DIGIT", "_END", "_COMMA", "_LOUD", "_SIGN", "_BAR", "other")),
        *(share(lambda w: kind(w[-1]) == k) for k in ("_LOUD", "_SIGN", "_END", "_COMMA")), share(lambda w: kind(w[0]) == "_UPPER"),
        share(lambda w: kind(w[0]) in ("_SIGN", "_BAR", "other")), mean, math.sqrt(max(sum(x * x for x in sizes) / n - mean**2, 0)),
        repeats(1), repeats(2), repeats(5), data.count(b"\n") / n, math.log1p(len(words)),
    ]


def test_quality_scores_against_plain_python(spark, sf_dir):
    docs, marks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, marks, labels.fold("id", 5) != 0)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = list(texts.items()) + [(-1, None), (-2, ""), (-3, " \n\n"), (-4, "One!! $x #TAG"), (-5, "a a a a a a a a"), (-6, "é ÄÖ \u2028x \"q\""), (None, "a\nb c d")]
    got = quality.score_documents(docs_of(spark, rows), model).collect()
    for r in got:
        x = [min(max((v - c) / s, -6), 6) for v, c, s in zip(features_by_hand(dict(rows)[r["doc_id"]]), model.centre, model.scale)]
        raw = sum(a * w for a, w in zip(x, model.weights))
        want = 1 / (1 + math.exp(-max(min(model.steep * (raw - model.cut) + math.log(quality.THRESHOLD / (1 - quality.THRESHOLD)), 700), -700)))
        assert abs(r["score"] - want) < 1e-6, (r, want)
    assert len(got) == len(rows)


def test_features_of_texts_do_not_depend_on_their_neighbours():
    import pyarrow as pa

    texts = ["Ab c!!", "", None, "x | y | z\nx | y | z", "é" * 50, " \n ", "w " * 3000, "a1 $$$ b,"]
    whole = quality.features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.features(pa.array([t], pa.string()))[0])
    assert np.isfinite(whole).all()


def test_fold_is_crc32_of_the_id(spark):
    rows = spark.range(50).select(F.col("id"), labels.fold("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_quality_learns_from_every_labelled_row(spark):
    """More rows of a class than any sample held, and texts of several MiB in all: all of them count for the cut."""
    import pyarrow as pa

    n = 5000
    rows = [(i, ("Plain words that go on and on. " if i % 2 else "BUY NOW!!! $$$ ") * (1 + i % 7)) for i in range(n)]
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    steps = quality.Steps(spark, "test-quality")
    held = quality.learned(docs, labels.label_rows(marks, "quality", F.lit(True)), steps, "doc_id", "text")
    centre, scale, n_bad, n_good = quality.scaling(held, 0.5)
    assert (n_bad, n_good) == (n // 2, n // 2) and np.allclose(centre, quality.features(pa.array([t for _, t in rows])).mean(axis=0))
    assert quality.pairs_of(held, n_bad, n_good, centre, scale, steps).count() >= n
    values = np.random.default_rng(1).normal(size=6001)
    scored = spark.createDataFrame([(0, float(v)) for v in values], "y int, s double")
    want = np.sort(values)
    at = int(np.searchsorted(np.cumsum(np.full(6001, 1 / 6001)), 0.3 - 1e-9))
    assert abs(quality.quantile(scored, (1 / 6001, 1.0), 0.3) - (want[at] + want[at + 1]) / 2) < 1e-12
    score = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, quality.fit(docs, marks, F.lit(True))).collect()}
    assert all((score[i] >= quality.THRESHOLD) == bool(i % 2) for i in range(n))
    steps.end()
