"""Fill-in-middle, Merkle manifest and language identification against plain Python versions."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import compare
from riskloom.llm import fim, langid, labels, merkle
from riskloom.llm.queries import QUERIES
from riskloom.llm.words import chunks

TEXTS = [
    None, "", " ", "\n\t ", "one", " one", "one ", "a b  c\n\nd e ", "é ü ß 👍🏽 日本 語", "has <P> in it", "<S>", "a <M", "<M> b", "S> x <", "a<P", "\x1c\x1d z",
    "w" * 5000 + " x", "x y " * 4000, " " * 3000 + "end", "\x0b\x0c\r", "P>", "<P<S<M a b c <",
]
DOCS = "doc_id long, text string, n long, form string, h1 long, output string, _row string, lang string, at long, part long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "f", 2, "o", "r", "l", 3, 4) for i, t in rows], DOCS).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cut_by_hand(doc, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = sha(f"{seed}:{'' if doc is None else doc}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted(x % (n + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("rate, spm, seed", [(50, 80, 42), (100, 50, 7), (100, 0, 42), (100, 100, 1), (0, 50, 42)])
def test_fill_in_middle(spark, rate, spm, seed):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[7]), (3, TEXTS[7]), (None, TEXTS[7]), (None, "p q r")]
    rows += [(1000 + i, "".join(rng.choice(["a", "bb", " ", "\n", "é", "<", "P>", "👍"]) for _ in range(rng.randrange(60)))) for i in range(200)]
    done = fim.fill_in_middle(docs_of(spark, rows), seed=seed, rate=rate, spm=spm)
    got = done.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted([(str(d), *map(str, cut_by_hand(d, t, seed, rate, spm)), t or "") for d, t in rows])
    assert sorted((str(r["doc_id"]), *(str(r[c]) for c in ("n", "form", "prefix_chars", "middle_chars", "output")), r["back"]) for r in got) == want
    assert fim.fill_in_middle(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("error", [1, 20, 120, 5000])
def test_rank_index_is_exact_and_its_lines_stay_in_bounds(error):
    rng = np.random.default_rng(3)
    for offsets in (
        np.cumsum(rng.integers(1, 12, 30_000)), np.cumsum(rng.integers(0, 2, 500) * 10_000), np.zeros(100, np.int64), np.array([5]), np.array([], np.int64),
        np.cumsum(np.where(np.arange(2000) % 7, 3, 900)),
    ):
        index = fim.RankIndex(offsets, error)
        ranks = rng.permutation(len(offsets))
        assert (index.offsets(ranks) == offsets[ranks]).all()
        assert not len(offsets) or np.abs(offsets - index.predicted(np.arange(len(offsets)))).max() <= error + 1
    smooth = fim.RankIndex(np.arange(0, 10**6, 7), error)
    assert len(smooth.starts) == 1


def test_boundaries_of_texts_side_by_side():
    texts = [t for t in TEXTS if t is not None]
    for chunk in chunks(pa.array(texts, pa.string()), most=1 << 30):
        found = fim.boundaries(chunk)
        for i, t in enumerate(texts):
            ends = np.cumsum([0] + [len(u.encode()) for u in re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)])
            own = found.offsets[found.first[i] : found.first[i] + found.units[i] + 1] - chunk.bounds[i]
            assert own.tolist() == ends.tolist()


ROWS = "doc_id long, source string, lang string, n_chars int, text string, tree string, node string, pos long, total long, top string, row string"


def tree_by_hand(nodes):
    """Root and, for each node, its siblings level by level."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    paths = []
    for p in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = p // 8 * 8
            path.append(("".join(level[run:p]), "".join(level[p + 1 : run + 8])))
            p //= 8
        paths.append(path)
    return levels[-1][0], paths


def manifest_by_hand(rows):
    written = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(written, r)))
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    trees = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), leaf((*r[:4], lower(r[4]))) if hit else leaf(r), r[0]))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    made = {n: tree_by_hand([x[2] for x in sorted(trees[n])]) for n in names}
    root, over = tree_by_hand([made[n][0] for n in names])
    out = []
    for n, high in zip(names, over):
        for x, path in zip(sorted(trees[n]), made[n][1]):
            node = x[3]
            for left, right in path + high:
                node = sha(left + node + right)
            out.append((str(x[4]), x[2], made[n][0], root, sha("".join(a + b for a, b in path + high)), node, node == root))
    return sorted(out)


def query_rows(docs):
    done = merkle.manifest(docs).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")).cast("binary"), 256).alias("proof"),
        merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded"),
    )
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof"], r["folded"], r["folded"] == r["root"]) for r in done.collect())


@pytest.mark.parametrize("deep, broadcast", [(1, 0), (2, 50_000), (3, 50_000)])
def test_merkle_manifest(spark, monkeypatch, deep, broadcast):
    monkeypatch.setattr(merkle, "DEEP", deep)
    monkeypatch.setattr(merkle, "BROADCAST", broadcast)
    rng = random.Random(2)
    pick = lambda *a: rng.choice(a)
    rows = [(i, pick("s", None, "é"), pick("en", "en", "en", "de", "é", "Z"), pick(None, 5), pick("Aa É", "plain", "", None, "B" * 3000)) for i in range(700)]
    rows += [(None, "s", "en", 1, f"T{i % 4}") for i in range(40)] + [(9, "s", None, 1, "X")] * 9 + [(70, None, None, None, None), (5, "x", "lone", 3, "Y"), (9, "s", "", 1, "Q")]
    rows += [(i, "s", "nine", 1, "A") for i in range(9)] + [(i, "s", f"l{i}", 1, "A") for i in range(80)]
    df = spark.createDataFrame([(*r, "t", "n", 0, 1, "p", "r") for r in rows], ROWS).repartition(5)
    got = query_rows(df)
    assert got == manifest_by_hand(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_merkle_manifest_of_little_and_of_nothing(spark):
    df = lambda rows: spark.createDataFrame([(*r, "t", "n", 0, 1, "p", "r") for r in rows], ROWS)
    for rows in ([(1, "a", "en", 2, "Text")], [(3, "a", "en", 2, "Text"), (4, None, None, None, None)]):
        assert query_rows(df(rows)) == manifest_by_hand(rows)
    assert query_rows(df([])) == []


def test_merkle_proofs_find_every_change(spark, sf_dir):
    con = compare.duck(sf_dir)
    changed = {i for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall() if zlib.crc32(str(i).encode()) % 3 == 0 and re.search("[A-Z]", t or "")}
    rows = QUERIES["op12_merkle_manifest"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows if not r["verified"]} == changed and len(changed) > 10


def grams_by_hand(word):
    padded = b" " + word + b" "
    codes = (int.from_bytes(padded[i : i + 3], "big") for i in range(len(word)))
    return [((c * 0x9E3779B1) % 2**32) >> 16 for c in codes]


def words_by_hand(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").lower().encode())


def mix_by_hand(likes, allowed):
    """Shares and log-likelihood; likes is a list of words' log-likelihoods by language."""
    share = {k: 1 / len(allowed) for k in allowed}
    for _ in range(langid.TURNS):
        total = dict.fromkeys(allowed, 0.0)
        for w in likes:
            top = max(w.values())
            joint = {k: share[k] * math.exp(w[k] - top) for k in allowed}
            whole = max(sum(joint.values()), 1e-300)
            for k in allowed:
                total[k] += joint[k] / whole
        share = {k: total[k] / len(likes) for k in allowed}
    value = 0.0
    for w in likes:
        top = max(w.values())
        value += top + math.log(max(sum(share[k] * math.exp(w[k] - top) for k in allowed), 1e-300))
    return share, value


def identified_by_hand(learn, texts):
    counts = defaultdict(Counter)
    for lang, text in learn:
        for w in words_by_hand(text):
            counts[lang].update(grams_by_hand(w))
    names = sorted({lang for lang, text in learn if text is not None})
    sums = {k: sum(counts[k].values()) + langid.ADDED * langid.GRAMS for k in names}
    like = lambda w: {k: sum(math.log((counts[k][g] + langid.ADDED) / sums[k]) for g in grams_by_hand(w)) for k in names}
    out = []
    for text in texts:
        if not names or not any(unicodedata.category(c).startswith("L") for c in text or ""):
            out.append(("und", 0.0, {}))
            continue
        likes = [like(w) for w in words_by_hand(text)]
        every, _ = mix_by_hand(likes, names)
        order = sorted(names, key=lambda k: -every[k])
        single = max(names, key=lambda k: sum(w[k] for w in likes))
        best, reached = {single: 1.0}, sum(w[single] for w in likes)
        for k in range(1, len(names)):
            share, value = mix_by_hand(likes, order[: k + 1])
            if value - k * 0.5 * math.log(len(likes)) <= reached:
                break
            best, reached = share, value - k * 0.5 * math.log(len(likes))
        top = max(sorted(best), key=lambda k: best[k])
        out.append((top, best[top], best))
    return out


def test_language_id_against_plain_python(spark, sf_dir):
    rows = compare.duck(sf_dir).sql("SELECT doc_id, lang, text FROM documents ORDER BY doc_id").fetchall()
    learn = [(lang, t) for i, lang, t in rows if lang is not None and zlib.crc32(str(i).encode()) % 5]
    want = dict(zip([r[0] for r in rows], identified_by_hand(learn, [t for _, _, t in rows])))
    got = QUERIES["op13_language_id"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(want) and len(got) == len(rows)
    for r in got:
        lang, score, share = want[r["doc_id"]]
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3
        assert {x["lang"] for x in r["languages"] if x["share"] > 1e-6} == {k for k, v in share.items() if v > 1e-6}


def test_language_id_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = dict(compare.duck(sf_dir).sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = QUERIES["op13_language_id"](spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(held) > 150 and sum(held) / len(held) >= 0.99


def test_languages_of_mixed_and_odd_texts(spark):
    rng = random.Random(4)
    prose = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    x, y, z = ["ka", "mo", "tu"], ["shr", "ent", "ölf"], ["ция", "ост", "при"]
    rows = [(i, prose(a, 60), name) for i, (a, name) in enumerate([(x, "xx"), (y, "yy"), (z, "zz"), (x, None)] * 30)] + [(900, None, "xx"), (901, "", "qq"), (None, "ka mo", "xx")]
    docs = spark.createDataFrame([(i, t, g, "p", 0.0) for i, t, g in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(4)
    model = langid.fit(docs, labels.fold("doc_id", 5) != 0)
    assert set(model.languages) >= {"xx", "yy", "zz"}
    texts = [
        (1, prose(x, 300) + " " + prose(y, 100)), (2, prose(z, 20_000)), (3, None), (4, ""), (5, "123 --- 4"), (6, "\n"), (7, "ka 77"), (7, "ka 77"), (None, prose(y, 9)),
        (8, prose(x, 100) + " " + prose(y, 100) + "\n" + prose(z, 200)), (9, "一"), (10, "q" * 100_000),
    ]
    got = langid.identify(docs_of(spark, texts), model).collect()
    found = defaultdict(list)
    for r in got:
        found[r["doc_id"]].append(r)
    assert len(got) == len(texts) and found[7][0] == found[7][1]
    mix = {s["lang"]: s["share"] for s in found[1][0]["languages"]}
    assert set(mix) == {"xx", "yy"} and abs(mix["xx"] - 0.75) < 0.03 and found[1][0]["lang_pred"] == "xx" and abs(found[1][0]["score"] - mix["xx"]) < 1e-9
    assert (found[2][0]["lang_pred"], [s["lang"] for s in found[2][0]["languages"]]) == ("zz", ["zz"])
    assert {s["lang"] for s in found[8][0]["languages"]} == {"xx", "yy", "zz"} and found[8][0]["lang_pred"] == "zz"
    for i in (3, 4, 5, 6):
        assert (found[i][0]["lang_pred"], found[i][0]["score"], found[i][0]["languages"]) == ("und", 0.0, [])
    assert found[None][0]["lang_pred"] == "yy" and found[9][0]["lang_pred"] in model.languages and 0 <= found[10][0]["score"] <= 1
    # One by one, the texts get the same result.
    alone = [r for i, t in texts[:2] for r in langid.identify(docs_of(spark, [(i, t)]), model).collect()]
    assert alone == [found[1][0], found[2][0]]
    nothing = langid.fit(docs.where("doc_id < 0"), F.lit(True))
    assert [r["lang_pred"] for r in langid.identify(docs_of(spark, texts[:3]), nothing).collect()] == ["und"] * 3
    assert langid.identify(docs_of(spark, []), model).count() == 0
    assert langid.fit(docs, F.lit(True), languages=2).languages == ["xx", "yy"] and len(langid.fit(docs.where("lang = 'xx'"), F.lit(True)).languages) == 1
