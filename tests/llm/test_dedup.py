"""Exact, line, substring and near dedup on fixtures against brute force."""

import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import exact_dedup, lines, near_dedup, substrings
from riskloom.llm.words import Hashing
from riskloom.session import CLEAN_UP, Steps

SCHEMA = "doc_id long, text string, n_chars long, _id string, digest string, copy string, node string, bits string"


def table(spark, pairs):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, len(t or ""), "x", "x", "x", "x", "x") for i, t in pairs], SCHEMA).repartition(4)


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "Te", "ru", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def words(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", text or "")


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, repeats within one text, short, empty and null texts, one long text."""
    rng = random.Random(4)
    base = [prose(rng, n) for n in (3, 5, 34, 35, 36, 60, 200, 400)]
    passage = prose(rng, 50)
    out = list(base) + [None, "", "  \n\t ", "\xa0", "one", "one ", "ONE"]
    for b in base:
        out += [b, b.replace(" ", "\n", 1), b.upper()]
    for n in (1, 2, 4, 8, 12, 30):
        edited = base[6].split()
        for _ in range(n):
            edited[rng.randrange(len(edited))] = prose(rng, 1)
        out.append(" ".join(edited))
    out += [prose(rng, 20) + " " + passage + " " + prose(rng, 30) for _ in range(4)]
    out += [passage[: len(passage) // 2], passage + "\n" + passage, "tick " * 90, "tick " * 40 + "tock", prose(rng, 30_000)]
    out += ["a\nb\nc\nd\ne", "x\na\nb\nc\ny", "a\nb\nc\nd", "\n\n\n\n", "q\n\n\n", "a\nb"]
    return list(enumerate(out))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(spark, corpus):
    rows = corpus + [(3, corpus[3][1]), (3, corpus[3][1]), (None, corpus[3][1]), (None, "only")]  # wholly equal rows, null ids
    got = exact_dedup.exact_groups(table(spark, rows), slots=3).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(words(t)), []).append((-len(t or ""), i is None, i))
    assert len(got) == len(rows)
    for r in got:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(groups[key]) and r["keep_id"] == min(groups[key], key=lambda x: (x[0], x[1], x[2] or 0))[2]
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    unique = table(spark, corpus)
    kept = exact_dedup.drop_copies(unique)
    assert kept.columns == unique.columns and kept.count() == len({"".join(words(t)) for _, t in corpus})


def test_stages_drop_rows_not_ids(spark):
    rng = random.Random(11)
    t, a, b = (prose(rng, 40) for _ in range(3))
    rows = [(3, t), (3, t), (None, a), (None, b)]
    for stage in (exact_dedup.drop_copies, near_dedup.drop_near_copies):
        got = sorted((r["doc_id"] or 0, r["text"]) for r in stage(table(spark, rows)).collect())
        assert got == sorted([(3, t), (0, a), (0, b)])
        # A null id linked to a smaller id, nulls linked to each other, an id whose other row is clean.
        more = rows + [(None, t), (None, a), (1, t), (3, "clean")]
        got = sorted((r["doc_id"] or 0, r["text"]) for r in stage(table(spark, more)).collect())
        assert got == sorted([(1, t), (3, "clean"), (0, a), (0, b)])


@pytest.mark.parametrize("slots", [2, 1000])
def test_rows_keep_their_numbers_when_files_are_split_anew(spark, slots):
    """Executors that join or leave between building a result and reading it change how files are split."""
    texts = [f"text {i % 20} " + "x" * (i % 20) for i in range(200)]
    docs = table(spark, list(enumerate(texts)))
    names = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "1g", "spark.sql.files.maxPartitionBytes": "1g"}
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        groups, left = exact_dedup.exact_groups(docs, slots=slots), exact_dedup.drop_copies(docs, slots=slots)
        for n, v in {"spark.sql.files.minPartitionNum": "64", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "200"}.items():
            spark.conf.set(n, v)
        kept = sorted(r["doc_id"] for r in groups.collect() if r["kept"])
        assert kept == list(range(20))
        assert sorted(r["doc_id"] for r in left.collect()) == list(range(20))
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_misra_gries_bound():
    rng = random.Random(1)
    rows = [min(rng.randrange(60), rng.randrange(60)) for _ in range(3000)]
    counts = exact_dedup.misra_gries(rows, 9)
    assert len(counts) <= 9
    assert all(rows.count(x) - 300 <= counts.get(x, 0) <= rows.count(x) for x in set(rows))


def test_frequent_digests_are_bounded_and_found(spark):
    rows = [bytes([1])] * 500 + [bytes([2])] * 300 + [i.to_bytes(3, "big") for i in range(700)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(r,) for r in rows], "digest binary").repartition(7)
    found = {bytes(r[0]) for r in exact_dedup.frequent(df, len(rows), 10).collect()}
    assert {bytes([1]), bytes([2])} <= found and len(found) <= 11


def line_oracle(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[i] = (0, 0, None)
            continue
        parts, gone = t.split("\n"), set()
        for k in range(len(parts) - 2):
            window = tuple(parts[k : k + 3])
            if window in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(window)
        out[i] = (len(parts), len(gone), "\n".join(p for k, p in enumerate(parts) if k not in gone))
    return out


def test_lines(spark, corpus):
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_text"]) for r in lines.dedup_lines(table(spark, corpus)).collect()}
    assert got == line_oracle(corpus)
    assert lines.dedup_lines(empty(spark)).count() == 0
    twice = lines.dedup_lines(table(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (1, "a\nb\nc\nd")])).collect()
    assert sorted((r["doc_id"] is None, r["n_lines"], r["n_removed"]) for r in twice) in (
        [(False, 3, 0), (False, 3, 3), (False, 4, 3), (True, 3, 3)], [(False, 3, 3), (False, 3, 3), (False, 4, 0), (True, 3, 3)]
    )
    equal = lines.dedup_lines(table(spark, [(1, "a\nb\nc")] * 5 + [(None, "x\ny\nz")] * 4 + [(2, None)] * 2)).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in equal) == [("1", 0)] + [("1", 3)] * 4 + [("2", 0)] * 2 + [("None", 0)] + [("None", 3)] * 3


def test_lines_run_no_python(spark, corpus):
    plan = lines.dedup_lines(table(spark, corpus))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD.*Deserialize", plan)


def passage_oracle(rows, window=35):
    count = {}
    for _, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            count.setdefault(tuple(w[k : k + window]), []).append(1)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if len(count[tuple(w[k : k + window])]) > 1:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substrings(spark, corpus):
    rows = corpus + [(3, corpus[3][1]), (None, corpus[5][1]), (None, corpus[7][1])]
    got = [tuple(r) for r in substrings.removed_passages(table(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(got, key=key) == sorted(passage_oracle(rows), key=key)
    assert substrings.removed_passages(empty(spark)).count() == 0


def test_substring_stage_keeps_columns_and_clean_texts(spark, corpus):
    docs = table(spark, corpus)
    out = substrings.drop_passages(docs)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    want = {i: (t if not removed else kept) for (i, t), (_, _, removed, kept) in zip(corpus, passage_oracle(corpus))}
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.values())


def test_substring_stage_of_null_and_repeated_ids(spark):
    rng = random.Random(12)
    passage = prose(rng, 50)
    texts = [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(4)] + ["clean  one", prose(rng, 60), None]
    rows = [(None, t) for t in texts] + [(7, t) for t in texts[:1] + texts[4:]] + [(8, texts[0])]
    want = [(i or 0, (kept if gone else t) or "") for (i, t), (_, _, gone, kept) in zip(rows, passage_oracle(rows))]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in substrings.drop_passages(table(spark, rows)).collect()) == sorted(want)


def test_substrings_of_texts_with_one_crc(spark):
    """Two texts of one id that agree in the low 26 bits of their CRC-32, and windows of very many words."""
    rng, crc, pair = random.Random(13), {}, None
    base = prose(rng, 80)
    for k in range(200_000):
        t = f"{base} {prose(rng, 1) * (k % 2)} {k}" if k % 2 else f"w{k} {base[:40]}"
        other = crc.setdefault((zlib.crc32(t.encode()) & ((1 << 26) - 1)), t)
        if other != t and len(words(other)) > 40 > len(words(t)) or other != t and len(words(t)) > 40 > len(words(other)):
            pair = (other, t)
            break
    assert pair
    rows = [(None, pair[0]), (None, pair[1]), (1, base)]
    got = [tuple(r) for r in substrings.removed_passages(table(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(got, key=key) == sorted(passage_oracle(rows), key=key)
    block = prose(rng, 400)
    long = [(1, block + " " + prose(rng, 30)), (2, prose(rng, 10) + " " + block), (3, block[:600])]
    got = [tuple(r) for r in substrings.removed_passages(table(spark, long), window=150).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(got) == sorted(passage_oracle(long, 150))


def test_substrings_of_random_repeats(spark):
    """Few distinct words, so windows overlap, branch and repeat within a text."""
    rng = random.Random(9)
    blocks = [[rng.choice("abcd") for _ in range(rng.randint(5, 60))] for _ in range(8)]
    rows = [(i, " ".join(w for _ in range(rng.randint(1, 8)) for w in rng.choice(blocks))) for i in range(60)]
    got = [tuple(r) for r in substrings.removed_passages(table(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(got) == sorted(passage_oracle(rows))


def test_spans_are_compared_with_their_source(spark, monkeypatch):
    """Hashes that tell words by their length only: a lone span that isn't what its source holds must be found out."""
    def blunt(seed):
        hashing = Hashing(seed)
        if seed == substrings.SEEDS[0]:
            hashing.values[:] = 1
            hashing.powers[:] = 1
        return hashing

    rng = random.Random(21)
    lengths = [rng.randint(1, 12) for _ in range(120)]
    spelled = lambda letters, sizes: " ".join("".join(rng.choice(letters) for _ in range(n)) for n in sizes)
    whole, other = spelled("abc", lengths), spelled("xyz", lengths[:60])
    rows = [(1, whole), (2, other + " " + prose(rng, 50)), (3, prose(rng, 40) + " " + whole), (4, prose(rng, 80))]
    monkeypatch.setattr(substrings, "Hashing", blunt)
    tried = []
    once = substrings._once
    monkeypatch.setattr(substrings, "_once", lambda rows, steps, seed, *more: tried.append(seed) or once(rows, steps, seed, *more))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # the first row is the source
    got = [tuple(r) for r in substrings.removed_passages(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(got) == sorted(passage_oracle(rows))
    assert tried == list(substrings.SEEDS[:2])


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_oracle(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                comp[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    return sorted((i, len(sets[k]), min(ids[find(k)])) for k, (i, _) in enumerate(rows))


def test_near_groups(spark, corpus):
    got = near_dedup.near_groups(table(spark, corpus))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == near_oracle(corpus)
    assert near_dedup.near_groups(empty(spark)).count() == 0
    docs = table(spark, corpus)
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in near_oracle(corpus)})


def test_near_groups_of_many_edits(spark, monkeypatch):
    """A large group whose members are linked to some others only, in small blocks."""
    monkeypatch.setattr(near_dedup, "LEFT", 7)
    monkeypatch.setattr(near_dedup, "RIGHT", 20)
    rng = random.Random(5)
    base = prose(rng, 120).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(table(spark, rows)).collect())
    assert got == near_oracle(rows)


def framed(rng, n, frame, own):
    """Texts that share a frame of so many words and have so many of their own; every fiftieth has a near copy."""
    shared = prose(rng, frame)
    texts = [shared + " " + " ".join(f"{i}w{k}" for k in range(own)) for i in range(n)]
    copies = [t.rsplit(" ", 3)[0] + f" end{i}" for i, t in enumerate(texts[::50])]
    return list(enumerate(texts + copies))


@pytest.mark.parametrize("frame, own, splits", [(85, 35, True), (100, 20, None)])
def test_near_groups_in_buckets_of_one_frame(spark, monkeypatch, frame, own, splits):
    """Texts of a frame are candidates of each other and not linked; their own words tell them apart, or are too few to."""
    monkeypatch.setattr(near_dedup, "LEFT", 16)
    monkeypatch.setattr(near_dedup, "RIGHT", 32)
    rows = framed(random.Random(31), 300, frame, own)
    docs = table(spark, rows)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(docs).collect())
    assert got == near_oracle(rows)
    if splits:
        search = near_dedup._Search(docs, "doc_id", "text")
        search.join(search.verified(search.hubs()))
        largest = lambda: search.meets.groupBy("key").count().agg({"count": "max"}).first()[0]
        before = largest()
        search.split()
        assert before > 40 and (largest() or 0) <= near_dedup.RIGHT


def test_null_and_repeated_ids_of_near_copies(spark):
    rng = random.Random(6)
    a, b = prose(rng, 40), prose(rng, 40)
    rows = [(None, a), (5, a), (5, a), (None, b), (None, None), (7, ""), (8, None)]
    got = near_dedup.near_groups(table(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == sorted(
        [("None", "5", False), ("5", "5", True), ("5", "5", True), ("None", "None", True), ("None", "None", True), ("7", "7", True), ("8", "8", True)]
    )


@pytest.mark.parametrize(
    "drop, tables",
    [
        (exact_dedup.drop_copies, {"numbered", "gone"}),
        (near_dedup.drop_near_copies, {"numbered", "gone"}),
        (substrings.drop_passages, {"numbered", "100-result"}),
        (substrings.removed_passages, {"100-result"}),
    ],
)
def test_stages_leave_only_what_their_result_reads(spark, corpus, drop, tables):
    """Tables that lie in the shared folder when a stage has returned count as disk until the session ends."""
    folder = Path(Steps(spark, "probe").folder.removeprefix("file://")).parent
    held = lambda: {p for p in folder.glob("*/*") if p.is_dir()}
    docs, before = table(spark, corpus), held()
    out = drop(docs)
    assert {p.name for p in held() - before} == tables
    assert out.count() > 0


def test_steps_leave_no_shuffle_files(spark):
    """Files go when the step has ended, also if the driver collects no garbage; the setting is as it was before."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {p.name for d in disk.localDirs() for p in Path(d.getPath()).glob("*/shuffle_*")}
    setting = spark.conf.get(CLEAN_UP, "false")
    ids = spark.range(20_000).select("id", (F.col("id") % 50).alias("k"))
    steps, before = Steps(spark, "probe"), shuffled()
    kept = steps.keep(ids.join(ids.groupBy("k").agg(F.count("*").alias("n")).hint("merge"), "k"), "joined")
    end = time.time() + 20
    while (left := shuffled() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(CLEAN_UP, "false") == setting
    assert kept.where("n = 400").count() == 20_000
    steps.end()


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2500]), np.unique(x[200:])
    r = near_dedup.registers([a, b, np.unique(x)])
    assert (near_dedup.merged(r[0], r[1]) == r[2]).all()
    for size, likely in ((2500, True), (900, False)):
        c = np.unique(np.concatenate([x[:size], rng.integers(0, 2**63, 2500 - size, dtype=np.uint64)]))
        s = near_dedup.registers([a, c])
        more, same = int((s[0] > s[1]).sum()), int((s[0] == s[1]).sum())
        args = [np.array([v], dtype=float) for v in (more, near_dedup.REGISTERS - more - same, same, len(a), len(c))]
        assert bool(near_dedup.possible(*args)[0]) is likely


def test_hub_of_a_third(spark):
    """One text that a third of all rows share, edited or not."""
    rng = random.Random(8)
    hub = prose(rng, 60)
    rows = [(i, hub if i % 3 == 0 else prose(rng, 50)) for i in range(90)]
    got = near_dedup.near_groups(table(spark, rows)).groupBy("component_id").agg(F.count("*").alias("n")).orderBy(F.desc("n")).first()
    assert (got["component_id"], got["n"]) == (0, 30)
