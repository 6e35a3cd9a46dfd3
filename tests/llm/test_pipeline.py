"""The pipeline, stage by stage, against brute force."""

import corpus_pipeline
from riskloom.llm import toxicity
from riskloom.llm.common import table
from riskloom.llm.labels import fold
from test_dedup import near_oracle, passage_oracle, words
from test_op_queries import check_packing


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("id", 3) != 1)
    score = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    rows, want = rows_of(docs), []
    clean = [(i, t) for i, t in rows if score[i] < 0.7]
    want.append(clean)
    first = {}
    for i, t in sorted(clean, key=lambda r: (-len(r[1] or ""), r[0])):
        first.setdefault("".join(words(t)), i)
    one = [(i, t) for i, t in clean if i in set(first.values())]
    want.append(one)
    near = [(i, t) for (i, t), (_, _, c) in zip(one, near_oracle(one)) if c == i]
    want.append(near)
    want.append([(i, t if not gone else kept) for (i, t), (_, _, gone, kept) in zip(near, passage_oracle(near))])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "MinHash near-dedup", "substring dedup", "best-fit packing"]
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, sf_dir).write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert at.columns == docs.columns
            assert rows_of(at) == want[k]
    sequences, least = check_packing(at.collect(), {i: t or "" for i, t in want[3]})
    assert sequences <= 1.03 * least + 1
    assert 0 < len(near) < len(one) < len(rows)
    whole = corpus_pipeline.run(spark, sf_dir)
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[k] for k in keys) for r in whole.collect()) == sorted(tuple(r[k] for k in keys) for r in at.collect())


def test_empty_documents(spark, sf_dir):
    nothing = table(spark, sf_dir, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0
