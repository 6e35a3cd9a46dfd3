"""One query for each operator over its whole table, and check SQL where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, exact_dedup, fim, langid, lines, merkle, near_dedup, packing, quality, sharding, substrings, topk, toxicity
from riskloom.llm.common import table
from riskloom.llm.labels import fold

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)
    return found.withColumn("rank", F.col("rank").cast("int"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("kept_text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


#: Bytes of text a shard may hold.
SHARD_BYTES = 4 * 1024 * 1024

OP1_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), e AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER g AS keep_id, row_number() OVER g AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM w
"""

OP6_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, generate_subscripts(lines, 1) - 1 AS pos, unnest(lines) AS line FROM l),
w AS (
  SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS win
  FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos FROM w WHERE win IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1
), gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS t(k)),
kept AS (
  SELECT e.doc_id, count(g.pos) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY e.pos) FILTER (g.pos IS NULL), '') AS text
  FROM e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

# The test tables need far fewer than 24 bits; the SQL looks at those.
OP7_SQL = f"""
WITH r AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes, CAST(coalesce(CAST(doc_id AS VARCHAR), '') AS VARCHAR) AS k FROM documents
), b AS (
  SELECT doc_id, bytes, list_aggregate(list_transform(range(1, 7), lambda i:
    lpad(bin(instr('0123456789abcdef', md5(k)[i]) - 1), 4, '0')), 'string_agg', '') AS bits FROM r
), n AS (
  SELECT d.depth, b.bits[1:d.depth] AS shard, sum(bytes) AS shard_bytes, count(*) AS shard_rows
  FROM b, (SELECT unnest(range(0, 25)) AS depth) d GROUP BY 1, 2
), t AS (
  SELECT b.doc_id, b.bytes, n.shard, n.shard_bytes, n.shard_rows
  FROM b JOIN n ON b.bits[1:n.depth] = n.shard WHERE n.shard_bytes <= {SHARD_BYTES} OR n.shard_rows = 1
  QUALIFY row_number() OVER (PARTITION BY b.doc_id ORDER BY n.depth) = 1
)
SELECT doc_id, bytes, shard, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows, shard_bytes <= {SHARD_BYTES} AS fits FROM t
"""

for _query, _sql in ((op1_top_k, OP1_SQL), (op5_exact_dedup, OP5_SQL), (op6_line_dedup, OP6_SQL), (op7_sharding, OP7_SQL)):
    QUERIES[_query.__name__] = _query
    ORACLES[_query.__name__] = _sql


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g,
         CASE WHEN len(w) < 5 THEN len(w) ELSE 5 END AS k
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n ON c.doc_id = n.doc_id
"""
QUERIES[op8_minhash_near_dedup.__name__] = op8_minhash_near_dedup
ORACLES[op8_minhash_near_dedup.__name__] = OP8_SQL


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256")
    return substrings.removed_passages(
        table(spark, sf_dir, "documents"), result=lambda d: d.select("doc_id", "n_words", "n_removed", digest, "digests", "sources")
    )


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 33)) AS pos, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h
  FROM w WHERE len(w) >= 35
), again AS (SELECT doc_id, pos FROM g QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM again, (SELECT unnest(range(0, 35)) AS k)),
e AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM w),
k AS (
  SELECT e.doc_id, count(*) AS n, count(g.pos) AS r, string_agg(word, ' ' ORDER BY e.pos) FILTER (g.pos IS NULL) AS t
  FROM e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_words, CAST(coalesce(k.r, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
QUERIES[op3_substring_dedup.__name__] = op3_substring_dedup
ORACLES[op3_substring_dedup.__name__] = OP3_SQL


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False, digests=True)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


# Tokenizers are beyond SQL; tests/llm hold both against the tokenizers library.
for _query in (op9_bpe_encode_decode, op4_best_fit_packing):
    QUERIES[_query.__name__] = _query


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("id", 3) != 1)
    return toxicity.score_documents(docs, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold("id", 5) != 0)
    return quality.score_documents(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


# Trained models are beyond SQL; tests/llm measure both on held-out rows.
for _query in (op2_toxicity, op10_quality_classifier):
    QUERIES[_query.__name__] = _query


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), c AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || h[i:i + 7] AS BIGINT)) AS d FROM u
), k AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 50 THEN 'plain'
              WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM c
), p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS y, coalesce(array_to_string(u[b + 1:n], ''), '') AS z FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.manifest(table(spark, sf_dir, "documents"))
    done = made.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = f"""
WITH RECURSIVE b AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         -- CRC-32 bit by bit: a number is a byte to mix in, -1 a shift.
         xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [ord(x), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS crc
  FROM documents
), d AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' || CASE WHEN crc % 3 = 0 THEN translate(text, '{merkle.UPPER}', '{merkle.LOWER}') ELSE text END, '-')) AS bad
  FROM b
), r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS total FROM d),
n AS (
  SELECT tree, 0 AS lvl, pos, leaf AS h, total FROM r
  UNION ALL
  SELECT tree, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(total) + 7) // 8 FROM n WHERE total > 1 GROUP BY tree, lvl, pos // 8
), s AS (SELECT tree, h AS subroot, lvl AS height, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS total FROM n WHERE total = 1),
m AS (
  SELECT 0 AS lvl, place AS pos, subroot AS h, total FROM s
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(total) + 7) // 8 FROM m WHERE total > 1 GROUP BY lvl, pos // 8
), a AS (SELECT tree, lvl, pos, h, total FROM n UNION ALL SELECT NULL, lvl, pos, h, total FROM m),
f AS (
  SELECT tree, lvl, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM a WHERE total > 1 WINDOW w AS (PARTITION BY tree, lvl, pos // 8 ORDER BY pos)
), g AS (
  SELECT doc_id, leaf, tree, 0 AS lvl, pos, bad AS node, '' AS proof FROM r
  UNION ALL
  SELECT doc_id, leaf, g.tree, g.lvl + 1, g.pos // 8, sha256(f.l || node || f.r), proof || f.l || f.r
  FROM g JOIN f ON g.tree = f.tree AND g.lvl = f.lvl AND g.pos = f.pos
), e AS (
  SELECT doc_id, leaf, subroot, 0 AS lvl, place AS pos, node, proof FROM g JOIN s ON g.tree = s.tree AND g.lvl = s.height
  UNION ALL
  SELECT doc_id, leaf, subroot, e.lvl + 1, e.pos // 8, sha256(f.l || node || f.r), proof || f.l || f.r
  FROM e JOIN f ON f.tree IS NULL AND e.lvl = f.lvl AND e.pos = f.pos
)
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = h AS verified
FROM e JOIN m ON m.total = 1 AND e.lvl = m.lvl
"""

for _query, _sql in ((op11_fill_in_middle, OP11_SQL), (op12_merkle_manifest, OP12_SQL)):
    QUERIES[_query.__name__] = _query
    ORACLES[_query.__name__] = _sql


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold("doc_id", 5) != 0)
    return langid.identify(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "languages")


# A trained model; tests/llm hold it against a brute-force version.
QUERIES[op13_language_id.__name__] = op13_language_id
