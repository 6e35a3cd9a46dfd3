"""Sharding by extendible hashing.

A row's key is hashed to three times 60 bits: of its id, of id and text, and of a number of its own. The directory starts with one bucket; a bucket whose texts exceed the byte limit
is split on its next hash bit, and so on until every shard fits. A step looks at STRIDE more bits of the oversized
buckets at once: one sum of bytes by hash prefix, from which the splits of all STRIDE bits follow. Rows of buckets
that fit are not touched again, the directory stays a table.

Bytes are those of the text as UTF-8, 0 for null and empty texts. Ids go as text, null as empty text. Rows with one id
share a shard as long as they fit; where they do not, the bits of their texts part them, and those of the row numbers
rows that are equal. So a shard exceeds the limit only if it is one row with a text larger than that; `fits` is false
then. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Steps, numbered

#: Bytes a shard may hold.
LIMIT = 16 * 1024 * 1024
#: Hash bits looked at in one step, bits of one hash, and of all three.
STRIDE, WORD, BITS = 10, 60, 180


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5 as 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 2), WORD, "0")


def row_bits(id_col: str, text_col: str, row: str) -> Column:
    """All bits of a row: no two rows have the same, and rows of one id differ only behind the first 60."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.concat(hash_bits(key), hash_bits(F.concat(key, F.lit(":"), F.coalesce(text_col, F.lit("")))), hash_bits(F.col(row)))


def directory(rows: DataFrame, steps: Steps, limit: int) -> DataFrame:
    """shard (the bits of its prefix), shard_bytes, shard_rows, fits: the leaves for rows of bits, bytes.

    A directory has some 2 * bytes / limit entries; it is never collected.
    """
    depth, open_rows, leaves = 0, rows, None
    root = rows.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), (F.min("bits") == F.max("bits")).alias("one")).first()
    if not root["n"]:
        return rows.select(F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_rows"), F.lit(True).alias("fits")).limit(0)
    if root["bytes"] <= limit or root["one"]:
        return rows.sparkSession.range(1).select(
            F.lit("").alias("shard"), F.lit(root["bytes"]).cast("long").alias("shard_bytes"), F.lit(root["n"]).cast("long").alias("shard_rows"),
            F.lit(root["bytes"] <= limit).alias("fits"),
        )
    while True:
        deep = min(depth + STRIDE, BITS)
        # One sum by the longest prefix of this step; buckets of fewer bits are sums of those.
        fine = open_rows.groupBy(F.substring("bits", 1, deep).alias("prefix")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("bits").alias("lo"), F.max("bits").alias("hi")
        )
        nodes = fine.select(
            F.explode(F.sequence(F.lit(depth + 1), F.lit(deep))).alias("depth"), "prefix", "bytes", "n", "lo", "hi"
        ).groupBy("depth", F.expr("substring(prefix, 1, depth)").alias("shard")).agg(
            F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        )
        nodes = steps.keep(nodes.withColumn("done", (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))), f"nodes{depth}")
        # A node is a leaf if it is done and its parent was split; the parents above this step's first bit all were.
        parents = nodes.where(~F.col("done")).select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("parent"))
        first = nodes.where(F.col("done") & (F.col("depth") == depth + 1))
        below = nodes.where(F.col("done") & (F.col("depth") > depth + 1)).withColumn("parent", F.expr("substring(shard, 1, depth - 1)"))
        found = first.unionByName(below.join(parents, ["depth", "parent"], "left_semi").drop("parent")).select(
            "shard", F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows"), (F.col("bytes") <= limit).alias("fits")
        )
        leaves = found if leaves is None else leaves.unionByName(found)
        still = nodes.where(~F.col("done") & (F.col("depth") == deep)).select(F.col("shard").alias("prefix"))
        if deep == BITS or still.isEmpty():
            return leaves
        open_rows = steps.keep(
            open_rows.join(still, F.substring("bits", 1, deep) == F.col("prefix"), "left_semi"), f"open{deep}"
        )
        depth = deep


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, bytes, shard, shard_bytes, shard_rows, fits for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    return _placed(rows, Steps(docs.sparkSession, "sharding"), limit).drop("row")


def _placed(numbered_rows: DataFrame, steps: Steps, limit: int) -> DataFrame:
    """doc_id, row, bytes, shard, shard_bytes, shard_rows, fits of rows of doc_id, text and row, a number."""
    rows = steps.keep(
        numbered_rows.select(
            "doc_id", "row", row_bits("doc_id", "text", "row").alias("bits"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")
        ),
        "rows",
    )
    leaves = steps.keep(directory(rows, steps, limit), "leaves")
    # No leaf is a prefix of another, so the greatest leaf not above a row's bits is its own: join by the depths in use.
    depths = [r[0] for r in leaves.select(F.length("shard").alias("d")).distinct().orderBy("d").collect()]  # at most 181 numbers, and few of them
    by_depth = [
        rows.join(leaves.where(F.length("shard") == d), F.substring("bits", 1, d) == F.col("shard")) for d in depths
    ]
    if not by_depth:
        return rows.select("doc_id", "row", "bytes").withColumns(
            {"shard": F.lit(""), "shard_bytes": F.lit(0).cast("long"), "shard_rows": F.lit(0).cast("long"), "fits": F.lit(True)}
        )
    out = by_depth[0]
    for more in by_depth[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "row", "bytes", "shard", "shard_bytes", "shard_rows", "fits")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """docs as Parquet below path, a folder for each shard. No task writes more than one file of a shard."""
    steps = Steps(docs.sparkSession, "write-shards")
    rows, row = numbered(docs, steps)
    placed = _placed(rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(row).alias("row")), steps, limit)
    own = placed.select(F.col("row").alias(row), F.concat(F.lit("b"), "shard").alias("shard"))
    rows.join(own, row).drop(row).repartition("shard").write.partitionBy("shard").parquet(path)
