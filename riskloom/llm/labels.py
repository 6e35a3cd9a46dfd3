"""Folds and bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes of the longest text that may be part of a sample, and of all texts of one class; they bound what the driver is sent.
LONGEST, BYTES = 1 << 20, 6 << 20


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts, F.lit(0)).cast("int")


def label_rows(labels: DataFrame, label_col: str, learn: Column) -> DataFrame:
    """id and y of the labels to learn from: null labels and ids are left out, of several labels of one id the largest counts."""
    rows = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    return rows.where(learn).groupBy("id").agg(F.max("y").alias("y"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, most: int, id_col: str = "doc_id", text_col: str = "text",
    longest: int = LONGEST, room: int = BYTES,
) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most `most` labelled texts of each class, `room` bytes in all, and how many labels of each class there are to learn from.

    Of the labelled texts of up to `longest` bytes, those of the smallest hashes of their ids are taken while they fit: the
    sample is the same on each run, long texts are part of it, and one left out makes room for the next. A text is taken
    whole or not at all. Long texts are no reason for a class to be empty: if it has texts, and all are too long, that is a
    ValueError. `learn` may use the column `id` only. Null labels and ids are left out; of several labels of one id the
    largest counts, of several rows of one id one is taken.
    """
    rows = label_rows(labels, label_col, learn)
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sizes = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("bytes")).join(rows, "id")
    sizes = sizes.groupBy("id", "y").agg(F.max("bytes").alias("bytes"))
    chosen = []
    for y in (0, 1):
        own = sizes.where(F.col("y") == y)
        near = own.where(F.col("bytes") <= longest).orderBy(F.xxhash64("id"), "id").limit(most).collect()
        if not near and counts.get(y) and not own.isEmpty():
            raise ValueError(f"all texts with {label_col} = {y} are longer than {longest} bytes")
        left = room
        for r in near:
            if r["bytes"] <= left:
                left -= r["bytes"]
                chosen.append((r["id"], y))
    wanted = docs.sparkSession.createDataFrame(chosen, rows.schema)  # 2 * most rows at the most, so their broadcast is bounded
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(wanted), "id")
    found = texts.orderBy(F.xxhash64("id"), "id", "text").collect() if chosen else []
    kept = {r["id"]: (r["text"], r["y"]) for r in reversed(found)}
    return [kept[i] for i in dict.fromkeys(r["id"] for r in found)], counts
