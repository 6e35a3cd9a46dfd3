"""Line dedup over overlapping three-line windows, with DataFrame functions only.

A text is split at line feeds; each three consecutive lines of a document are a window. Of windows with the same
three lines the first occurrence (smallest id, nulls last, then smallest line) stays; every later occurrence is
covered, and a line in any covered window goes. Kept lines are joined by line feeds again. Windows of one document
may repeat each other, so the later of two equal passages in a document goes as well.

A null text has no lines and stays null, an empty text has one empty line; texts of fewer than three lines have no
window and stay as they are. Rows have numbers of their own, written with the table: of rows with one id, equal ones
among them, the one that comes first in the table is the earlier one. Only id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Steps, numbered

#: Lines of a window.
SPAN = 3


def line_count(text: Column) -> Column:
    """Lines of a text: its line feeds and one; 0 for null."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def windows(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, row, line (of the window's first line, from 0), key: a row for each window.

    The key is 128 bits: two 64-bit hashes over the lines' hashes, of two kinds and seeds.
    """
    lines = F.split("text", "\n", -1)
    hashed = docs.where(F.col("text").isNotNull()).select(
        "doc_id", "row",
        F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x, F.char_length(x)).alias("b"))).alias("h"),
    ).where(F.size("h") >= span)
    # The array beside itself, shifted line by line: one element a window, so a long text costs no more than its lines.
    shifted = F.arrays_zip(*[F.slice("h", F.lit(i + 1), F.size("h") - (span - 1)).alias(f"h{i}") for i in range(span)])
    return hashed.select("doc_id", "row", F.posexplode(shifted).alias("line", "w")).select(
        "doc_id", "row", "line",
        F.xxhash64(*[F.col("w").getField(f"h{i}").getField("a") for i in range(span)]).alias("k1"),
        F.xxhash64(*[F.col("w").getField(f"h{i}").getField("b") for i in range(span)]).alias("k2"),
    )


def later_windows(docs: DataFrame, steps: Steps, span: int = SPAN) -> DataFrame:
    """row, line of each window that stands earlier as well."""
    every = windows(docs, span)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "line")
    # Counts and first places combine on the map side, so a window that stands in very many documents is one row a task.
    repeated = steps.keep(
        every.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where(F.col("n") > 1), "repeated"
    )
    # Both sides of this join are shuffled for it, so AQE can split the partition of a frequent window.
    met = every.join(repeated.hint("merge"), ["k1", "k2"])
    return met.where(place != F.col("first")).select("row", "line")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """doc_id, text, n_lines, n_removed and kept_text of every row."""
    steps = Steps(docs.sparkSession, "line-dedup")
    rows, row = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), steps)
    rows = rows.withColumnRenamed(row, "row")
    covered = later_windows(rows, steps, span).groupBy("row").agg(F.collect_set("line").alias("starts"))
    joined = rows.join(covered, "row", "left")
    # Covered positions merged: each line of each covered window, once.
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (span - 1)))))
    marked = joined.select(
        "doc_id", "text", F.coalesce(gone, F.array().cast("array<int>")).alias("gone"), F.split("text", "\n", -1).alias("lines")
    )
    left_over = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return marked.select(
        "doc_id", "text", line_count(F.col("text")).alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
        F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(left_over, lambda i: F.get("lines", i)), "\n")).alias("kept_text"),
    )
