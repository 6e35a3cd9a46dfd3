"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries of the input's partitions name the digests that many rows share. Their counts and winners
are then computed over all rows, verified so, and broadcast: rows of a frequent text are decided where they lie.
All other rows are grouped by one ordinary shuffle, in which no group holds more than 2 / (SLOTS + 1) of all rows.

Texts are equal when identical without the characters of [\\x20\\x09-\\x0D]. A null text counts as empty; empty
texts form one group. Of equal texts the row with the most code points of the original text stays, then the smallest
id (nulls last); of wholly equal rows one stays. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Steps, numbered, remembered, without

#: Counters of a summary; also bounds the digests that are broadcast (SLOTS + 1).
SLOTS = 1000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def misra_gries(digests, slots: int, counts: dict | None = None) -> dict:
    """Counters that fall short of the true counts by at most rows / (slots + 1)."""
    counts = {} if counts is None else counts
    for d in digests:
        if d in counts:
            counts[d] += 1
        elif len(counts) < slots:
            counts[d] = 1
        else:
            counts = {k: v - 1 for k, v in counts.items() if v > 1}
    return counts


def _summaries(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(None)
        counts: dict = {}
        for batch in batches:
            counts = misra_gries(batch.column(0).to_pylist(), slots, counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "n"]
        )

    return run


def frequent(digests: DataFrame, rows: int, slots: int = SLOTS) -> DataFrame:
    """At most slots + 1 digests, among them each one that over 2 / (slots + 1) of the rows have.

    A partition's counter is too small by at most its rows / (slots + 1), the sum of all by rows / (slots + 1).
    Sums add up to no more than rows, so at most slots + 1 of them exceed rows / (slots + 1).
    """
    summed = digests.select("digest").mapInArrow(_summaries(slots), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return summed.where(F.col("n") * (slots + 1) > rows).select("digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, steps: Steps | None = None) -> DataFrame:
    """A row for each row of docs: its id, keep_id, group_size, kept and the SHA-256 of the normalised text.

    The result reads tables of `steps`; without any they stay as long as the session.
    """
    steps = steps or Steps(docs.sparkSession, "exact-dedup")
    text = F.col(text_col)
    rows = steps.keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.char_length(F.coalesce(text, F.lit(""))).alias("points"),
            F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256)).alias("digest"),
            # Written with the table: however its files are split when it is read again, a row keeps its number.
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    # An order without ties: the number tells wholly equal rows apart.
    order = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    ranked = rows.withColumn("best", order)
    heavy = steps.keep(frequent(rows, rows.count(), slots), "heavy")

    held = ranked.join(F.broadcast(heavy), "digest")  # at most slots + 1 rows, see frequent()
    winners = steps.keep(held.groupBy("digest").agg(F.min("best").alias("winner"), F.count("*").alias("group_size")), "winners")
    here = ranked.join(F.broadcast(winners), "digest")
    each = Window.partitionBy("digest")
    rest = ranked.join(F.broadcast(heavy), "digest", "left_anti").select(
        "digest", "doc_id", "row", F.min("best").over(each).alias("winner"), F.count("*").over(each).alias("group_size")
    )
    return here.select(*rest.columns).unionByName(rest).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """docs without the rows that exact_groups drops, row by row: ids may be null or repeated. Rows keep all their columns."""
    steps = Steps(docs.sparkSession, "exact-stage")
    rows, row = numbered(docs, steps)
    place = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    search = Steps(docs.sparkSession, "exact-dedup")
    groups = exact_groups(rows.select(place.alias("place"), F.col(text_col).alias("text")), "place", "text", slots, search)
    left = without(rows, row, groups.where(~F.col("kept")).select(F.col("doc_id.row").alias(row)), steps)
    search.end()
    return left
