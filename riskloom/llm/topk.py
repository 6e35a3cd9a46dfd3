"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query, block against block. A round splits the interval that holds a
query's kth score into BINS bins, adds up the bins' counts over all blocks and keeps the bin in which the count from
the top reaches k. When bins are one score wide the kth score is known; a last pass takes the scores above it and,
of the scores equal to it, the smallest ids. Scores are computed anew in each pass, so no pass stores them.

Components become floor(scale * x) as integers; a vector takes no part if it, its id or a component is null or if a
component is not finite. An empty vector scores 0 against empty vectors. Vectors are compared with those of as many
components only. Exactly repeated rows count once; an id with several vectors is one candidate for each of them, and
as a query keeps the best k over them all. Components and scores are 64-bit integers; beyond that they wrap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Steps

#: Vectors of a candidate block and of a query block, on average.
CANDIDATES, QUERIES = 4096, 256
BINS = 1024
#: Sums of products below this are exact in doubles, so the fast matrix product can be used.
EXACT = 2.0**53


def vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v (array of long) of the rows that take part, without repeats."""
    x = F.col(vector_col)
    whole = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))), F.lit(False))
    return (
        df.where(F.col(id_col).isNotNull() & whole)
        .select(
            F.col(id_col).cast("long").alias("id"),
            F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"),
        )
        .distinct()
    )


def _blocks(df: DataFrame, size: int, rows: int) -> DataFrame:
    """Rows with their vectors' ids and components as bytes, some `size` vectors each, of one length."""
    parts = max(1, -(-rows // size))
    packed = (
        df.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int"))
        .withColumn("dim", F.size("v"))
        .groupBy("block", "dim")
        .agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("m"))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m = batch.column(2).slice(i, 1).flatten()
                ids, v = (m.field(k) for k in range(2))
                flat = np.asarray(v.flatten(), dtype=np.int64)
                most = int(np.abs(flat).max()) if len(flat) else 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([most], pa.int64()),
                        pa.array([np.asarray(ids, dtype=np.int64).tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary()),
                    ],
                    names=["block", "dim", "most", "ids", "v"],
                )

    return packed.mapInArrow(pack, "block int, dim int, most long, ids binary, v binary")


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and the scores of one pair of blocks (queries by candidates)."""
    q_ids, c_ids = (np.frombuffer(row[k], dtype=np.int64) for k in ("q_ids", "c_ids"))
    q, c = (np.frombuffer(row[k], dtype=np.int64).reshape(len(ids), row["dim"]) for k, ids in (("q_v", q_ids), ("c_v", c_ids)))
    if float(row["q_most"]) * float(row["c_most"]) * max(1, row["dim"]) < EXACT:
        return q_ids, c_ids, np.rint(q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q_ids, c_ids, q @ c.T


FIELDS = ("dim", "q_most", "q_ids", "q_v", "c_most", "c_ids", "c_v", "low", "width")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _histograms(k: int, bins: int):
    """Counts of a block pair by query and bin, from the top down to where k scores are counted.

    Bins below that cannot hold the kth score of all candidates, as those above hold k already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            q_ids, c_ids, s = _scores(row)
            low, width = (np.frombuffer(row[x], dtype=np.int64) for x in ("low", "width"))
            out = []
            for i, query in enumerate(q_ids):
                mine = s[i][c_ids != query]
                top = mine[mine >= low[i]]
                over = top.view(np.uint64) - low[i : i + 1].view(np.uint64)  # exact even where the difference exceeds 63 bits
                at, n = np.unique(np.minimum(over // np.uint64(width[i]), np.uint64(bins)), return_counts=True)
                at, n = at[::-1], n[::-1]
                upto = int(np.searchsorted(np.cumsum(n), k)) + 1
                out += [(int(query), int(a), int(b)) for a, b in zip(at[:upto], n[:upto])]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                    names=["query_id", "bin", "n"],
                )

    return run


def _winners(k: int):
    """Of a block pair, at most k scores a query that are at or above its bound, ties to smaller ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            q_ids, c_ids, s = _scores(row)
            low = np.frombuffer(row["low"], dtype=np.int64)
            out = []
            for i, query in enumerate(q_ids):
                hit = np.flatnonzero((c_ids != query) & (s[i] >= low[i]))
                best = hit[np.lexsort((c_ids[hit], -s[i][hit]))][:k]
                out += [(int(query), int(c_ids[j]), int(s[i][j])) for j in best]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def _with_bounds(blocks: DataFrame, bounds: DataFrame) -> DataFrame:
    """Query blocks with the bounds of their queries in the order of the block; a block holds some QUERIES rows."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q = np.frombuffer(batch.column(2)[i].as_py(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(q), batch.column(0)[i].as_py(), np.int32)), pa.array(np.full(len(q), batch.column(1)[i].as_py(), np.int32)),
                        pa.array(np.arange(len(q), dtype=np.int32)), pa.array(q),
                    ],
                    names=["block", "dim", "place", "query_id"],
                )

    placed = blocks.select("block", "dim", "ids").mapInArrow(ids, "block int, dim int, place int, query_id long")
    listed = placed.join(bounds, "query_id").groupBy("block", "dim").agg(F.sort_array(F.collect_list(F.struct("place", "low", "width"))).alias("b"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.column(2).slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1)]
                    + [pa.array([np.asarray(b.field(f), dtype=np.int64).tobytes()], pa.binary()) for f in (1, 2)],
                    names=["block", "dim", "low", "width"],
                )

    return blocks.join(listed.mapInArrow(pack, "block int, dim int, low binary, width binary"), ["block", "dim"])


def top_k(
    df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
    candidates: int = CANDIDATES, queries: int = QUERIES, bins: int = BINS,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products of each row for which is_query holds.

    is_query may use the column `id` only. All other rows, whatever their id, are candidates of a query.
    """
    steps = Steps(df.sparkSession, "top-k")
    rows = steps.keep(vectors(df, id_col, vector_col, scale), "vectors")
    asked = rows.where(is_query)
    n, q = rows.count(), asked.count()
    c_blocks = steps.keep(_blocks(rows, candidates, n), "candidates")
    q_blocks = steps.keep(_blocks(asked, queries, q), "queries")
    parts = max(1, -(-n // candidates))
    # A product of two vectors is at most that of their lengths; the longest vector bounds all.
    longest = rows.select(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)).alias("l")).agg(F.max("l")).first()[0] or 0.0
    reach = min(int(longest * longest * (1 + 1e-9)) + 1, 2**63 - 1)
    width = -(-2 * reach // bins)
    bounds = asked.select(F.col("id").alias("query_id")).distinct().withColumns({"low": F.lit(-reach).cast("long"), "width": F.lit(width).cast("long")})

    def pairs(bounds: DataFrame) -> DataFrame:
        """Each query block meets each candidate block: it is sent to all of them by number, as a stated query set in blocks."""
        right = _with_bounds(q_blocks, bounds).select(
            "dim", "low", "width", F.col("most").alias("q_most"), F.col("ids").alias("q_ids"), F.col("v").alias("q_v"),
            F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("block"),
        )
        left = c_blocks.select("block", "dim", F.col("most").alias("c_most"), F.col("ids").alias("c_ids"), F.col("v").alias("c_v"))
        return left.hint("shuffle_hash").join(right, ["block", "dim"]).select(*FIELDS)

    level = 0
    while True:
        counts = pairs(bounds).mapInArrow(_histograms(k, bins), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        from_top = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        # The first bin from the top in which k is reached; the lowest one, if there are fewer candidates.
        reached = counts.withColumn("sum", F.sum("n").over(from_top)).groupBy("query_id").agg(
            F.coalesce(F.max(F.when(F.col("sum") >= k, F.col("bin"))), F.min("bin")).alias("bin")
        )
        narrower = -(-width // bins)
        # The bin's place is the new lower bound. Scores over the bin's end fall into the topmost bin of the next round.
        bounds = steps.keep(
            bounds.join(reached, "query_id").select(
                "query_id", (F.col("low").cast("decimal(38,0)") + F.col("bin") * F.col("width").cast("decimal(20,0)")).cast("long").alias("low"), F.lit(narrower).cast("long").alias("width")
            ),
            f"bounds{level}",
        )
        if width <= 1:
            break
        width, level = narrower, level + 1
    best = pairs(bounds).mapInArrow(_winners(k), "query_id long, vec_id long, score long")
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
