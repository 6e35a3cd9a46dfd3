"""Substring dedup over a De Bruijn graph of token windows.

The graph's edges are the token k-mers of WINDOW words: a window leads from its first to its last WINDOW - 1 words. An
edge that stands more than once is repeated, and each word covered by a repeated edge goes.

Edges are not moved one by one. All edges that share one anchor, the ANCHOR-word piece whose hash is smallest in the
window (leftmost of equal ones), are a nonbranching piece of path already and travel as one run. Joins on the anchor
and on the run's hash show which runs stand elsewhere as a whole. Runs whose anchor has other surroundings elsewhere
branch: only for those are single edges compared. Repeated runs that follow each other in a document as they do at
the place where they stand first (their source coordinates) are compacted into one long span. Each span's source row
gets its start and length, each once, and the SHA-256 of the words there must be that of the span; single edges rest on
their hashes. If one differs (two texts with equal 128-bit hashes) the work is done again with other hashes.

Words are the runs of characters other than [\\x20\\x09-\\x0D], unchanged. A null or empty text has no words; a text of
fewer than WINDOW words has no edge and loses none. Rows are told apart by a 64-bit number that each gets when the input
is written for the job, whatever their ids; rows equal in id and text repeat each other, so each of their windows stands
twice. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Steps, numbered, remembered
from riskloom.llm.words import Chunk, Hashing, chunks, mixed

WINDOW, ANCHOR = 35, 10
#: A place is start << 32 | run's edges, both below 2 ** 31.
_EDGES = (1 << 31) - 1
SEEDS = (100, 200, 300)


class Edges:
    """Hashes of a chunk's words, anchors and windows."""

    def __init__(self, chunk: Chunk, hashing: Hashing, window: int):
        words = hashing.words(chunk.data, chunk.starts, chunk.ends)
        n = len(words) - window + 1
        self.row = np.searchsorted(chunk.first, np.arange(max(n, 0)), side="right") - 1
        # Windows that lie within one text.
        self.at = np.flatnonzero(np.arange(max(n, 0)) + window <= chunk.first[self.row + 1]) if n > 0 else np.empty(0, np.int64)
        self.row = self.row[self.at]
        if not len(self.at):
            return
        anchors = hashing.rows(words, min(ANCHOR, window))
        low, place = anchors, np.arange(len(anchors))
        size, span = 1, window - min(ANCHOR, window) + 1
        while size < span:
            step = min(size, span - size)  # overlapping halves cover a span that is no power of two
            later = low[step:] < low[:-step]  # the left one of equal anchors
            place = np.where(later, place[step:], place[:-step])
            low = np.where(later, low[step:], low[:-step])
            size += step
        self.anchor, self.place = low[self.at], place[self.at]
        self.full = hashing.rows(words, window, salt=7)[self.at]


def _runs(hashing: Hashing, window: int):
    """anchor, hash, row, place of each run of windows with one anchor."""
    powers = np.random.default_rng(17).integers(0, 2**63, window + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(None)
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                e = Edges(chunk, hashing, window)
                if not len(e.at):
                    continue
                new = np.ones(len(e.at), dtype=bool)
                new[1:] = (e.place[1:] != e.place[:-1]) | (e.row[1:] != e.row[:-1])
                first = np.flatnonzero(new)
                edges = np.diff(np.append(first, len(new)))
                inside = np.arange(len(new)) - np.repeat(first, edges)
                whole = mixed(np.add.reduceat(e.full * powers[inside], first) + edges.astype(np.uint64))
                row = e.row[first] + chunk.rows.start
                start = e.at[first] - chunk.first[e.row[first]]
                place = (start << 32) | edges
                yield pa.RecordBatch.from_arrays(
                    [pa.array(e.anchor[first].view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(place)],
                    names=["anchor", "h", "row", "place"],
                )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd: the bytes of a text are shuffled by row twice, packed they are half as many."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        blobs = [pack.compress((t or "").encode()) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["row", "doc_id", "blob"])


def _single_edges(hashing: Hashing, window: int):
    """k1, k2, row, start, whole of each edge of the runs asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(None)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                text = unpack.decompress(batch.column(1)[i].as_py())
                asked = batch.column(2).slice(i, 1).flatten()
                first, n, whole = (np.asarray(asked.field(k)) for k in range(3))
                for chunk in chunks(pa.array([text.decode()], pa.large_string())):
                    e = Edges(chunk, hashing, window)
                    lengths = n.astype(np.int64)
                    each = np.repeat(first.astype(np.int64), lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    # In one text every window is valid, so window number and place in `at` are the same.
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(e.anchor[each].view(np.int64)), pa.array(e.full[each].view(np.int64)),
                            batch.column(0).take(pa.array(np.full(len(each), i))),
                            pa.array(each.astype(np.int32)), pa.array(np.repeat(whole, lengths)),
                        ],
                        names=["k1", "k2", "row", "start", "whole"],
                    )

    return run


def _digests(words: list[bytes], spans: list[list[int]]) -> list[bytes]:
    """SHA-256 of the words from start to end, joined by one space; words beyond the text are none."""
    if not spans:
        return []
    joined = memoryview(b" ".join(words))
    first = np.cumsum([0] + [len(w) + 1 for w in words])
    ends = lambda end: max(int(first[min(end, len(words))]) - 1, 0)
    return [hashlib.sha256(joined[int(first[min(start, len(words))]) : ends(end)]).digest() for start, end in spans]


def _kept(window: int):
    """What is left of each text; and the SHA-256 of the words of its spans, then of those that others have from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(None)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, words_n, removed, sums = [], [], [], []
            for i in range(batch.num_rows):
                words = unpack.decompress(batch.column(1)[i].as_py()).split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                own, lent = (batch.column(c)[i].as_py() or [] for c in (2, 5))
                for start, end in own:
                    gone[start] += 1
                    gone[end] -= 1
                sums.append(_digests(words, own + lent))
                for start in batch.column(3)[i].as_py() or ():
                    gone[start] += 1
                    gone[start + window] -= 1
                stay = np.cumsum(gone[:-1]) == 0
                texts.append(b" ".join([w for w, s in zip(words, stay.tolist()) if s]).decode())
                words_n.append(len(words))
                removed.append(len(words) - int(stay.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words_n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), pa.array(sums, pa.list_(pa.binary())), batch.column(4)],
                names=["doc_id", "n_words", "n_removed", "kept_text", "digests", "sources"],
            )

    return run


def _start(place: str) -> F.Column:
    return F.shiftright(place, 32).cast("int")


def _edges(place: str) -> F.Column:
    return F.col(place).bitwiseAND(F.lit(_EDGES)).cast("int")


def _once(rows: DataFrame, steps: Steps, seed: int, window: int, result) -> DataFrame | None:
    """result(kept texts) of row, doc_id, text as a table, or None if the spans' words did not bear out their hashes."""
    hashing = Hashing(seed)
    kind = rows.schema["doc_id"].dataType.simpleString()
    at = lambda name: f"{seed}-{name}"
    runs = steps.keep(rows.select("row", "text").mapInArrow(_runs(hashing, window), "anchor long, h long, row long, place long"), at("runs"))
    # Anchors that stand once hold no repeated edge: three quarters of the runs of ordinary prose go here.
    again = steps.keep(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), at("anchors"))
    met = steps.keep(runs.join(again.hint("merge"), "anchor"), at("met"))
    steps.drop(at("runs"), at("anchors"))
    # The first place of each run, and whether its anchor has other runs.
    kinds = steps.keep(met.groupBy("anchor", "h").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("source")), at("kinds"))
    # Kept, so that the join below shuffles both sides for itself and AQE can split a common anchor's partition.
    branching = steps.keep(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor"), at("branching"))

    # Spans: repeated runs side by side that come, in step, from one source are one nonbranching path.
    sourced = met.join(kinds.where("n > 1").select("anchor", "h", "source").hint("merge"), ["anchor", "h"]).select(
        "row", _start("place").alias("start"), _edges("place").alias("edges"), F.col("source.row").alias("from_row"), _start("source.place").alias("from_start"),
    )
    order = Window.partitionBy("row").orderBy("start")
    before = lambda c: F.lag(c).over(order)
    goes_on = (
        (F.col("start") == before("start") + before("edges")) & (F.col("from_row") == before("from_row"))
        & (F.col("from_start") == before("from_start") + before("edges"))
    )
    paths = steps.keep(
        sourced.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("path", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "path").agg(
            F.min("start").alias("start"), F.max(F.col("start") + F.col("edges") + (window - 1)).alias("end"),
            F.min_by(F.struct("from_row", "from_start"), "start").alias("source"),
        ).select("row", "start", "end", F.col("source.from_row").alias("from_row"), F.col("source.from_start").alias("from_start"), (F.col("end") - F.col("start")).alias("words")),
        at("paths"),
    )
    steps.drop(at("met"))
    spans = paths.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "from_row", "from_start", "words"))).alias("spans"))
    # What a text's copies have from it: each start and length once, however many copies there are.
    lent = paths.where("row != from_row or start != from_start").groupBy(F.col("from_row").alias("row")).agg(
        F.sort_array(F.collect_set(F.struct("from_start", "words"))).alias("lent")
    )

    # Single edges where paths branch: each run once, with whether it is repeated as a whole.
    asked = kinds.join(branching.hint("merge"), "anchor", "left_semi").select(
        F.col("source.row").alias("row"),
        F.struct(_start("source.place").alias("start"), _edges("source.place").alias("n"), (F.col("n") > 1).alias("whole")).alias("run"),
    ).groupBy("row").agg(F.collect_list("run").alias("runs"))
    packed = rows.select("row", "doc_id", "text").mapInArrow(_packed, f"row long, doc_id {kind}, blob binary")
    wanted = packed.select("row", "blob").join(asked, "row")
    singles = steps.keep(
        wanted.select("row", "blob", "runs").mapInArrow(_single_edges(hashing, window), "k1 long, k2 long, row long, start int, whole boolean"), at("singles")
    )
    steps.drop(at("kinds"), at("branching"))
    # Of a repeated edge one run at most is not known to be repeated already, or it stands in several.
    twice = steps.keep(
        singles.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("whole").alias("known")).where("n > 1 and not known").select("k1", "k2"), at("twice")
    )
    starts = singles.where("not whole").join(twice.hint("merge"), ["k1", "k2"]).groupBy("row").agg(F.collect_set("start").alias("starts"))

    claim = lambda row, start, words: F.struct(row.alias("row"), start.alias("start"), words.alias("words"))
    claims = F.concat(
        F.coalesce(F.transform("spans", lambda s: claim(s["from_row"], s["from_start"], s["words"])), F.array()),
        F.coalesce(F.transform("lent", lambda s: claim(F.col("row"), s["from_start"], s["words"])), F.array()),
    )
    done = packed.join(spans, "row", "left").join(starts, "row", "left").join(lent, "row", "left").select(
        "doc_id", "blob", F.transform("spans", lambda s: F.array(s["start"], s["end"])).alias("spans"), "starts", claims.alias("sources"),
        F.transform("lent", lambda s: F.array(s["from_start"], s["from_start"] + s["words"])).alias("lent"),
    ).mapInArrow(
        _kept(window),
        f"doc_id {kind}, n_words long, n_removed long, kept_text string, digests array<binary>, sources array<struct<row:bigint,start:int,words:int>>",
    )
    out = steps.keep(result(done), at("result"))
    steps.drop(at("paths"), at("singles"), at("twice"))
    told = out.select(F.explode(F.arrays_zip("digests", "sources")).alias("c")).groupBy("c.sources").agg(
        F.min("c.digests").alias("lo"), F.max("c.digests").alias("hi")
    )
    if told.where("lo != hi").isEmpty():
        return out.drop("digests", "sources")
    steps.drop(at("result"))
    return None


def removed_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, result=lambda done: done) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row. `result` may narrow the columns but for digests and sources."""
    steps = Steps(docs.sparkSession, "substring-dedup")
    rows, row = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), steps)
    out = _removed(rows.withColumnRenamed(row, "row"), steps, window, result)
    steps.drop("numbered")
    return out


def _removed(rows: DataFrame, steps: Steps, window: int, result) -> DataFrame:
    for seed in SEEDS:
        out = _once(rows, steps, seed, window, result)
        if out is not None:
            return out
    raise RuntimeError("spans differ from their sources under three independent pairs of 64-bit hashes")


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """docs with what is left of their texts; texts that lose nothing stay as they are. Ids may be null or repeated."""
    steps = Steps(docs.sparkSession, "substring-stage")
    own_rows, row = numbered(docs, steps)
    rows = own_rows.select(F.col(row).alias("row"), F.col(row).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    changed = _removed(rows, steps, window, lambda d: d.where("n_removed > 0 or size(digests) > 0"))
    cut = changed.where("n_removed > 0").select("doc_id", "kept_text").alias("c")
    d = own_rows.alias("d")
    own = lambda c: F.col(f"d.`{c}`")  # noqa: E731  whatever the names of other columns
    both = d.join(cut, own(row) == F.col("c.doc_id"), "left")
    left = F.col("c.kept_text")
    new = {text_col: F.coalesce(left, own(text_col))}
    if count_col in docs.columns:
        new[count_col] = F.when(left.isNull(), own(count_col)).otherwise(F.char_length(left)).cast(docs.schema[count_col].dataType)
    return both.select(*[new.get(c, own(c)).alias(c) for c in docs.columns])
