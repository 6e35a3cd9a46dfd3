"""Fill-in-middle transformation of whole texts, with a learned rank index over the places a text may be cut at.

A text is a row of units, `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`: a word with the white space before it, or white
space at the end. Boundary k is the byte offset behind the k-th unit. The index over the boundaries of a stretch of
texts is piecewise linear: greedy segments, each as long as one line stays within ERROR bytes of all its boundaries,
and one stored residual of a byte for each boundary. A cut is predicted from its rank by the segment's line and put
right by its residual, so it is exact.

Two cuts drawn from the document's id part prefix, middle and suffix. Form psm gives `<P>`prefix`<S>`suffix`<M>`middle,
spm `<S>`suffix`<P>`prefix`<M>`middle, plain the text itself: for empty texts, texts that hold a marker, and the share of
documents that are not drawn. A null text counts as empty. A null id is drawn as if it were written as nothing. Rows of
one id are drawn alike and cut each by its own number of units. An empty table gives an empty result; other columns
are not read. Each row is worked on by itself: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import remembered
from riskloom.llm.words import Chunk, chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
#: Bytes a segment's line may be off, small enough that a residual is one byte.
ERROR = 120
#: Boundaries looked at in one step while a segment grows.
_LEAST, _MOST = 64, 1 << 16


class RankIndex:
    """Offsets by rank: a line for each segment, and what each offset differs from it."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        starts, slopes = [], []
        at, window, n = 0, _LEAST, len(offsets)
        while at < n:
            low, high, end = -np.inf, np.inf, at + 1
            while end < n:
                upto = min(n, end + window)
                ranks, rise = np.arange(end - at, upto - at), offsets[end:upto] - offsets[at]
                lows = np.maximum(np.maximum.accumulate((rise - error) / ranks), low)
                highs = np.minimum(np.minimum.accumulate((rise + error) / ranks), high)
                apart = int(np.searchsorted(lows > highs, True))  # once no line fits, none does further on
                if apart:
                    low, high = lows[apart - 1], highs[apart - 1]
                end += apart
                if end < upto:
                    break
                window = min(2 * window, _MOST)
            starts.append(at)
            slopes.append((low + high) / 2 if end > at + 1 else 0.0)
            window = min(max(_LEAST, end - at), _MOST)
            at = end
        self.starts = np.array(starts, dtype=np.int64)
        self.origins = offsets[self.starts].astype(np.int64)
        self.slopes = np.array(slopes)
        self.residuals = np.empty(n, dtype=np.int8 if error <= ERROR else np.int64)
        for a in range(0, n, _MOST):
            ranks = np.arange(a, min(n, a + _MOST))
            self.residuals[ranks] = offsets[ranks] - self.predicted(ranks)

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        own = np.searchsorted(self.starts, ranks, side="right") - 1
        return self.origins[own] + np.rint(self.slopes[own] * (ranks - self.starts[own])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        return self.predicted(ranks) + self.residuals[ranks]


class Boundaries(NamedTuple):
    offsets: np.ndarray  # of all boundaries, text after text
    first: np.ndarray  # rank of each text's boundary 0
    units: np.ndarray  # of each text


def boundaries(chunk: Chunk) -> Boundaries:
    """Each text's first byte and the ends of its units, as places in the chunk's bytes."""
    begins, ends = chunk.bounds[:-1], chunk.bounds[1:]
    words = np.diff(chunk.first)
    last = begins.copy()  # where each text's last word ends
    last[words > 0] = chunk.ends[chunk.first[1:][words > 0] - 1]
    units = words + (last < ends)
    first = np.cumsum(units + 1) - (units + 1)
    offsets = np.empty(int((units + 1).sum()), dtype=np.int64)
    offsets[first] = begins
    offsets[np.arange(len(chunk.ends)) + np.repeat(first + 1 - chunk.first[:-1], words)] = chunk.ends
    trailing = last < ends
    offsets[(first + units)[trailing]] = ends[trailing]
    return Boundaries(offsets, first, units)


def _rearranged(rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(None)
        for batch in batches:
            draws = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5)]
            for chunk in chunks(batch.column(1)):
                rows = slice(chunk.rows.start, chunk.rows.stop)
                found = boundaries(chunk)
                index = RankIndex(found.offsets)
                h1, h2, h3, h4 = (d[rows] for d in draws)
                a, b = h1 % (found.units + 1), h2 % (found.units + 1)
                cuts = [index.offsets(found.first + k).tolist() for k in (np.minimum(a, b), np.maximum(a, b))]
                drawn, by_suffix = (h3 % 100 < rate).tolist(), (h4 % 100 < spm).tolist()
                points = (chunk.data & 0xC0) != 0x80
                data, bounds = memoryview(chunk.data), chunk.bounds.tolist()
                forms, prefixes, middles, outputs = [], [], [], []
                for i, (x, y, begin, end) in enumerate(zip(*cuts, bounds, bounds[1:])):
                    text = bytes(data[begin:end])
                    if not drawn[i] or not text or any(m in text for m in MARKERS):
                        form, sizes, out = "plain", (None, None), text
                    else:
                        form, sizes = "spm" if by_suffix[i] else "psm", tuple(int(np.count_nonzero(points[u:v])) for u, v in ((begin, x), (x, y)))
                        prefix, middle, suffix = text[: x - begin], text[x - begin : y - begin], text[y - begin :]
                        parts = (SUFFIX, suffix, PREFIX, prefix) if by_suffix[i] else (PREFIX, prefix, SUFFIX, suffix)
                        out = b"".join(p.encode() if isinstance(p, str) else p for p in (*parts, MIDDLE, middle))
                    forms.append(form)
                    prefixes.append(sizes[0])
                    middles.append(sizes[1])
                    outputs.append(out)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[rows], pa.array(found.units, pa.int64()), pa.array(forms, pa.string()),
                        pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def draws(id_col: Column, seed: int = 42, n: int = 4) -> list[Column]:
    """The first n groups of 8 hex digits of the SHA-256 of `seed:id`, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output of every row.

    rate percent of the documents are rearranged, spm percent of these with the suffix first.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[d.alias(f"h{i}") for i, d in enumerate(draws(F.col(id_col), seed))])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_rearranged(rate, spm), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Each marker stands once in it, as texts that hold one stay plain."""
    before, behind = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    suffix_last = F.concat(F.substring_index(F.substring_index(before, SUFFIX, 1), PREFIX, -1), behind, F.substring_index(before, SUFFIX, -1))
    prefix_last = F.concat(F.substring_index(before, PREFIX, -1), behind, F.substring_index(F.substring_index(before, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "psm", suffix_last).when(form == "spm", prefix_last).otherwise(output)
