"""Quality by Bradley-Terry ranking: scores learned from preference pairs, cut at a quantile.

A text is FEATURES numbers about its letters, words, lines and repeats, in one pass over its bytes. Each pair sets a
text labelled good against one labelled bad; the weights minimise the logistic loss of the difference of their features,
so only differences of scores mean anything. The cut is the quantile of the labelled scores at the share of bad labels;
a score is mapped to 0..1 such that the cut is THRESHOLD.

Every row with a label to learn from takes part: in scaling, in a pair at least, and in the cut. Spark sums gradients and
counts, so the driver holds a few numbers a task. Every text is scored, whole. An empty or null text has the features of no words. With labels of one class only, or none, every score is the
share of good labels. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Steps, remembered
from riskloom.llm.labels import label_rows
from riskloom.llm.words import Hashing, chunks

FEATURES, PAIRS, STEPS, RIDGE = 22, 10_000, 40, 1e-3
#: Bins an interval of scores is divided into, and rows that are looked at one by one.
BINS, NEAR = 1024, 2000
THRESHOLD = 0.3
_HASH = Hashing(40)

_UPPER, _LETTER, _DIGIT, _END, _COMMA, _LOUD, _SIGN, _BAR, _WIDE = range(9)
_CLASS = np.full(256, 10, dtype=np.int64)
for _number, _chars in ((_LETTER, b"abcdefghijklmnopqrstuvwxyz"), (_UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_DIGIT, b"0123456789"), (_END, b"."), (_COMMA, b",;:"), (_LOUD, b"!?"), (_SIGN, b"#$%&*+=~^@\\"), (_BAR, b"|<>[]{}/_")):
    _CLASS[list(_chars)] = _number
_CLASS[128:] = _WIDE


def features(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each text."""
    out = np.zeros((len(texts), FEATURES))
    for chunk in chunks(texts):
        n = len(chunk.rows)
        rows = slice(chunk.rows.start, chunk.rows.stop)
        words = np.diff(chunk.first)
        row = np.repeat(np.arange(n), words)
        per = lambda x, total: np.bincount(row, weights=x, minlength=n) / np.maximum(total, 1)
        sizes = chunk.ends - chunk.starts
        size = np.bincount(row, weights=sizes, minlength=n)
        kinds = np.zeros((n, 11))
        # Characters by kind, counted by text: the byte's text is that of the word it lies in.
        inside = np.zeros(len(chunk.data) + 1, dtype=np.int64)
        inside[chunk.starts] = 1
        word = np.cumsum(inside[:-1]) - 1
        solid = np.repeat(chunk.starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        if len(solid):
            kinds = np.bincount(row[word[solid]] * 11 + _CLASS[chunk.data[solid]], minlength=11 * n).reshape(n, 11)
        h = _HASH.words(chunk.data, chunk.starts, chunk.ends)
        mean = per(sizes, words)
        first, last = chunk.data[chunk.starts], chunk.data[chunk.ends - 1]
        kinds_first, kinds_last = _CLASS[first], _CLASS[last]
        lines = np.flatnonzero(chunk.data == 10)
        # Words, pairs and rows of five words that repeat within the text.
        repeats = []
        for k in (1, 2, 5):
            grams = _HASH.rows(h, k)
            same = row[: len(grams)] == row[k - 1 :] if len(grams) else np.empty(0, bool)
            g, r = grams[same], row[: len(grams)][same]
            order = np.lexsort((g, r))
            again = (g[order][1:] == g[order][:-1]) & (r[order][1:] == r[order][:-1])
            repeats.append(np.bincount(r[order][1:], weights=again, minlength=n) / np.maximum(np.bincount(r, minlength=n), 1))
        shouted = np.add.reduceat((_CLASS[chunk.data] == _UPPER).astype(np.int64), chunk.starts) >= np.maximum(2, sizes // 2) if len(sizes) else np.empty(0)
        letters = np.maximum(kinds[:, _UPPER] + kinds[:, _LETTER], 1)
        line_row = np.searchsorted(chunk.bounds, lines, side="right") - 1
        out[rows] = np.stack(
            [
                kinds[:, _UPPER] / letters, per(shouted, words), *(kinds[:, k] / np.maximum(size, 1) for k in (_DIGIT, _END, _COMMA, _LOUD, _SIGN, _BAR, 10)),
                per(kinds_last == _LOUD, words), per(kinds_last == _SIGN, words), per(kinds_last == _END, words), per(kinds_last == _COMMA, words),
                per(kinds_first == _UPPER, words), per(np.isin(kinds_first, (_SIGN, _BAR, 10)), words),
                mean, np.sqrt(np.maximum(per(sizes.astype(float) ** 2, words) - mean**2, 0)), repeats[0], repeats[1], repeats[2],
                np.bincount(line_row, minlength=n) / np.maximum(words, 1), np.log1p(words),
            ],
            axis=1,
        )
    return out


class Model(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    steep: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, THRESHOLD at the cut."""
        return 1 / (1 + np.exp(-np.clip(self.steep * (self.raw(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD)), -700, 700)))


def _arrays(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.stack(batch.column(name).to_numpy(zero_copy_only=False)) if len(batch) else np.empty((0, FEATURES))


def learned(docs: DataFrame, rows: DataFrame, steps: Steps, id_col: str, text_col: str) -> DataFrame:
    """y and x, the features, of every row whose id has a label; only features and ids are shuffled, no text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(None)
        for batch in batches:
            x = pa.array(list(features(batch.column(1))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["id", "x"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
    found = texts.mapInArrow(run, f"id {kind}, x array<double>").join(rows, "id")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartition(parts, F.xxhash64("id", "x")).sortWithinPartitions(F.xxhash64("id", "x"), "id", "x")
    return steps.keep(dealt.select("y", "x"), "learned")


def _totals(rows: DataFrame, one, size: int) -> np.ndarray:
    """Sum over all batches of one(batch), an array of that size; a row a task reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += one(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    return sum((np.array(r["total"]) for r in rows.mapInArrow(run, "total array<double>").toLocalIterator()), np.zeros(size))


def scaling(rows: DataFrame, bad_share: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Mean and deviation of the features, classes weighted by their share of all labels, and rows of each class."""
    def one(batch: pa.RecordBatch) -> np.ndarray:
        x, y = _arrays(batch, "x"), batch.column("y").to_numpy()
        return np.concatenate([np.concatenate([[np.sum(y == k)], x[y == k].sum(axis=0), (x[y == k] ** 2).sum(axis=0)]) for k in (0, 1)])

    bad, good = _totals(rows, one, 2 * (1 + 2 * FEATURES)).reshape(2, -1)
    n_bad, n_good = int(bad[0]), int(good[0])
    mean = bad_share * bad[1:] / max(1, n_bad) + (1 - bad_share) * good[1:] / max(1, n_good)
    centre = mean[:FEATURES]
    return centre, np.sqrt(np.maximum(mean[FEATURES:] - centre**2, 0)) + 1e-6, n_bad, n_good


def pairs_of(rows: DataFrame, n_bad: int, n_good: int, centre: np.ndarray, scale: np.ndarray, steps: Steps) -> DataFrame:
    """d, the difference of a good and a bad row's features, for pairs that every row is part of.

    Rows of each class are numbered in the order of a hash. Those of the larger class meet one of the other each, at equal
    distances several if that makes less than PAIRS pairs, or all there are.
    """
    small, n_large, n_small = (0, n_good, n_bad) if n_good >= n_bad else (1, n_bad, n_good)
    times = min(n_small, -(-PAIRS // n_large))
    placed = steps.keep(rows.select("y", "x", F.monotonically_increasing_id().alias("at")), "placed")
    part = F.shiftright("at", 33)
    counts = placed.groupBy("y", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("y").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task and class
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("y", "part", "offset")
    inside = Window.partitionBy("y", "part").orderBy("at")  # as many rows as a task wrote
    ranked = placed.withColumn("part", part).withColumn("r", F.row_number().over(inside)).join(F.broadcast(offsets), ["y", "part"])
    ranked = ranked.select("y", "x", (F.col("r") + F.col("offset") - 1).alias("rank"))
    step = max(1, n_small // times)
    large = ranked.where(F.col("y") != small).select(
        F.col("x").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("k"), "rank"
    ).withColumn("rank", (F.col("rank") + F.col("k") * step) % n_small)
    both = large.join(ranked.where(F.col("y") == small).select(F.col("x").alias("b"), "rank"), "rank")
    sign = 1.0 if small == 0 else -1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.clip((_arrays(batch, c) - centre) / scale, -6, 6) for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([pa.array(list(sign * (a - b)), pa.list_(pa.float64()))], names=["d"])

    return steps.keep(both.select("a", "b").mapInArrow(run, "d array<double>"), "pairs")


def weights_of(pairs: DataFrame) -> np.ndarray:
    """Weights of the least mean logistic loss over all pairs, by Newton steps that are halved where they go too far."""
    w = before = np.zeros(FEATURES)
    least = np.inf
    for _ in range(STEPS):
        def one(batch: pa.RecordBatch, w: np.ndarray = w) -> np.ndarray:
            d = _arrays(batch, "d")
            s = d @ w
            p = 1 / (1 + np.exp(np.clip(s, -700, 700)))
            return np.concatenate([[len(d), np.logaddexp(0, -s).sum()], -(d * p[:, None]).sum(axis=0), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])

        total = _totals(pairs, one, 2 + FEATURES + FEATURES**2)
        mean = total / total[0]
        loss = mean[1] + RIDGE / 2 * w @ w
        if loss > least + 1e-12:
            w = (w + before) / 2
            continue
        near, least = least - loss < 1e-9, loss
        if near:
            break
        before = w
        w = w - np.linalg.solve(mean[2 + FEATURES :].reshape(FEATURES, FEATURES) + RIDGE * np.eye(FEATURES), mean[2 : 2 + FEATURES] + RIDGE * w)
    return before if least < np.inf and loss > least else w


def quantile(scored: DataFrame, weight: tuple[float, float], share: float) -> float:
    """Between the last s below the quantile and the next, over all rows of s and y, each of the weight of its class.

    The interval that holds it is divided until few rows are left in it: counts of bins reach the driver, no rows but those.
    """
    share -= 1e-9
    low, high, below = *scored.agg(F.min("s"), F.max("s")).first(), 0.0
    mass = F.sum(F.when(F.col("y") == 1, weight[1]).otherwise(weight[0]))
    while True:
        rows = scored.where(F.col("s").between(low, high))
        if low == high or rows.count() <= NEAR:
            break
        place = F.least(F.floor((F.col("s") - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        bins = rows.groupBy(place.alias("bin")).agg(mass.alias("mass"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("bin").collect()
        if len(bins) == 1:
            break
        for b in bins:
            low, high = b["low"], b["high"]
            if below + b["mass"] >= share:
                break
            below += b["mass"]
        else:
            below -= bins[-1]["mass"]
    for r in rows.groupBy("s").agg(mass.alias("mass"), F.count("*").alias("n")).orderBy("s").collect():
        at = r["s"]
        below += r["mass"]
        if below >= share:
            break
    if r["n"] > 1 and below - min(weight) >= share:
        return at
    other = scored.where(F.col("s") > at).agg(F.min("s")).first()[0]
    if other is None:
        other = scored.where(F.col("s") < at).agg(F.max("s")).first()[0]
    return at if other is None else (at + other) / 2


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learned from every row with a label to learn from; `learn` may use the column `id` only."""
    steps = Steps(docs.sparkSession, "quality")
    marks = label_rows(labels, "quality", learn)
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    rows = learned(docs, marks, steps, id_col, text_col)
    centre, scale, n_bad, n_good = scaling(rows, 1 - share)
    if not n_bad or not n_good:
        even = np.log((share + 1e-3) / (1 - share + 1e-3)) - np.log(THRESHOLD / (1 - THRESHOLD))
        steps.end()
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), float(-even), 1.0)
    model = Model(centre, scale, weights_of(pairs_of(rows, n_bad, n_good, centre, scale, steps)), 0.0, 1.0)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(model.raw(_arrays(batch, "x")))], names=["y", "s"])

    scored = steps.keep(rows.mapInArrow(raw, "y int, s double"), "scored")
    cut = quantile(scored, ((1 - share) / n_bad, share / n_good), 1 - share)
    steps.end()
    return model._replace(cut=float(cut))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(None)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(batch.column(1))))], names=["doc_id", "score"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, score double")
