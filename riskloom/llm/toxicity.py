"""Toxicity by subword bags: embeddings of character n-grams averaged into a linear softmax, trained jointly in numpy.

A word, lower-cased in A-Z and set in < and >, gives its n-grams of 3 to 5 bytes and itself, each hashed to one of
BUCKETS vectors. A passage of SPAN words is the mean of all its vectors; a softmax over two classes reads it. One begins at
each word that SPAN - 1 words follow, so it does not matter where in a text a phrase stands; a shorter text is one passage.
A text is as toxic as its most toxic passage, so a few bad words weigh the same in a short and in a very long text. Vectors and
softmax are trained together by Adam: on the means of whole texts first, then on each text's leading passage. An
unseen misspelling shares most of its n-grams' vectors with the words it comes from.

Training takes at most SAMPLE texts of each class (see labels.labelled_sample) on the driver; every text is scored,
whole. A text without words has no bag; it scores the share of toxic labels, as does each text if there are labels of
one class only, or none. Null texts count as empty. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import give_back, remembered
from riskloom.llm.labels import fold, labelled_sample
from riskloom.llm.words import chunks, mixed

BUCKETS, DIM, SIZES, SPAN = 1 << 16, 8, (3, 4, 5), 3
#: Labelled texts of each class to learn from, at most.
SAMPLE = 1000
#: Steps on whole texts, then on leading passages; learning rate; weight decay.
WARM, STEPS, RATE, DECAY = 25, 45, 0.05, 1e-5
#: Score from which a document counts as toxic.
THRESHOLD = 0.7

#: Distinct words whose n-grams are gathered at a time in training.
_BLOCK = 1 << 14
_VALUES = np.random.default_rng(5).integers(0, 2**63, (max(SIZES), 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Bags(NamedTuple):
    buckets: np.ndarray  # of all n-grams, word after word
    first: np.ndarray  # index of each word's first n-gram, and their number
    word: np.ndarray  # 64-bit hash of each word
    row: np.ndarray  # text of each word
    passage: np.ndarray  # index of each passage's first word
    words: np.ndarray  # of each passage


def bags(texts: pa.Array) -> Iterator[tuple[range, Bags]]:
    """n-grams, words and passages of some texts at a time."""
    for chunk in chunks(texts, lower=True, most=1 << 18):  # an n-gram takes some 60 bytes while it is counted
        sizes = chunk.ends - chunk.starts + 2
        begin = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        word = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(total) - begin[word]
        letters = np.empty(total, dtype=np.uint8)
        inner = (place > 0) & (place < sizes[word] - 1)
        letters[place == 0], letters[place == sizes[word] - 1] = ord("<"), ord(">")
        letters[inner] = chunk.data[(chunk.starts[word] + place - 1)[inner]]
        room = sizes[word] - place  # bytes from here to the word's end
        found, owner = [], []
        h = np.zeros(total, dtype=np.uint64)
        for n in range(1, min(max(SIZES), total) + 1):
            h[: total - n + 1] += _VALUES[n - 1][letters[n - 1 :]]
            if n in SIZES:
                at = np.flatnonzero(room >= n)
                found.append((mixed(h[at] + np.uint64(n)) >> np.uint64(48)).astype(np.int32))
                owner.append(word[at])
        whole = np.empty(0, np.uint64)
        if total:
            whole = mixed(np.add.reduceat(_VALUES[0][letters] * ((place.astype(np.uint64) << np.uint64(1)) + np.uint64(1)), begin))
        found.append((whole >> np.uint64(48)).astype(np.int32))
        owner.append(np.arange(len(sizes)))
        ids, of_word = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(of_word, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(of_word, minlength=len(sizes)))])
        n = np.diff(chunk.first)  # words of each text
        row = np.repeat(np.arange(len(n)), n)
        left = np.repeat(chunk.first[1:], n) - np.arange(len(sizes))  # words from here to the text's end
        passage = np.flatnonzero((left >= SPAN) | (left == n[row]))
        yield chunk.rows, Bags(ids[order], first, whole, row, passage, np.minimum(left[passage], SPAN))


def over_passages(of_words: np.ndarray, passage: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sums over each passage's words."""
    out = of_words[passage].astype(np.float64)
    for k in range(1, SPAN):
        has = words > k
        out[has] += of_words[passage[has] + k]
    return out


def over_words(of_passages: np.ndarray, passage: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Sums over the passages that hold each of n words."""
    out = np.zeros(n)
    for k in range(SPAN):
        has = words > k
        out[passage[has] + k] += of_passages[has]  # no two passages begin at one word
    return out


class Model(NamedTuple):
    vectors: np.ndarray  # BUCKETS x DIM
    softmax: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def logits(self) -> tuple[np.ndarray, float]:
        """What each n-gram adds to the difference of the two classes, and the difference of an empty bag.

        The softmax is linear in the bag and the bag in its vectors, so passages can be scored by one number an n-gram.
        """
        return (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def passage_logits(bag: Bags, gram: np.ndarray, bias: float) -> np.ndarray:
    if not len(bag.passage):
        return np.empty(0)
    sums = np.add.reduceat(gram[bag.buckets].astype(np.float64), bag.first[:-1])
    return over_passages(sums, bag.passage, bag.words) / over_passages(np.diff(bag.first), bag.passage, bag.words) + bias


def _picked(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `at` of values, one after the other, and their sizes."""
    n = sizes[at]
    out, filled = np.empty(int(n.sum()), dtype=values.dtype), 0
    for a in range(0, len(at), _BLOCK):
        some, m = at[a : a + _BLOCK], n[a : a + _BLOCK]
        total = int(m.sum())
        out[filled : filled + total] = values[np.arange(total) + np.repeat(starts[some] - (np.cumsum(m) - m), m)]
        filled += total
    return out, n


def train(texts: list[str], labels: list[int], seed: int = 0) -> Model:
    """Vectors and softmax from labelled texts, by full-batch Adam on a loss that weighs both classes alike.

    A bag is linear in its words, so each distinct word's n-grams are summed once a step.
    """
    rng = np.random.default_rng(seed)
    parts, n = [], 0
    for span, bag in bags(pa.array(texts, pa.large_string())):
        word, at, of = np.unique(bag.word, return_index=True, return_inverse=True)  # each distinct word's n-grams once
        parts.append((word, *_picked(bag.buckets, bag.first[:-1], np.diff(bag.first), at), of.astype(np.int32), bag.passage + n, bag.words, bag.row + span.start))
        n += len(bag.word)
    words, grams, sizes, of, passages, lengths, rows = (list(x) for x in zip(*parts))
    row, passage, length = np.concatenate(rows), np.concatenate(passages), np.concatenate(lengths)
    _, at, same = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
    offsets = np.cumsum([0] + [len(w) for w in words])
    of = np.concatenate([same[start + o] for start, o in zip(offsets, of)]).astype(np.int32)
    sizes = np.concatenate(sizes)
    ids, sizes = _picked(np.concatenate(grams), np.cumsum(sizes) - sizes, sizes, at)
    begin = np.cumsum(sizes) - sizes
    del parts, words, grams, passages, rows
    blocks = [slice(a, min(a + _BLOCK, len(sizes))) for a in range(0, len(sizes), _BLOCK)]
    grams_of = [ids[begin[b.start] : begin[b.stop - 1] + sizes[b.stop - 1]] for b in blocks]

    def word_sums(gram: np.ndarray) -> np.ndarray:
        return np.concatenate([np.add.reduceat(gram[g], begin[b] - begin[b.start]) for b, g in zip(blocks, grams_of)])

    size = sizes[of]
    counts = over_passages(size, passage, length)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))  # word of each text, and text of each word and passage
    text = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
    whose = text[passage]
    lead = np.searchsorted(passage, first)  # the first passage of each text
    y = np.array(labels)[row[first]]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    total = np.bincount(text, weights=size)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM))
    softmax = rng.normal(0, 0.5, (DIM, 2))
    bias = np.zeros(2)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, softmax, bias)]
    for step in range(1, WARM + STEPS + 1):
        d = softmax[:, 1] - softmax[:, 0]
        sums = word_sums(vectors @ d)[of]
        if step <= WARM:
            logit = np.bincount(text, weights=sums) / total + bias[1] - bias[0]
            error = weight * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y)
            share = (error / total)[text]  # of each word in the loss's slope
        else:
            each = over_passages(sums, passage, length) / counts
            best = np.flatnonzero(each == np.maximum.reduceat(each, lead)[whose])
            top = best[np.append(True, np.diff(whose[best]) > 0)]  # the leading passage of each text
            error = weight * (1 / (1 + np.exp(-np.clip(each[top] + bias[1] - bias[0], -40, 40))) - y)
            leading = np.zeros(len(passage))
            leading[top] = error / counts[top]
            share = over_words(leading, passage, length, len(of))
        slope = np.bincount(of, weights=share, minlength=len(sizes))
        g = np.zeros(BUCKETS)
        for b, grams in zip(blocks, grams_of):
            g += np.bincount(grams, weights=np.repeat(slope[b], sizes[b]), minlength=BUCKETS)
        toward = vectors.T @ g
        grads = [np.outer(g, d) + DECAY * vectors, np.stack([-toward, toward], axis=1) + DECAY * softmax, np.array([-error.sum(), error.sum()])]
        for p, grad, (m, v) in zip((vectors, softmax, bias), grads, state):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    # THRESHOLD is put in the middle of the widest range of cuts that part the two classes best.
    each = over_passages(word_sums(vectors @ (softmax[:, 1] - softmax[:, 0]))[of], passage, length) / counts
    bias[1] += np.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(np.maximum.reduceat(each, lead), y) - (bias[1] - bias[0])
    return Model(vectors, softmax, bias)


def best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """A cut with the greatest share of both classes on their sides, in the middle of the widest such gap."""
    order = np.argsort(score, kind="stable")
    s, good = score[order], y[order]
    balance = np.cumsum(good == 0)[:-1] / max(1, (y == 0).sum()) + (good[::-1] == 1).cumsum()[::-1][1:] / max(1, (y == 1).sum())
    gaps = np.where(balance >= balance.max() - 1e-12, np.diff(s), -1.0)
    at = int(np.argmax(gaps))
    return float((s[at] + s[at + 1]) / 2)


class Scorer(NamedTuple):
    """All that a task needs: what each n-gram adds, the bias, and the logit of a text without words."""

    gram: np.ndarray
    bias: float
    prior: float


def text_scores(texts: pa.Array, scorer: Scorer) -> np.ndarray:
    """The probability of class 1 of each text's leading passage."""
    gram, bias, prior = scorer
    out = np.full(len(texts), prior)
    for span, bag in bags(texts):
        if len(bag.row):
            top = np.full(len(span), -np.inf)
            np.maximum.at(top, bag.row[bag.passage], passage_logits(bag, gram, bias))
            some = np.isfinite(top)
            out[span.start : span.stop][some] = top[some]
    return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    sample, counts = labelled_sample(docs, labels, "toxic", learn, most, id_col, text_col)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if len({y for text, y in sample if text.strip()}) < 2:
        return Scorer(np.zeros(BUCKETS, dtype=np.float32), prior, prior)
    sample = [(text, y) for text, y in sample if text.strip(" \t\n\x0b\x0c\r")]
    scorer = Scorer(*train([t for t, _ in sample], [y for _, y in sample]).logits(), prior)
    give_back()
    return scorer


def score_documents(docs: DataFrame, model: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row. The model, a number for each bucket, goes along with the tasks."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(None)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_scores(batch.column(1), model))], names=["doc_id", "score"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score threshold or more; rows keep all their columns. Learns from folds 0 and 2."""
    model = fit(docs, labels, fold("id", 3) != 1, id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(None)
        for batch in batches:
            yield batch.filter(pa.array(text_scores(batch.column(at).cast(pa.string()), model) < threshold))

    return docs.mapInArrow(run, docs.schema)
