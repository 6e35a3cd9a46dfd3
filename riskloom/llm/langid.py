"""Languages of texts by a mixture over their words.

Training counts hashed trigrams of bytes (a word with a space on each side) for every language, over all rows to learn
from: tasks count, Spark adds up. At most LANGUAGES languages are learned, those with the most rows, then by name; the
model is a table of LANGUAGES * GRAMS numbers at most, whatever the corpus.

A word's likelihood in a language is that of its trigrams. A text is a mixture: expectation-maximisation estimates the
share of its words in each language. The sets of the first 1, 2, 3, ... languages by share are estimated anew in turn,
as long as the likelihood, less half the logarithm of the number of words for each further language, grows. The last
set that gained is the text's languages, that of the greatest share its language, and the share the score.

A text that is null or without a letter is `und` with score 0 and no languages; so is any text if nothing was learned.
Texts are taken whole. Rows are scored one by one and whatever stands beside them, so repeated rows and null ids give
rows of their own. An empty table gives an empty result.
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

UNKNOWN = "und"
#: Languages learned at most, and hash values of trigrams.
LANGUAGES, GRAMS = 100, 1 << 16
#: Steps of expectation-maximisation, what is added to each count, and bytes of texts worked on at a time.
TURNS, ADDED, CHUNK = 8, 0.1, 1 << 18


class Model(NamedTuple):
    languages: list[str]
    loglik: np.ndarray  # GRAMS rows, a column for each language


def grams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the trigram around each byte of a word, and the place of each word's first among them."""
    sizes = chunk.ends - chunk.starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) + np.repeat(chunk.starts - first, sizes)
    data = chunk.data.astype(np.uint32)
    here = data[place]
    before, behind = np.full_like(here, 32), np.full_like(here, 32)
    before[1:], behind[:-1] = here[:-1], here[1:]
    before[first], behind[first[1:] - 1] = 32, 32
    code = (before << 16) | (here << 8) | behind
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), first


def _counted(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(None)
        place = {name: i for i, name in enumerate(languages)}
        counts = np.zeros((len(languages), GRAMS), dtype=np.int64)
        for batch in batches:
            own = np.array([place[name] for name in batch.column(0).to_pylist()], dtype=np.int64)
            for chunk in chunks(batch.column(1), most=CHUNK):
                if len(chunk.starts):
                    sizes = chunk.ends - chunk.starts
                    of_row = np.repeat(np.repeat(own[chunk.rows.start : chunk.rows.stop], np.diff(chunk.first)), sizes)
                    np.add.at(counts.reshape(-1), of_row * GRAMS + grams(chunk)[0], 1)
        lang, gram = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(gram, pa.int32()), pa.array(counts[lang, gram], pa.int64())], names=["lang", "gram", "n"])

    return run


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", languages: int = LANGUAGES) -> Model:
    """Trigram likelihoods of the languages of the rows where learn holds; learn may use any column of docs."""
    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.lower(F.col(text_col)).alias("text")).where("text is not null")
    ordered = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    names = sorted(r["lang"] for r in ordered)
    counts = np.zeros((len(names), GRAMS))
    if names:
        found = rows.where(F.col("lang").isin(names)).mapInArrow(_counted(names), "lang int, gram int, n long")
        summed = found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # languages * GRAMS rows at most
        counts[summed["lang"].to_numpy(), summed["gram"].to_numpy()] = summed["n"].to_numpy()
    share = (counts + ADDED) / (counts.sum(axis=1, keepdims=True) + ADDED * GRAMS)
    return Model(names, np.ascontiguousarray(np.log(share).T.astype(np.float32)))


class Words(NamedTuple):
    """Words of some texts: their likelihood in each language relative to the best, the log of that, and where texts begin."""

    relative: np.ndarray
    best: np.ndarray
    first: np.ndarray
    n: np.ndarray

    def of(self, texts: np.ndarray) -> Words:
        """Only some of the texts, by a mask."""
        words = np.repeat(texts, self.n)
        n = self.n[texts]
        return Words(self.relative[words], self.best[words], np.cumsum(n) - n, n)


def mixture(words: Words, allowed: np.ndarray, turns: int = TURNS) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the allowed languages in each text, and the log-likelihood of its words."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for turn in range(turns + 1):
        joint = words.relative * np.repeat(share, words.n, axis=0)
        whole = joint.sum(axis=1)
        if turn == turns:
            return share, np.add.reduceat(np.log(np.maximum(whole, 1e-300)) + words.best, words.first)
        joint /= np.maximum(whole, 1e-300)[:, None]
        share = np.add.reduceat(joint, words.first, axis=0) / words.n[:, None]


def proportions(words: Words) -> np.ndarray:
    """Shares of the selected languages in each text."""
    n_texts, n_langs = len(words.n), words.relative.shape[1]
    if n_langs == 1:
        return np.ones((n_texts, 1))
    every, _ = mixture(words, np.ones((n_texts, n_langs)))
    order = np.argsort(-every, axis=1, kind="stable")
    alone = np.add.reduceat(np.log(np.maximum(words.relative, 1e-300)) + words.best[:, None], words.first, axis=0)
    single = alone.argmax(axis=1)
    chosen = np.eye(n_langs)[single]
    reached = alone.max(axis=1)
    open_texts, allowed = np.arange(n_texts), np.zeros((n_texts, n_langs))
    allowed[open_texts, order[:, 0]] = 1
    left = words
    for k in range(1, n_langs):
        allowed[open_texts, order[open_texts, k]] = 1
        share, loglik = mixture(left, allowed[open_texts])
        loglik = loglik - k * 0.5 * np.log(left.n)
        better = loglik > reached[open_texts]
        if not better.any():
            break
        chosen[open_texts[better]], reached[open_texts[better]] = share[better], loglik[better]
        open_texts, left = open_texts[better], left.of(better)
    return chosen


def shares(chunk: Chunk, loglik: np.ndarray) -> np.ndarray:
    """Shares of the languages in each text of a chunk; zeros for a text without words."""
    out = np.zeros((len(chunk.rows), loglik.shape[1]))
    if not len(chunk.starts):
        return out
    codes, first = grams(chunk)
    by_word = np.add.reduceat(loglik[codes], first, axis=0).astype(np.float64)
    best = by_word.max(axis=1)
    n = np.diff(chunk.first)
    has = n > 0
    out[has] = proportions(Words(np.exp(by_word - best[:, None]), best, chunk.first[:-1][has], n[has]))
    return out


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(None)
        names = np.array(model.languages, dtype=object)
        for batch in batches:
            lettered = np.array(batch.column(2).to_pylist(), dtype=bool)
            for chunk in chunks(batch.column(1), most=CHUNK):
                rows = slice(chunk.rows.start, chunk.rows.stop)
                known = lettered[rows] & bool(model.languages)
                found = shares(chunk, model.loglik) if model.languages else np.zeros((len(chunk.rows), 1))
                top = found.argmax(axis=1)
                pred = [names[t] if k else UNKNOWN for t, k in zip(top, known)]
                score = np.where(known, np.minimum(found.max(axis=1), 1.0), 0.0)
                listed = [[{"lang": names[i], "share": float(row[i])} for i in np.flatnonzero(row)] if k else [] for row, k in zip(found, known)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[rows], pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                        pa.array(listed, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                    ],
                    names=["doc_id", "lang_pred", "score", "languages"],
                )

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and languages (lang and share of each selected one) of every row."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(text).alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scored(model), f"doc_id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
