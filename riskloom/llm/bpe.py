"""BPE encoding and decoding with a pair occurrence index.

A batch of distinct pieces is merged at once: its symbols lie in one list with links to their neighbours, an index maps
each adjacent pair to all its places, and pairs that the merges know wait in a heap by rank. The pair of the lowest
active rank is merged at all its places, left to right; the pairs it forms and ends enter and leave the index. Since a
merge touches one piece only, each piece sees its own merges in the order it would alone.

Texts are whole, null counts as empty; an empty text has no tokens. Texts are split as the vocabulary's file says:
first at its added tokens, then by the byte-level pattern, with white space as Unicode has it. Vocabulary files of byte-
level BPE without normaliser, dropout or prefix space are supported, others raise ValueError when loaded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import remembered

# Unicode's white space, and the pattern that parts text before byte-level merges.
SPACE = r"\t-\r \x85\xA0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Pieces whose tokens a worker remembers, pieces merged at once, and the longest piece remembered.
REMEMBERED, AT_ONCE, SHORT = 600_000, 20_000, 64
#: Bits of a token id within a pair.
_WIDE = 24


def byte_letters() -> dict[str, int]:
    """The letters byte-level vocabularies write bytes in: printable Latin-1 as itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary {odd}")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens with conditions")
        letters = byte_letters()
        ids = model["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.of_byte = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int64)
        # By rank: left, right and merged token; a pair as one number leads to its rank.
        self.ranks: list[tuple[int, int, int]] = []
        self.rank_of: dict[int, int] = {}
        for pair in model["merges"]:
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            if self.rank_of.setdefault(ids[x] << _WIDE | ids[y], len(self.ranks)) == len(self.ranks):
                self.ranks.append((ids[x], ids[y], ids[x + y]))
        self.codes = np.array(sorted(self.rank_of), dtype=np.int64)
        self.pieces = regex.compile(PIECES).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Tokens of each piece, as little-endian 32-bit numbers. Pieces must not be empty."""
        ranks, rank_of = self.ranks, self.rank_of
        first_symbols = self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ends = np.cumsum([len(p) for p in pieces])
        n = len(first_symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        # The index at the start: all places of each pair that has a rank.
        pair = np.where(after[:-1] >= 0, first_symbols[:-1] << _WIDE | first_symbols[1:], -1)
        nearest = np.minimum(np.searchsorted(self.codes, pair), len(self.codes) - 1)
        places = np.flatnonzero(self.codes[nearest] == pair)
        places = places[np.argsort(pair[places], kind="stable")]
        cuts = np.flatnonzero(np.diff(pair[places])) + 1
        index = {rank_of[int(pair[some[0]])]: some.tolist() for some in np.split(places, cuts) if len(some)}
        symbol, after, before = first_symbols.tolist(), after.tolist(), before.tolist()
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right, token = ranks[rank]
            fresh: dict[int, list[int]] = {}
            for i in sorted(index.pop(rank)):
                j = after[i]
                if j < 0 or symbol[i] != left or symbol[j] != right:
                    continue  # an earlier merge has taken one of the two
                symbol[i], symbol[j] = token, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    new = rank_of.get(token << _WIDE | symbol[k])
                    if new is not None:
                        fresh.setdefault(new, []).append(i)
                h = before[i]
                if h >= 0:
                    new = rank_of.get(symbol[h] << _WIDE | token)
                    if new is not None:
                        fresh.setdefault(new, []).append(h)
            for new, found in fresh.items():
                if new in index:
                    index[new] += found
                else:
                    index[new] = found
                    heapq.heappush(active, new)
        merged = np.array(symbol, dtype=np.int64)
        tokens = merged[merged >= 0].astype("<u4").tobytes()
        upto = (4 * np.cumsum(merged >= 0)[ends - 1]).tolist()
        return [tokens[x:y] for x, y in zip([0, *upto], upto)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memory:
    """Values by key, of which those used lately stay: when a generation is full it becomes the older one."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most // 2, {}, {}

    def absent(self, keys: set) -> list:
        """Keys without a value; the others' values are in `young` from now on, until the next call."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for k in keys.difference(young):
            if k in old:
                young[k] = old[k]
            else:
                out.append(k)
        return out


class Encoder:
    """Tokens of texts; pieces met before are looked up."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.memory = Memory(REMEMBERED)

    def parts(self, text: str) -> list[list[str] | int]:
        """Pieces of each stretch of text, and the added tokens' ids between them."""
        vocab = self.vocab
        if vocab.specials is None or not any(t in text for t in vocab.added):
            return [vocab.pieces(text)]
        return [vocab.added[part] if i % 2 else vocab.pieces(part) for i, part in enumerate(vocab.specials.split(text))]

    def encode(self, texts: list[str]) -> list[bytes]:
        parted = [self.parts(t) for t in texts]
        missing = self.memory.absent(set().union(*[p for parts in parted for p in parts if not isinstance(p, int)]))
        brief: dict[str, bytes] = {}
        for a in range(0, len(missing), AT_ONCE):
            some = missing[a : a + AT_ONCE]
            brief.update(zip(some, self.vocab.merge([p.encode() for p in some])))
        known = self.memory.young
        known.update((p, t) for p, t in brief.items() if len(p) <= SHORT)
        long = {p: t for p, t in brief.items() if len(p) > SHORT}
        value = (lambda p: known[p] if p in known else long[p]) if long else known.__getitem__
        return [
            b"".join([p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(value, p)) for p in parts])
            for parts in parted
        ]


#: Characters of text encoded at a time.
_BATCH = 1 << 20


def encoded(texts: list[str | None], encoder: Encoder) -> Iterator[tuple[int, bytes]]:
    """Row and tokens of each text, some texts at a time."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= _BATCH):
            size += len(texts[j] or "")
            j += 1
        yield from zip(range(i, j), encoder.encode([t or "" for t in texts[i:j]]))
        i = j


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """doc_id and n_tokens of each row; ids, decoded text, or in their place both digests (SHA-256, lowercase hex)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered(("bpe", vocabulary_path), lambda: Encoder(Vocabulary(vocabulary_path)))
        for batch in batches:
            rows, counts, tokens, decoded, sums = [], [], [], [], []

            def batch_of() -> pa.RecordBatch:
                columns = {"doc_id": batch.column(0).take(pa.array(rows, pa.int64())), "n_tokens": pa.array(counts, pa.int64())}
                if ids:
                    columns |= {"ids": pa.array(tokens, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
                if digests:
                    columns |= {"ids_sha256": pa.array([s[0] for s in sums], pa.string()), "decoded_sha256": pa.array([s[1] for s in sums], pa.string())}
                return pa.RecordBatch.from_pydict(columns)

            size = 0
            for row, packed in encoded(batch.column(1).to_pylist(), encoder):
                found = np.frombuffer(packed, dtype="<u4")
                text = encoder.vocab.decode(found.tolist())
                rows.append(row)
                counts.append(len(found))
                if ids:
                    tokens.append(found.astype(np.int32))
                    decoded.append(text)
                if digests:
                    sums.append((hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                size += len(found)
                if size > 1 << 20:
                    yield batch_of()
                    rows, counts, tokens, decoded, sums, size = [], [], [], [], [], 0
            if rows:
                yield batch_of()

    schema = f"doc_id {kind}, n_tokens long" + ", ids array<int>, decoded string" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode_documents(tokens: DataFrame, vocabulary_path: str, ids_col: str = "ids") -> DataFrame:
    """tokens with a column decoded; null ids give null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def decode(column):
        vocab = vocabulary(vocabulary_path)
        return column.map(lambda ids: None if ids is None else vocab.decode(list(ids)))

    return tokens.withColumn("decoded", decode(ids_col))
