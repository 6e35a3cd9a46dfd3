"""Best-fit packing of documents into sequences of a fixed length, with hierarchical residual packing.

Tasks tokenize their part of the documents and pack it by best fit, longest piece first. Bins that are nearly full are
emitted; each underfull bin is an item of the next round, with all pieces in it. A round deals the items out anew to
fewer tasks, ITEMS or less to each, and packs them by best fit again, until one task holds all of them or a round
saves less than one in GAIN of its bins. The bins that are left then are sequences as well.

A document's tokens are those of a Hugging Face vocabulary file without special tokens, then id 0. Longer documents
are cut into pieces of the full length, the last may be shorter. Null and empty texts are the id 0 alone. Rows of one id
are packed as rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bpe import Memory
from riskloom.llm.common import Steps, remembered
from riskloom.llm.words import LOWER, SOLID, Chunk, chunks

LENGTH = 2048
#: A bin of which less than this share is free is emitted at once.
NEARLY = 1 / 256
#: Items a task packs at a time, and the share of bins a round must save to be followed by another.
ITEMS, GAIN = 50_000, 200
#: Words whose tokens a worker remembers; a longer word is not remembered.
REMEMBERED, SHORT = 800_000, 64
#: Marks that are tokens of their own behind a letter or digit.
_MARK, _ALNUM = (np.array([bytes([b]) in some for b in range(256)]) for some in ((b".", b","), [bytes([b]) for b in range(128) if bytes([b]).isalnum()]))
#: Bytes of text whose words are told apart at a time.
TEXT = 1 << 22
_AT_ONCE = 1 << 18
#: The id that ends a document.
END = (0).to_bytes(4, "little")


def best_fit(sizes: list[int], length: int) -> list[int]:
    """The bin of each item: longest first, each into the fullest bin that holds it."""
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]  # by free room
    rooms = 0  # bit r: some bin has r free
    placed, bins = [0] * len(sizes), 0
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        if fits := rooms >> size << size:
            room = (fits & -fits).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, chosen, bins = length, bins, bins + 1
        placed[item] = chosen
        if room := room - size:
            open_bins[room].append(chosen)
            rooms |= 1 << room
    return placed


def folded(chunk: Chunk) -> np.ndarray:
    """The chunk's bytes in lower case where that leaves the tokens of their words as they are; fewer words are distinct then.

    Words stay as written in which a capital stands before a byte beyond ASCII (NFC may join it to what follows otherwise
    than its small letter), and in which `<|` stands: the vocabulary's own marks stand for themselves in the raw text.
    """
    data = chunk.data
    lower = LOWER[data]
    cased = (lower[:-1] != data[:-1]) & (data[1:] >= 128)
    marked = (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    for w in np.unique(np.searchsorted(chunk.starts, np.flatnonzero(cased | marked), side="right") - 1).tolist():
        if w >= 0:
            word = slice(chunk.starts[w], chunk.ends[w])
            lower[word] = data[word]
    return lower


def distinct(chunk: Chunk) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of a chunk, for each of its words which one it is, and where each text's words begin.

    A point or comma behind a word's last letter or digit is a word of its own here: the vocabulary splits there too, so
    the tokens are the same and fewer words are distinct.
    """
    data, sizes = folded(chunk), chunk.ends - chunk.starts
    last = chunk.ends - 1
    marked = _MARK[data[last]] & _ALNUM[data[last - 1]] & (sizes > 1)
    parts = 1 + marked
    sizes = np.repeat(sizes, parts)
    ends = np.cumsum(parts)
    sizes[ends[marked] - 2] -= 1
    sizes[ends[marked] - 1] = 1
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(data[SOLID[chunk.data]])]).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy(), np.concatenate([[0], ends])[chunk.first]


class WordTokens:
    """Token ids of texts, word by word.

    The vocabulary's normaliser and splits end at white space, so the tokens of a text are those of its words one after
    the other; a word met before is looked up. Words not met before are tokenized together, as texts of some words, and
    told apart by the places the tokenizer gives.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memory = Memory(REMEMBERED)

    def tokenized(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each word with its ids, as little-endian 32-bit numbers."""
        for a in range(0, len(words), 64 * 256):
            groups = [words[b : b + 64] for b in range(a, min(a + 64 * 256, len(words)), 64)]
            texts = [[w.decode() for w in group] for group in groups]
            for group, text, found in zip(groups, texts, self.tokenizer.encode_batch([" ".join(t) for t in texts], add_special_tokens=False)):
                begins = np.cumsum([0] + [len(w) + 1 for w in text])
                packed = np.array(found.ids, dtype="<u4").tobytes()
                cuts = (4 * np.searchsorted([o[0] for o in found.offsets], begins)).tolist()
                yield from zip(group, [packed[x:y] for x, y in zip(cuts, cuts[1:])])

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of some different words; a very long word is not remembered beyond its batch."""
        absent = self.memory.absent(set(words))
        known = self.memory.young
        known.update(self.tokenized(absent))
        out = list(map(known.__getitem__, words))
        for w in [w for w in absent if len(w) > SHORT]:
            del known[w]
        return out

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text and id 0; a null text counts as empty."""
        for chunk in chunks(texts, most=TEXT):
            if not len(chunk.starts):
                yield from [END] * len(chunk.rows)
                continue
            words, which, first = distinct(chunk)
            of_word = self.of_words(words)
            sizes = np.fromiter(map(len, of_word), dtype=np.int64, count=len(words)) // 4
            tokens, begins = np.frombuffer(b"".join(of_word), dtype="<u4"), np.cumsum(sizes) - sizes
            # Ends of texts in tokens; then the texts' tokens, some words at a time.
            ends = np.concatenate([[0], np.cumsum(sizes[which])])[first].tolist()
            out = np.empty(ends[-1], dtype="<u4")
            filled = 0
            for a in range(0, len(which), _AT_ONCE):
                some = which[a : a + _AT_ONCE]
                n = sizes[some]
                total = int(n.sum())
                out[filled : filled + total] = tokens[np.arange(total) + np.repeat(begins[some] - (np.cumsum(n) - n), n)]
                filled += total
            yield from (out[x:y].tobytes() + END for x, y in zip(ends, ends[1:]))


def _struct(kind: str) -> str:
    return f"struct<doc_id:{kind},piece:int,start:bigint,length:bigint,ids_crc32:bigint>"


def _bins(items: list[tuple[int, list]], length: int, number: int, part: int) -> Iterator[tuple[int, int, list]]:
    """Bins of items (size, pieces): id, size, pieces. Ids count on from number within part."""
    placed = best_fit([i[0] for i in items], length)
    bins: dict[int, tuple[int, list]] = {}
    for (size, pieces), b in zip(items, placed):
        had = bins.get(b)
        bins[b] = (size, list(pieces)) if had is None else (had[0] + size, had[1] + list(pieces))
    for k, (size, pieces) in enumerate(bins.values()):
        yield (part << 36) + number + k, size, pieces


def _table(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    """Rows of bin, size, pieces."""
    flat = [p for _, _, pieces in rows for p in pieces]
    piece = pa.StructArray.from_arrays(
        [pa.array([p[0] for p in flat], kind)] + [pa.array([p[i] for p in flat], t) for i, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64()))],
        names=["doc_id", "piece", "start", "length", "ids_crc32"],
    )
    offsets = np.cumsum([0] + [len(pieces) for _, _, pieces in rows])
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), piece)],
        names=["bin", "size", "pieces"],
    )


def _first_round(path: str, length: int, items_at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = remembered(("words", path), lambda: WordTokens(path))
        part, number = TaskContext.get().partitionId(), 0
        items: list[tuple[int, list]] = []
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, all_ids in zip(batch.column(0).to_pylist(), tokens.ids(batch.column(1))):
                for piece, start in enumerate(range(0, len(all_ids) // 4, length)):
                    cut = all_ids[4 * start : 4 * (start + length)]
                    items.append((len(cut) // 4, [(doc, piece, start, len(cut) // 4, zlib.crc32(cut))]))
                while len(items) >= items_at_once:
                    rows = list(_bins(items[:items_at_once], length, number, part))
                    number, items = number + len(rows), items[items_at_once:]
                    yield _table(rows, kind)
        if items:
            yield _table(list(_bins(items, length, number, part)), kind)

    return run


def _next_round(length: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, items, kind = (turn << 20) + TaskContext.get().partitionId(), [], None
        for batch in batches:
            kind = batch.schema.field(2).type.value_type.field(0).type
            for _, size, pieces in zip(*(c.to_pylist() for c in batch.columns)):
                items.append((size, [tuple(p.values()) for p in pieces]))
        if items:
            items.sort(key=lambda i: (i[0], [tuple(str(x) for x in p) for p in i[1][:1]]))  # the same bins whatever order the rows came in
            yield _table(list(_bins(items, length, 0, part)), kind)

    return run


def pack_documents(docs: DataFrame, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, items: int = ITEMS) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("word_bpe_49k.json")
    steps = Steps(docs.sparkSession, "packing")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"bin long, size long, pieces array<{_struct(kind)}>"
    full = length - max(0, int(length * NEARLY))
    packed = steps.keep(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(_first_round(vocabulary_path, length, items), schema), "round-0")
    done, turn = packed.where(F.col("size") >= full), 0
    rest = packed.where(F.col("size") < full)
    left = rest.count()
    while left > 1:
        turn += 1
        tasks = -(-left // items)
        # Dealt out by a hash of the bin: each task gets its share of every length.
        dealt = rest.repartition(tasks, F.xxhash64("bin", F.lit(turn))) if tasks > 1 else rest.coalesce(1)
        packed = steps.keep(dealt.mapInArrow(_next_round(length, turn), schema), f"round-{turn}")
        bins = packed.count()
        done = done.unionByName(packed.where(F.col("size") >= full))
        rest = packed.where(F.col("size") < full)
        if tasks == 1 or (left - bins) * GAIN < left:
            break
        left = rest.count()
    out = done.unionByName(rest)
    before = F.aggregate(F.slice("pieces", 1, F.col("place")), F.lit(0).cast("long"), lambda n, p: n + p["length"])
    return out.select("bin", "pieces", F.posexplode("pieces").alias("place", "p")).select(
        "p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", F.col("bin").alias("sequence_id"), before.alias("offset")
    )
