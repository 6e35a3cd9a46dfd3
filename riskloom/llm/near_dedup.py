"""Near-duplicate groups by SetSketch registers.

A text's set holds its distinct shingles of five words (A-Z lower-cased); with fewer words the whole sequence is its one
shingle. Texts with equal sets are one class from the start. A class has REGISTERS registers, each the truncated
logarithm to base BASE of the smallest of its shingles' exponential variates: exponentially spaced minima, merged by
taking the larger value. Registers are grouped into bands; classes that share a band's values are candidates.
From how many registers of two sketches are larger, smaller and equal, with the known sizes of both sets, the
likelihood of each similarity follows. Pairs for which 75 in 100 is beyond doubt too high are left out, all others are
verified on the full sets, and verified links become components.

No bucket is expanded into its pairs. First each member meets the bucket's hub, its best connected member. Then, where
a bucket still holds several components, members outside the largest meet all others in blocks, sketch against sketch
inside a task: once for the best partner of each, and at last for all partners that the likelihood admits. Those are
verified where they meet, and only links that join two components leave the task. So a link between classes that share
a band is missed only if the likelihood test, at a deviation beyond four standard errors, is wrong.

Buckets that still fill several pairs of blocks after their hub's links are split first, without losing a link: of the
sets of their members, two that are similar enough share one of the shingles that are rarest among all these members
(of n shingles the first n - ceil(0.75 n) + 1). Classes that share such a shingle meet under it instead, unless all those
meetings would cost more than the bucket's own. So texts that have a common frame and nothing else, however many, don't meet.

Null and empty texts, and texts without words, have no set and are linked with nothing. Rows equal in id are not told
apart in component_id and kept; drop_near_copies tells them apart. Ids may be null; they count as larger than all others. Only id and text are read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Steps, numbered, remembered, without
from riskloom.llm.components import components
from riskloom.llm.words import Hashing, chunks, mixed

SHINGLE = 5
#: At a similarity of 0.75 a pair shares no band with a probability of (1 - 0.75 ** 5) ** 51 = 1e-6.
BAND, BANDS = 5, 51
REGISTERS = 256
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1
#: Similarity of a link, in hundredths, and the loss of log-likelihood from which it is out of the question.
PERCENT, DOUBT = 75, 9.0
#: Members of a block: those outside a bucket's largest component, and those they meet.
LEFT, RIGHT = 256, 1024
#: Comparisons of sketches that cost as much as moving one.
MOVED = 50
#: Bytes of shingle sets that a task holds at once, besides the two it compares.
SETS_BYTES = 64 << 20

_HASH = Hashing(20)
_RNG = np.random.default_rng(21)
_FACTOR = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_BAND_FACTOR = _RNG.integers(0, 2**63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and distinct shingles' hashes, in order, of each text of the column."""
    for chunk in chunks(texts, lower=True):
        h = _HASH.words(chunk.data, chunk.starts, chunk.ends)
        every = _HASH.rows(h, SHINGLE)
        for row, (a, b) in zip(chunk.rows, zip(chunk.first[:-1], chunk.first[1:])):
            if b - a >= SHINGLE:
                yield row, np.unique(every[a : b - SHINGLE + 1])
            else:
                yield row, _HASH.rows(h[a:b], int(b - a), salt=int(b - a)) if b > a else every[:0]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of sets that aren't empty, a row each."""
    x = np.concatenate(sets)
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((len(sets), REGISTERS), dtype=np.uint64)
    for j in range(REGISTERS):
        v = x * _FACTOR[j]
        v += _SHIFT[j]
        v ^= v >> np.uint64(32)
        least[:, j] = np.minimum.reduceat(v, first)
    smallest = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    return _signed(int(mixed(s).sum(dtype=np.uint64))), _signed(int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    remembered(None)
    for batch in batches:
        rows, sets, size = [], [], 0
        for row, s in shingle_sets(batch.column(1)):
            rows.append(row)
            sets.append(s)
            size += len(s)
            if size > 1 << 18 or len(rows) >= 4096:
                yield _signature_batch(batch.column(0), rows, sets)
                rows, sets, size = [], [], 0
        if rows:
            yield _signature_batch(batch.column(0), rows, sets)


def _signature_batch(ids: pa.Array, rows: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    full = [s for s in sets if len(s)]
    sketches = iter(registers(full)) if full else iter(())
    prints = [fingerprint(s) for s in sets]
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(rows)), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
            pa.array([next(sketches).tobytes() if len(s) else None for s in sets], pa.binary()),
        ],
        names=["doc_id", "n", "f1", "f2", "sketch"],
    )


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    remembered(None)
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            sketches = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
            terms = (sketches[:, : BANDS * BAND].astype(np.uint64) + np.uint64(1)) * _BAND_FACTOR
            keys = mixed(mixed(terms).reshape(-1, BANDS, BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
            nodes = np.repeat(np.asarray(part.column(0)), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(nodes)], names=["key", "node"])


def possible(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether a similarity of PERCENT or more is within DOUBT of the likeliest, from the counts of registers and sizes."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    reach = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    fits = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
    step = (BASE - 1) / BASE

    def loglik(share: np.ndarray) -> np.ndarray:
        j = np.minimum(share, reach[:, None] * (1 - 1e-9))
        p = [-np.log1p(-np.clip(x, 0, 1) * step) / np.log(BASE) for x in (u[:, None] - v[:, None] * j, v[:, None] - u[:, None] * j)]
        rest = np.clip(1 - p[0] - p[1], 1e-12, 1)
        return larger[:, None] * np.log(np.clip(p[0], 1e-12, 1)) + smaller[:, None] * np.log(np.clip(p[1], 1e-12, 1)) + equal[:, None] * np.log(rest)

    least = PERCENT / 100
    low, high = loglik(np.linspace(0, least, 31)[None, :]), loglik(np.linspace(least, 1, 21)[None, :])
    return fits & (high.max(axis=1) >= np.maximum(low.max(axis=1), high.max(axis=1)) - DOUBT)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs a, b with sizes and sketches, those the likelihood admits."""
    remembered(None)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            a, b, n_a, n_b = (np.asarray(part.column(i)) for i in range(4))
            s, t = (np.frombuffer(b"".join(part.column(i).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            more, same = (s > t).sum(axis=1), (s == t).sum(axis=1)
            ok = possible(more, REGISTERS - more - same, same, n_a.astype(float), n_b.astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])


def _partners(group: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each member of the left block its place in the table, and the places of the members of the right block that
    are of other components and that the likelihood admits, the most alike first."""
    side, node, comp, n = (group[c].to_numpy() for c in ("side", "node", "comp", "n"))
    sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
    right = np.flatnonzero(side == 1)
    for x in np.flatnonzero(side == 0):
        other = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= PERCENT * np.maximum(n[right], n[x]))]
        same = (sketch[other] == sketch[x]).sum(axis=1)
        more = (sketch[x] > sketch[other]).sum(axis=1)
        ok = possible(more, REGISTERS - more - same, same, np.full(len(other), float(n[x])), n[other].astype(float)) if len(other) else other > 0
        other, same = other[ok], same[ok]
        yield int(x), other[np.lexsort((node[other], -same))], node, comp


def _pair_table(found: list[tuple[int, int]]) -> pa.Table:
    found = sorted({(min(p), max(p)) for p in found})
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def _best(group: pa.Table) -> pa.Table:
    """The most alike partner of each member of the left block."""
    return _pair_table([(int(node[x]), int(node[other[0]])) for x, other, node, _ in _partners(group) if len(other)])


def _joined(group: pa.Table) -> pa.Table:
    """Verified links between two blocks, as many as join the components that they join."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            c = up
        return c

    blobs, unpack = group["blob"], zstandard.ZstdDecompressor()
    set_of = Sets(lambda place: _set_of_blob(unpack, blobs[place]))

    found = []
    for x, other, node, comp in _partners(group):
        for y in map(int, other):
            a, b = find(int(comp[x])), find(int(comp[y]))
            if a != b and alike(set_of(x, x), set_of(y, y)):
                root[a] = b
                found.append((int(node[x]), int(node[y])))
    return _pair_table(found)


class Sets:
    """Shingle sets by key, of which the last used stay within SETS_BYTES; at least the two that are compared."""

    def __init__(self, make):
        self.make, self.held, self.size = make, OrderedDict(), 0

    def __call__(self, key: int, source) -> np.ndarray:
        if key not in self.held:
            self.held[key] = self.make(source)
            self.size += self.held[key].nbytes
        self.held.move_to_end(key)
        while self.size > SETS_BYTES and len(self.held) > 2:
            self.size -= self.held.popitem(last=False)[1].nbytes
        return self.held[key]


def alike(s: np.ndarray, t: np.ndarray) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= PERCENT * (len(s) + len(t) - both)


def _set_of_blob(unpack: zstandard.ZstdDecompressor, blob: pa.Scalar) -> np.ndarray:
    return next(shingle_sets(pa.array([unpack.decompress(blob.as_py()).decode()], pa.large_string())))[1]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint and packed text, once for each set that the partition holds."""
    remembered(None)
    pack, seen = zstandard.ZstdCompressor(level=1), set()
    for batch in batches:
        f1, f2, blobs = [], [], []
        for row, s in shingle_sets(batch.column(0)):
            if len(s) and (key := fingerprint(s)) not in seen:
                seen.add(key)
                f1.append(key[0])
                f2.append(key[1])
                blobs.append(pack.compress(batch.column(0)[row].as_py().encode()))
        yield pa.RecordBatch.from_arrays([pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(blobs, pa.binary())], names=["f1", "f2", "blob"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32 bits of each shingle of packed texts, the node, and how many of the set's rarest shingles exceed all of them.

    Shingles that share their 32 bits count once, which makes the rarest ones no fewer than are needed.
    """
    remembered(None)
    unpack = zstandard.ZstdDecompressor()

    def batch_of(nodes: list[int], parts: list[np.ndarray], over: list[int]) -> pa.RecordBatch:
        sizes = [len(p) for p in parts]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(parts).view(np.int32)), pa.array(np.repeat(nodes, sizes)), pa.array(np.repeat(over, sizes).astype(np.int32))],
            names=["shingle", "node", "over"],
        )

    for batch in batches:
        nodes, parts, over, size = [], [], [], 0
        for node, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            whole = _set_of_blob(unpack, blob)
            parts.append(np.unique((whole >> np.uint64(32)).astype(np.uint32)))
            nodes.append(node)
            over.append(len(whole) + (-PERCENT * len(whole)) // 100 + 1 - len(parts[-1]))
            size += len(parts[-1])
            if size > 1 << 18:
                yield batch_of(nodes, parts, over)
                nodes, parts, over, size = [], [], [], 0
        if nodes:
            yield batch_of(nodes, parts, over)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts, those whose full sets are similar enough."""
    remembered(None)
    unpack = zstandard.ZstdDecompressor()
    set_of = Sets(lambda blob: _set_of_blob(unpack, blob))  # a hub's pairs follow each other

    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        good = [alike(set_of(a[i], batch.column(2)[i]), set_of(b[i], batch.column(3)[i])) for i in range(batch.num_rows)]
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


class _Search:
    """One run: tables of classes, buckets and texts, and the links found so far."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, steps: Steps | None = None):
        self.steps = steps = steps or Steps(docs.sparkSession, "near-dedup")
        texts = docs.select(F.col(text_col).cast("string").alias("text"))
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        kind = rows.schema["doc_id"].dataType.simpleString()
        signed = steps.keep(rows.mapInArrow(_signatures, f"doc_id {kind}, n long, f1 long, f2 long, sketch binary"), "signatures")
        self.members = signed.select("doc_id", "n", "f1", "f2")
        # Numbers are given while the table is written and are the same for all that read it.
        self.classes = steps.keep(
            signed.where("n > 0").groupBy("f1", "f2").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")).withColumn(
                "node", F.monotonically_increasing_id()
            ),
            "classes",
        )
        banded = self.classes.select("node", "sketch").mapInArrow(_band_keys, "key long, node long")
        shared = steps.keep(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
        self.buckets = steps.keep(banded.join(shared.hint("merge"), "key"), "buckets")
        met = self.buckets.select("node").distinct().join(self.classes.select("node", "f1", "f2"), "node")
        # A text for each class that shares a bucket, packed: later steps read these alone.
        self.texts = steps.keep(
            texts.mapInArrow(_texts, "f1 long, f2 long, blob binary").join(met.hint("merge"), ["f1", "f2"]).groupBy("node").agg(F.first("blob").alias("blob")),
            "texts",
        )
        #: Key and node of those that are yet to meet; buckets of two are settled by their hub.
        self.meets = self.buckets.where("size > 2").select("key", "node")
        self.tested = None
        self.labels = steps.keep(self.buckets.select("node").distinct().withColumn("comp", F.col("node")), "labels-0")
        self.turn = 0

    def hubs(self) -> DataFrame:
        """Pairs of a bucket's members with its hub, the member whose buckets are largest in sum."""
        score = self.buckets.groupBy("node").agg(F.sum("size").alias("score"))
        ranked = self.buckets.join(score, "node")
        hub = self.steps.keep(ranked.groupBy("key").agg(F.max(F.struct("score", (-F.col("node")).alias("rev"))).alias("hub")).select("key", (-F.col("hub.rev")).alias("hub")), "hubs")
        pairs = self.buckets.join(hub.hint("merge"), "key").where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        left, right = (self.classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
        joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
        return joined.mapInArrow(_likely, "a long, b long")

    def open(self, rows: DataFrame) -> DataFrame:
        """Buckets of rows (key, node, comp) that hold several components: the largest one, and blocks on either side."""
        sums = rows.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(
            F.count("*").alias("parts"), F.sum("c").alias("total"), F.max(F.struct("c", "comp")).alias("main")
        ).where("parts > 1")
        left = F.col("total") - F.col("main.c")
        return sums.select(
            "key", F.col("main.comp").alias("main"), "total", left.alias("left"), F.ceil(left / LEFT).cast("int").alias("lefts"),
            F.ceil(F.col("total") / RIGHT).cast("int").alias("rights"),
        )

    def split(self) -> None:
        """Members of large open buckets meet under their rarest shingles, where that costs less than the bucket does."""
        keep = self.steps.keep
        cost = lambda pairs, moved: pairs + MOVED * moved
        large = keep(
            self.open(self.meets.join(self.labels, "node")).where("lefts * rights > 1").select(
                "key", cost(F.col("left") * F.col("total"), F.col("left") * F.col("rights") + F.col("total") * F.col("lefts")).alias("cost")
            ),
            "large",
        )
        if large.isEmpty():
            return
        inside = keep(self.meets.join(large, "key").select("key", "node", "cost"), "inside")
        degree = inside.groupBy("node").agg(F.count("*").alias("degree"))
        shingles = keep(
            self.texts.join(degree, "node").select("node", "blob").mapInArrow(_shingles, "shingle int, node long, over int"), "shingles"
        )
        # Those that stand in one set alone are its rarest and lead nowhere: they are counted, not moved again.
        shared = keep(shingles.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1"), "shared-shingles")
        own = Window.partitionBy("node")
        rare = keep(
            shingles.join(shared.hint("merge"), "shingle").select(
                F.col("shingle").cast("long").alias("key"), "node",
                (F.count("*").over(own) + F.col("over") - F.row_number().over(own.orderBy("c", "shingle"))).alias("rest"),
            ).where("rest >= 0").select("key", "node"),
            "rare",
        )
        self.steps.drop("shingles", "shared-shingles")
        sizes = keep(rare.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "rare-sizes")
        met = keep(rare.join(sizes.hint("merge"), "key"), "rare-met")
        each = met.groupBy("node").agg(F.sum(cost(F.col("size"), F.lit(1))).alias("each"))
        share = degree.join(each, "node", "left").select("node", (F.coalesce("each", F.lit(0)) / F.col("degree")).alias("share"))
        done = keep(inside.join(share, "node").groupBy("key").agg(F.first("cost").alias("cost"), F.sum("share").alias("sum")).where("sum < cost").select("key"), "split")
        nodes = inside.join(done, "key").select("node").distinct()
        self.meets = keep(self.meets.join(done, "key", "left_anti").unionByName(met.join(nodes, "node").select("key", "node")), "meets")

    def blocks(self) -> DataFrame:
        """Members of buckets that hold several components, dealt to pairs of blocks.

        Members outside the largest component form the left blocks, all members the right ones; a task gets one of each.
        """
        rows = self.meets.join(self.labels, "node").select("key", "node", "comp")
        split = self.steps.keep(self.open(rows).select("key", "main", "lefts", "rights"), f"open-{self.turn}")
        rows = rows.join(split.hint("merge"), "key").join(self.classes.select("node", "n", "sketch"), "node")
        place = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
        spans = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        common = ("key", "node", "comp", "n", "sketch")
        left = rows.where("comp != main").select(*common, F.lit(0).alias("side"), place("lefts").alias("i"), spans("rights").alias("j"))
        right = rows.select(*common, F.lit(1).alias("side"), spans("lefts").alias("i"), place("rights").alias("j"))
        return left.unionByName(right)

    def best_pairs(self) -> DataFrame:
        return self.blocks().groupBy("key", "i", "j").applyInArrow(_best, "a long, b long").distinct()

    def last_links(self) -> DataFrame:
        """Links between all components left, verified by the texts that come with the blocks."""
        return self.blocks().join(self.texts, "node").groupBy("key", "i", "j").applyInArrow(_joined, "a long, b long").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs, of which none is tested twice, that are links."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = self.steps.keep(pairs, f"pairs-{self.turn}")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        left, right = (self.texts.select(F.col("node").alias(x), F.col("blob").alias(f"t_{x}")) for x in "ab")
        return pairs.join(left, "a").join(right, "b").select("a", "b", "t_a", "t_b").mapInArrow(_confirm, "a long, b long")

    def join(self, links: DataFrame) -> None:
        """One component of each two that are linked."""
        comp_a, comp_b = (self.labels.select(F.col("node").alias(x), F.col("comp").alias(f"c_{x}")) for x in "ab")
        joined = links.join(comp_a, "a").join(comp_b, "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
        roots = components(joined, self.steps, f"stars-{self.turn}")
        moved = self.labels.join(roots, self.labels["comp"] == roots["node"], "left").select(
            self.labels["node"], F.coalesce(roots["root"], self.labels["comp"]).alias("comp")
        )
        self.turn += 1
        self.labels = self.steps.keep(moved, f"labels-{self.turn}")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: Steps | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links), kept of every row.

    The result reads tables of `steps`; without any they stay as long as the session.
    """
    search = _Search(docs, id_col, text_col, steps)
    search.join(search.verified(search.hubs()))
    search.split()
    search.join(search.verified(search.best_pairs()))
    search.join(search.last_links())
    placed = search.classes.select("f1", "f2", "node").join(search.labels, "node", "left").select(
        "f1", "f2", F.coalesce("comp", "node").alias("comp")
    )
    # The smallest id of a class, then of a component, both combined before they are shuffled.
    first = search.steps.keep(
        search.members.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("first")).join(placed, ["f1", "f2"]), "first"
    )
    named = search.steps.keep(
        first.join(first.groupBy("comp").agg(F.min("first").alias("component_id")), "comp").select("f1", "f2", "component_id"), "named"
    )
    full = search.members.where("n > 0").join(named.hint("merge"), ["f1", "f2"]).select("doc_id", "n", "component_id")
    none = search.members.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.unionByName(none).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest id (nulls last). Rows keep all their columns.

    Rows are told apart by a number of their own: ids may be null or repeated, and of equal ids one row stays.
    """
    steps = Steps(docs.sparkSession, "near-stage")
    rows, row = numbered(docs, steps)
    place = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    search = Steps(docs.sparkSession, "near-dedup")
    groups = near_groups(rows.select(place.alias("place"), F.col(text_col).alias("text")), "place", "text", search)
    left = without(rows, row, groups.where(~F.col("kept")).select(F.col("doc_id.row").alias(row)), steps)
    search.end()
    return left
