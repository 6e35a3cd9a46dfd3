"""Merkle manifest of a dataset: a tree over the documents of each language, and one over the languages' roots.

A leaf is the SHA-256 of a row's fields; FAN consecutive nodes become one, until one is left. Digests are lowercase hex,
and what is hashed are hex digits: a level of the tree is one string, a node its WIDTH characters at a fixed place.

Nodes of a tree are cut into aligned blocks of FAN ** DEEP. A block holds its nodes as one string, and each level above
as one, made by hashing fixed-width substrings of the level below. A node's siblings on a level are the substrings on
both its sides within its run. A block's last level is its root; the roots of a tree's blocks are the nodes of the next
stage, until a tree is one block. Paths come down the same way, block by block, so leaves are never joined to levels.

Rows are ranked by a range sort and by counts of its partitions: no tree is gathered in one task, however many rows a
language has. Order within a tree: ids ascending, null first, then the leaf; rows equal in all fields are leaves of
their own. Null fields are hashed as `-`; null languages form the first tree. Ids that are null take no part in tampering.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Steps

#: Nodes that become one, and levels above its nodes that a block keeps.
FAN, DEEP = 8, 3
#: Hex digits of a digest.
WIDTH = 64
#: Rows of the table of partitions and trees that are broadcast at most; a larger one is joined by a shuffle.
BROADCAST = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """`-` for null, else the value's bytes in UTF-8, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """SHA-256 of the values one after the other, as hex."""
    return F.sha2(F.concat(*values).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, node (the leaf) and tampered: the leaf of the row as it is tampered with, null if it is left alone."""
    changed = [F.translate(F.col(c), UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        # A mark before each language, so that null is none of them and comes first; strings are ordered by their bytes.
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), "doc_id",
        digest(*[field(F.col(c)) for c in FIELDS]).alias("node"),
        F.when(struck, digest(*[field(c) for c in changed])).alias("tampered"),
    )


def ranked(rows: DataFrame, order: list[str], steps: Steps, name: str) -> DataFrame:
    """rows of tree, ..., with pos (place in its tree by order, from 0) and total (nodes of its tree).

    order must not leave ties. Partitions of a range sort hold consecutive rows, so a row's place is that of its
    partition's first row of the tree and its place behind that.
    """
    keys = ["tree", *order]
    sorted_rows = steps.keep(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    sorted_rows = sorted_rows.withColumn("part", F.shiftright("at", 33))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sorted_rows.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first")).select(
        "tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("total")
    )
    parts = steps.keep(parts, f"{name}-parts")
    side = F.broadcast(parts) if parts.count() <= BROADCAST else parts
    return sorted_rows.join(side, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _nodes_at(level: Column, first: Column, n) -> Column:
    """n nodes of a level from the given place; levels are kept as the ASCII bytes of their digits, so this is one copy."""
    return F.substring(level, (first * WIDTH + 1).cast("int"), (n * WIDTH).cast("int"))


def _parents(level: Column) -> Column:
    runs = F.ceil(F.octet_length(level) / (FAN * WIDTH)).cast("int")
    hashed = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(_nodes_at(level, i * FAN, F.lit(FAN)), 256))
    return F.array_join(hashed, "").cast("binary")


def _rounds(total: Column) -> Column:
    """Levels a block adds: DEEP, or in a tree of one block as many as lead to one node."""
    return sum(F.when(total > FAN**i, 1).otherwise(0) for i in range(DEEP))


def blocks(nodes: DataFrame) -> DataFrame:
    """tree, total, block, members (pos, node and the other columns of its nodes), levels from the nodes up."""
    extra = [c for c in nodes.columns if c not in ("tree", "total", "pos", "node")]
    size = FAN**DEEP
    grouped = nodes.groupBy("tree", "total", F.expr(f"pos div {size}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "node", F.struct(*extra or [F.lit(None).cast("int").alias("nothing")]).alias("extra")))).alias("members")
    )  # no more than FAN ** DEEP members
    base = F.array(F.array_join(F.transform("members", lambda m: m["node"]), "").cast("binary"))
    steps = F.slice(F.array(*[F.lit(i) for i in range(DEEP)]), F.lit(1), _rounds(F.col("total")))
    levels = F.aggregate(steps, base, lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))))
    return grouped.withColumn("levels", levels)


def grown(nodes: DataFrame, steps: Steps, name: str) -> list[DataFrame]:
    """The blocks of each stage, from the nodes to the stage at which every tree is one block."""
    stages, size = [], FAN**DEEP
    while True:
        stages.append(steps.keep(blocks(nodes), f"{name}-{len(stages)}"))
        going = stages[-1].where(F.col("total") > size)
        if going.isEmpty():
            return stages
        nodes = going.select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("total") / size).cast("long").alias("total"),
            F.element_at("levels", -1).cast("string").alias("node"),
        )


def tops(stages: list[DataFrame]) -> DataFrame:
    """tree and node, its root."""
    found = [s.where(F.col("total") <= FAN**DEEP).select("tree", F.element_at("levels", -1).cast("string").alias("node")) for s in stages]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _flanks(levels: Column, pos: Column, i: Column) -> Column:
    """left and right: the siblings of a node's ancestor on level i of its block, as hex."""
    own = F.floor(F.pmod(pos, F.lit(FAN**DEEP)) / F.pow(F.lit(float(FAN)), i)).cast("int")
    place, level = own % FAN, F.get(levels, i)
    return F.struct(
        _nodes_at(level, own - place, place).cast("string").alias("left"),
        _nodes_at(level, own + 1, FAN - 1 - place).cast("string").alias("right"),
    )


def members(held: DataFrame) -> DataFrame:
    """tree, top, above and each member (pos, node, extra) with path: its siblings from its own level to its root's, and above."""
    upward = F.slice(F.array(*[F.lit(i) for i in range(DEEP)]), F.lit(1), F.size("levels") - 1)
    with_path = F.transform(
        "members",
        lambda m: F.struct(m["pos"].alias("pos"), m["node"].alias("node"), m["extra"].alias("extra"), F.transform(upward, lambda i: _flanks(F.col("levels"), m["pos"], i)).alias("own")),
    )
    rows = held.select("tree", "top", "above", F.explode_outer(with_path).alias("m"))
    return rows.select("tree", "top", "m.pos", "m.node", "m.extra", F.concat("m.own", "above").alias("path"))


def with_paths(stages: list[DataFrame], above: DataFrame, steps: Steps, name: str) -> DataFrame:
    """members of the first stage; above has tree, top and above (the path from the tree's root on) of each tree."""
    size, held = FAN**DEEP, None
    for k in range(len(stages) - 1, -1, -1):
        found = stages[k].where(F.col("total") <= size).join(above, "tree")
        if held is not None:
            reached = held.select("tree", F.col("pos").alias("block"), "top", F.col("path").alias("above"))
            found = found.unionByName(stages[k].where(F.col("total") > size).join(reached, ["tree", "block"]))
        held = members(found)
        if k:
            held = steps.keep(held, f"{name}-paths-{k}")
    return held


def manifest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, leaf, tampered, subroot, root and path of every row of docs (with source, lang, n_chars and text).

    path is an array of left and right siblings, level by level from the leaf to the root; folded() takes it.
    """
    steps = Steps(docs.sparkSession, "merkle")
    rows = docs.select(F.col(id_col).alias("doc_id"), *FIELDS[1:])
    kept = steps.keep(leaves(rows).withColumn("row", F.monotonically_increasing_id()), "leaves")
    stages = grown(ranked(kept, ["doc_id", "node", "row"], steps, "leaves").drop("row"), steps, "blocks")
    subroots = steps.keep(tops(stages), "subroots")
    over = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    high = grown(ranked(over, ["name"], steps, "subroots"), steps, "trees")
    none = F.array().cast("array<struct<left:string,right:string>>")
    root = tops(high).select("tree", F.col("node").alias("top"), none.alias("above"))
    above = steps.keep(
        with_paths(high, root, steps, "trees").select(
            F.col("extra.name").alias("tree"), F.struct(F.col("node").alias("subroot"), F.col("top").alias("root")).alias("top"), F.col("path").alias("above")
        ),
        "above",
    )
    return with_paths(stages, above, steps, "blocks").select(
        "extra.doc_id", F.col("node").alias("leaf"), "extra.tampered", "top.subroot", "top.root", "path"
    )


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, node, lambda done, s: digest(s["left"], done, s["right"]))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level from left to right, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
