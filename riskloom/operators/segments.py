"""Files of any length, as segments of lines: no file is one row or one array.

A file's lines come as rows (KEYS, line_no, line). A segment holds SEGMENT consecutive lines, and beside them the few lines
before and behind that tests of a line's neighbours read. What reaches further than a segment is carried from one to the
next as a state, and states are functions of a segment that compose, so they are worked out for all segments at once:

* a logical line that goes on into the next segment: whether a segment ends open, and the pieces at its borders;
* a text region that is only shown (strings in three quotes, block comments): a map from the region a segment is entered
  in to the one it is left in, composed over blocks of BLOCK segments, over blocks of those, and applied on the way back;
* front matter of a main file: its first and last line, two numbers a file;
* a loop whose body goes on beyond the lines at hand: only such loops look for the first line that decides.

Results equal those of the operators on whole files, for any segment length. Steps are tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import sqltext as S
from riskloom.functions import text as T
from riskloom.operators import rule_scan, taint
from riskloom.packs.policy import DEFAULT_POLICY, Policy
from riskloom.session import Steps

KEYS = ["bundle_id", "rel_path", "ext", "is_main", "is_doc_path"]
PLACE = ["bundle_id", "rel_path"]
#: Lines of a segment, and of its neighbours that it holds as well.
SEGMENT = 1000
BEFORE = max(rule_scan.EXEC_LOOKBACK, rule_scan.HEAD_LOOKBACK)
BEHIND = 50
#: Segments, or blocks of them, whose states one row composes.
BLOCK = 1000
LOOP = "RESOURCE_ABUSE_INFINITE_LOOP"


def lines_of(files: DataFrame, *more: str) -> DataFrame:
    """Numbered lines of files that are rows; for files too long for that see sources.long_files."""
    rows = files.select(*KEYS, *more, F.posexplode(T.physical_lines(F.col("content"))).alias("line_no", "line"))
    return rows.withColumn("line_no", (F.col("line_no") + 1).cast("long"))


def cut(lines: DataFrame, length: int = SEGMENT, before: int = BEFORE, behind: int = BEHIND) -> DataFrame:
    """KEYS, segment, first (its first line's number), core (its lines), lines (with the neighbours), offset (lines in front of lines[0])."""
    at = F.col("line_no") - 1
    low = F.greatest(F.floor((at - behind) / length), F.lit(0)).cast("long")
    high = F.floor((at + before) / length).cast("long")
    dealt = lines.select(*KEYS, "line_no", "line", F.explode(F.sequence(low, high)).alias("segment"))
    # No more than length + before + behind lines a group; a segment behind the file's end has none of its own.
    held = dealt.groupBy(*KEYS, "segment").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("all"))
    first = F.col("segment") * length + 1
    core = F.filter("all", lambda x: (x["line_no"] >= first) & (x["line_no"] < first + length))
    rows = held.select(
        *KEYS, "segment", first.alias("first"), F.transform(core, lambda x: x["line"]).alias("core"), F.transform("all", lambda x: x["line"]).alias("lines"),
        (F.get("all", F.lit(0))["line_no"] - 1).alias("offset"),
    )
    return rows.where(F.size("core") > 0)


# --- states of a segment that compose


def entering(maps: DataFrame, steps: Steps, name: str, block: int | None = None) -> DataFrame:
    """PLACE, part and state: the state each part of a file is entered in, from 0 at its start.

    maps has PLACE, part (0, 1, ...) and map, an array that gives the state behind the part for each state in front of it.
    """
    size = block or BLOCK
    grouped = maps.groupBy(*PLACE, F.expr(f"part div {size}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("part", "map"))).alias("parts"))
    # The whole block as one map, from each state in turn.
    whole = F.transform(F.get("parts", F.lit(0))["map"], lambda _, s: F.aggregate("parts", s, lambda state, p: F.get(p["map"], state)))
    blocks = steps.keep(grouped.withColumn("map", whole), name)
    if blocks.where("block > 0").isEmpty():
        entered = blocks.withColumn("state", F.lit(0))
    else:
        above = entering(blocks.select(*PLACE, F.col("block").alias("part"), "map"), steps, f"{name}-up", size)
        entered = blocks.join(above.withColumnRenamed("part", "block"), [*PLACE, "block"])
    start = F.struct(F.col("state").cast("int").alias("state"), F.array().cast("array<struct<part:bigint,state:int>>").alias("seen"))
    walked = F.aggregate(
        "parts", start,
        lambda now, p: F.struct(
            F.get(p["map"], now["state"]).alias("state"),
            F.concat(now["seen"], F.array(F.struct(p["part"].cast("bigint").alias("part"), now["state"].alias("state")))).alias("seen"),
        ),
    )["seen"]
    return entered.select(*PLACE, F.explode_outer(walked).alias("s")).select(*PLACE, "s.part", "s.state")


# --- logical lines


def _parts(segments: DataFrame) -> DataFrame:
    """Segments with parts: their text's logical lines, T.JOIN_MARK for each break that a line goes on over."""
    marked = T.mark_breaks(F.array_join("core", "\n"), F.col("ext"))
    split = F.split(marked, "\n")
    # The text ends in a break; where the last line goes on, that break is a mark.
    last_open = F.element_at(split, -1) != ""
    ends_open = F.element_at(split, -1).endswith(T.JOIN_MARK) & last_open
    parts = F.when(last_open, split).otherwise(F.slice(split, F.lit(1), F.size(split) - 1))
    return segments.withColumn("ends_open", ends_open).withColumn("parts", parts)


def _marks(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{T.JOIN_MARK}]", "")


def logical_segments(segments: DataFrame, steps: Steps, name: str = "logical") -> DataFrame:
    """Segments with items, the logical lines that begin in them: line_no (of the file), text and folded."""
    held = steps.keep(_parts(segments), f"{name}-parts")
    in_order = Window.partitionBy(*PLACE).orderBy("segment")  # a row a segment, without its text
    ends = steps.keep(
        held.select(*PLACE, "segment", "ends_open").withColumn("enters_open", F.coalesce(F.lag("ends_open").over(in_order), F.lit(False))).drop("ends_open"),
        f"{name}-ends",
    )
    rows = steps.keep(held.join(ends, [*PLACE, "segment"]), f"{name}-entered")
    n = F.size("parts")
    lone = F.col("enters_open") & F.col("ends_open") & (n == 1)
    # Border pieces keep their marks, so that what stands between them keeps its numbers.
    kept = F.transform("parts", lambda p, i: F.when((F.col("enters_open") & (i == 0)) | (F.col("ends_open") & (i == n - 1)), _marks(p)).otherwise(p))
    # The last piece goes on over the segment's own last break: its marks are one more than its breaks within.
    inner = F.array_join(kept, "\n")
    items = F.transform(
        T.logical_lines(inner),
        lambda x: F.struct((x["line_no"] + F.col("first") - 1).cast("long").alias("line_no"), x["text"].alias("text"), x["folded"].alias("folded")),
    )
    head = F.when(F.col("enters_open"), F.regexp_replace(F.get("parts", F.lit(0)), r"^[^\S\n]+", ""))
    tail = F.when(F.col("ends_open") & ~lone, F.element_at("parts", -1))
    spans = F.aggregate(F.slice("parts", F.lit(1), n - 1), F.lit(0), lambda s, p: s + F.length(_marks(p)) + 1)
    pieces = F.filter(
        F.array(
            F.when(head.isNotNull(), F.struct(F.lit(0).alias("side"), F.lit(None).cast("long").alias("opens"), head.alias("text"))),
            F.when(tail.isNotNull(), F.struct(F.lit(1).alias("side"), (F.col("first") + spans).cast("long").alias("opens"), tail.alias("text"))),
        ),
        lambda p: p.isNotNull(),
    )
    done = rows.withColumn("items", items).withColumn("pieces", pieces)
    border = rows.select(*PLACE, "segment", F.explode_outer(pieces).alias("p")).where("p is not null").select(*PLACE, "segment", "p.*")
    opened = F.last("opens", ignorenulls=True).over(Window.partitionBy(*PLACE).orderBy("segment", "side").rowsBetween(Window.unboundedPreceding, 0))
    whole = border.withColumn("start", opened).groupBy(*PLACE, "start").agg(
        F.min("segment").alias("segment"), F.sort_array(F.collect_list(F.struct("segment", "side", "text"))).alias("texts")
    )
    # One logical line: all its pieces, as T.logical_lines reads them.
    joined = T.logical_lines(F.array_join(F.transform("texts", lambda t: t["text"]), ""))
    over = whole.select(*PLACE, "segment", F.transform(joined, lambda x: F.struct(
        (x["line_no"] + F.col("start") - 1).cast("long").alias("line_no"), x["text"].alias("text"), x["folded"].alias("folded"))).alias("over"))
    over = steps.keep(over, f"{name}-over")
    # At most one line goes on over the end of a segment.
    return done.join(over, [*PLACE, "segment"], "left").select(
        *segments.columns, F.concat("items", F.coalesce("over", F.expr("CAST(array() AS array<struct<line_no: bigint, text: string, folded: string>>)"))).alias("items")
    )


def logical_lines(lines: DataFrame, steps: Steps, length: int = SEGMENT) -> DataFrame:
    """KEYS, line_no (of the first physical line) and text of every logical line that is not empty."""
    rows = logical_segments(cut(lines, length, 0, 0), steps)
    return rows.select(*KEYS, F.explode_outer("items").alias("i")).where("i is not null").select(*KEYS, "i.line_no", "i.text")


# --- rules on lines


def rule_hits(lines: DataFrame, steps: Steps, policy: Policy = DEFAULT_POLICY, length: int = SEGMENT, behind: int = BEHIND) -> DataFrame:
    """KEYS, rule_id, line_no and snippet of every hit of a line rule, context tests applied."""
    behind = max(behind, rule_scan.SHELL_TRUE_LINES)
    rows = steps.keep(logical_segments(cut(lines, length, BEFORE, behind), steps), "items")
    # The rules read a row as if it were a file: its lines, its logical lines numbered in them, and all its text.
    local = F.transform("items", lambda x: F.struct((x["line_no"] - F.col("offset")).cast("int").alias("line_no"), x["text"].alias("text"), x["folded"].alias("folded")))
    text = F.array_join(F.transform("items", lambda x: x["text"]), "\n")
    as_file = rule_scan.with_words(rows.select(*KEYS, "segment", "offset", "lines", local.alias("items"), text.alias("content")).withColumns(
        {"folded": T.folded(F.col("content")), "marks": F.expr(S.marks_column("content")), "folded_logical": F.array_join(F.transform("items", lambda x: x["folded"]), "\n")}
    ))
    loops = [r for r in rule_scan.enabled_rules(policy) if r.rule_id == LOOP]
    open_loops = F.flatten(F.array(*[
        F.transform(F.filter(F.expr(rule_scan.matching_items_sql(r)), lambda x: rule_scan.loop_verdict(x).isNull()), lambda x: x["line_no"]) for r in loops
    ])) if loops else F.array().cast("array<int>")
    # explode_outer and a test on the result, as in rule_scan.explode_hits: a test on the array of hits would be pushed below,
    # through every text form the rules read, and evaluate all of them anew for each rule.
    found = as_file.select(*KEYS, "offset", open_loops.alias("open_loops"), F.explode_outer(rule_scan.line_rule_hits(policy)).alias("h"))
    hits = found.where("h is not null").select(
        *KEYS, F.col("h.rule_id").alias("rule_id"), (F.col("h.line_no") + F.col("offset")).cast("long").alias("line_no"), F.col("h.snippet").alias("snippet"),
        ((F.col("h.rule_id") == LOOP) & F.array_contains("open_loops", F.col("h.line_no"))).alias("open"),
    )
    hits = steps.keep(hits, "numbered")
    left = _loops_left_open(hits.where("open"), lines, behind)
    return hits.join(left, [*PLACE, "line_no", "rule_id"], "left_anti").drop("open")


def _loops_left_open(loops: DataFrame, lines: DataFrame, behind: int) -> DataFrame:
    """Of loops that no line at hand decides, those that the first line that does decide leaves by an exit."""
    own = lines.join(loops.select(*PLACE, "line_no", "rule_id"), [*PLACE, "line_no"]).select(
        *PLACE, F.col("line_no").alias("head"), "rule_id", rule_scan.indent(F.col("line")).alias("own"))
    below = lines.select(*PLACE, "line_no", "line").where(F.trim("line") != "").withColumns(
        {"indent": rule_scan.indent(F.col("line")), "exits": F.trim("line").rlike(rule_scan.LOOP_EXIT)})
    deciding = own.join(below, PLACE).where((F.col("line_no") > F.col("head")) & ((F.col("indent") <= F.col("own")) | F.col("exits")))
    first = deciding.groupBy(*PLACE, "head", "rule_id").agg(F.min_by((F.col("indent") > F.col("own")), "line_no").alias("leaves"))
    return first.where("leaves").select(*PLACE, F.col("head").alias("line_no"), "rule_id")


# --- taint


def instruction_lines(lines: DataFrame) -> DataFrame:
    """Lines that chains and taint are looked for in: front matter of a main file emptied, line numbers as they are."""
    main = lines.where("is_main")
    shown = main.where(F.col("line").rlike(r"\S"))
    opening = shown.groupBy(*PLACE).agg(F.min(F.struct("line_no", "line")).alias("f")).where(F.col("f.line").rlike(r"^\s*---")).select(*PLACE, F.col("f.line_no").alias("opens"))
    marks = main.where(F.col("line").startswith("---")).select(*PLACE, "line_no").join(opening, PLACE).where("line_no > opens")
    closing = marks.groupBy(*PLACE).agg(F.min("line_no").alias("closes"))
    joined = lines.join(closing, PLACE, "left")  # one row a main file
    bare = F.when(F.col("line_no") < F.col("closes"), "").when(F.col("line_no") == F.col("closes"), F.substr("line", F.lit(4))).otherwise(F.col("line"))
    return joined.withColumn("line", bare).drop("closes")


def taint_hits(lines: DataFrame, steps: Steps, policy: Policy = DEFAULT_POLICY, length: int = SEGMENT) -> DataFrame:
    """First flow per rule of each file, for lines of chains.targets."""
    rows = steps.keep(cut(instruction_lines(lines), length, 0, 0).select(*KEYS, "segment", "first", "core"), "cores")
    maps = rows.select(*PLACE, F.col("segment").alias("part"), taint.region_map(F.col("core")).alias("map"))
    states = entering(maps, steps, "regions").select(*PLACE, F.col("part").alias("segment"), "state")
    entered = rows.join(states, [*PLACE, "segment"]).select(*KEYS, "first", taint.part_hits(F.col("core"), F.col("state"), policy).alias("hits"))
    hits = entered.select(*KEYS, "first", F.explode_outer("hits").alias("h")).where("h is not null").select(
        *KEYS, "h.rule_id", "h.category", "h.severity", (F.col("h.line_no") + F.col("first") - 1).cast("int").alias("line_no"), "h.taints", "h.sink", "h.snippet"
    )
    rest = [c for c in hits.columns if c not in (*KEYS, "rule_id")]
    return hits.groupBy(*KEYS, "rule_id").agg(F.min_by(F.struct(*rest), "line_no").alias("b")).select(*KEYS, "rule_id", "b.*")
