"""Taint flow through shell pipelines, line by line inside the file's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as T
from riskloom.functions.urls import EXEC_CONTEXT
from riskloom.operators.chains import KEYS, installer_downgrade, targets
from riskloom.operators.findings import lookup
from riskloom.operators.rule_scan import explode_hits
from riskloom.packs.policy import DEFAULT_POLICY, Policy

# One segment of a pipeline: quoted text and || do not split.
SEGMENT = r"""(?:[^|'"]|'[^']*(?:'|$)|"[^"]*(?:"|$)|\|\|)+"""
ENV_PREFIX = r"(?i)^env(?:\s+\w+=\S+)*\s+"
SUDO_PREFIX = r"(?i)^sudo\s+(?:-\S+\s+)*"
# The same, word by word without giving any back: the last assignment must be followed by white space as well.
ENV_WORDS = r"(?i)^env\s++(?:\w++=\S++\s++)*+"
SUDO_WORDS = r"(?i)^sudo\s++(?:-\S++\s++)*+"

# Taint kinds (bits) and the commands that bring, change or use them.
SENSITIVE, USER, NETWORK, OBFUSCATED = 1, 2, 4, 8
SOURCES = {
    "cat": SENSITIVE, "less": SENSITIVE, "head": SENSITIVE, "tail": SENSITIVE, "type": SENSITIVE,
    "env": USER, "printenv": USER, "set": USER,
    "curl": NETWORK, "wget": NETWORK, "iwr": NETWORK, "invoke-webrequest": NETWORK,
}
TRANSFORMS = {"base64": OBFUSCATED, "xxd": OBFUSCATED, "openssl": OBFUSCATED}
PASSING = ("gzip", "bzip2", "xz", "zlib", "sed", "awk", "tr", "cut", "sort", "uniq", "jq", "pandoc", "pdftotext")
INTERPRETERS = ("bash", "sh", "zsh", "python", "python3", "ruby", "perl", "node", "pwsh", "powershell", "iex")
SENDERS = ("curl", "wget", "iwr")
SEND_FLAGS = ("-d ", "--data", "--form", "-X POST", "-X post")
PYTHON_EXTS = ("py", "pyw")
JS_EXTS = ("js", "mjs", "cjs", "ts", "tsx", "jsx")
SINK_WORDS = r"(?i)\b(?:bash|sh|zsh|python3?|ruby|perl|node|pwsh|powershell|iex|tee|curl|wget|iwr)\b"

HIT = "struct<rule_id:string,category:string,severity:string,line_no:int,taints:int,sink:string,snippet:string>"


def segments(line: Column) -> Column:
    # Possessive repeats: the engine then loops over the pieces instead of recursing.
    pattern = r"""(?d)(?:[^|'"]++|'[^']*+(?:'|$)|"[^"]*+(?:"|$)|\|\|)++"""
    parts = F.transform(F.regexp_extract_all(line, F.lit(pattern), 0), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def command_name(segment: Column) -> Column:
    bare = F.regexp_replace(
        F.regexp_replace(F.trim(segment), ENV_WORDS, ""), SUDO_WORDS, "")
    return F.lower(F.split(F.trim(bare), r"\s+", 2)[0])


def _brought(name: Column) -> Column:
    stem = F.split(name, r"\.", 2)[0]
    return F.coalesce(lookup(SOURCES, stem), F.lit(0)).bitwiseOR(F.coalesce(lookup(TRANSFORMS, name), F.lit(0)))


def _has(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(bit)) != 0


def _verdict(c: Column, mask: Column) -> Column:
    """struct<rule_id, category, severity> when this command consumes what flows into it."""

    def flow(rule: str, category: str, severity: str) -> Column:
        return F.struct(
            F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), F.lit(severity).alias("severity")
        )

    return (
        F.when(c["runs"] & _has(mask, NETWORK | OBFUSCATED), flow("TAINT_CMD_INJECTION", "CmdInjection", "High"))
        .when(c["runs"] & _has(mask, SENSITIVE), flow("TAINT_CMD_INJECTION", "CmdInjection", "Medium"))
        .when(c["runs"] & _has(mask, USER), flow("TAINT_CMD_INJECTION", "CmdInjection", "High"))
        .when((c["name"] == "tee") & _has(mask, SENSITIVE), flow("TAINT_DATA_EXFIL", "Network", "Medium"))
        .when(c["sends"] & _has(mask, SENSITIVE), flow("TAINT_DATA_EXFIL", "Network", "Critical"))
        .when(c["sends"] & _has(mask, OBFUSCATED), flow("TAINT_DATA_EXFIL", "Network", "Medium"))
    )


def line_flow(line: Column) -> Column:
    """First sink of the line reached by taint; null when there is none.

    Names and traits of the commands are worked out once each, before the fold reads them.
    """
    named = F.transform(
        segments(line), lambda p: F.struct(p.alias("segment"), command_name(p).alias("name"))
    )
    commands = F.transform(
        named,
        lambda c: F.struct(
            c["name"].alias("name"), _brought(c["name"]).alias("brought"), c["name"].isin(*INTERPRETERS).alias("runs"),
            (c["name"].isin(*SENDERS) & T.contains_any(c["segment"], SEND_FLAGS)).alias("sends"),
        ),
    )
    none = F.lit(None).cast("string")
    start = F.struct(
        F.lit(0).alias("mask"), none.alias("rule_id"), none.alias("category"), none.alias("severity"),
        F.lit(0).alias("taints"), F.lit("").alias("sink"),
    )

    def step(state: Column, c: Column) -> Column:
        mask = state["mask"].bitwiseOR(c["brought"])
        verdict = _verdict(c, mask)
        reached = F.struct(
            mask.alias("mask"), verdict["rule_id"].alias("rule_id"), verdict["category"].alias("category"),
            verdict["severity"].alias("severity"), mask.alias("taints"), c["name"].alias("sink"),
        )
        going = F.struct(
            mask.alias("mask"), none.alias("rule_id"), none.alias("category"), none.alias("severity"),
            F.lit(0).alias("taints"), F.lit("").alias("sink"),
        )
        return F.when(state["rule_id"].isNotNull(), state).when(verdict.isNotNull(), reached).otherwise(going)

    flows = F.transform(F.array(commands), lambda cs: F.when(F.size(cs) >= 2, F.aggregate(cs, start, step)))
    return F.when(F.contains(line, F.lit("|")) & line.rlike(SINK_WORDS), flows[0])


def _region_state(code: Column | None = None) -> Column:
    """State at the start of a file, or of a part of one that is entered in the region `code` (see region_map)."""
    code = F.lit(0) if code is None else code
    is_py, is_js = F.col("ext").isin(*PYTHON_EXTS), F.col("ext").isin(*JS_EXTS)
    return F.struct(
        F.when(is_py & code.isin(1, 2), '"""').when(is_py & code.isin(3, 4), "'''").otherwise("").alias("open"),
        (is_py & code.isin(1, 3)).alias("inert"), (is_js & (code == 1)).alias("block"),
        F.array().cast(f"array<{HIT}>").alias("hits"),
    )


#: Regions a line may lie in. Python: none, in """ that is only shown, in """ that runs, the same for '''. Scripts of
#: the web: none, in a block comment.
REGIONS = 5


def region_map(lines: Column) -> Column:
    """array<int>: the region behind the lines for each region in front of them; such maps of consecutive parts compose."""
    def traits(line: Column) -> Column:
        s = F.trim(line)
        opens = F.contains(s, F.lit("/*")) & ~F.contains(F.substr(s, F.instr(s, "/*")), F.lit("*/")) & ~s.startswith("//")
        live = T.matches(s, EXEC_CONTEXT)
        start = F.when(_odd(s, '"""'), F.when(live, 2).otherwise(1)).when(_odd(s, "'''"), F.when(live, 4).otherwise(3)).otherwise(0)
        return F.struct(
            F.contains(s, F.lit('"""')).alias("double"), F.contains(s, F.lit("'''")).alias("single"), F.contains(s, F.lit("*/")).alias("closes"),
            F.when(F.col("ext").isin(*JS_EXTS), opens.cast("int")).otherwise(start).alias("start"),
        )

    marked = F.transform(F.filter(lines, lambda s: T.contains_any(s, MARKERS)), traits)
    is_js = F.col("ext").isin(*JS_EXTS)

    def after(region: Column, t: Column) -> Column:
        closed = F.when(is_js, t["closes"]).otherwise(F.when(region.isin(1, 2), t["double"]).otherwise(t["single"]))
        return F.when(region == 0, t["start"]).when(closed, F.lit(0)).otherwise(region)

    same = F.array(*[F.lit(i) for i in range(REGIONS)])
    walked = F.aggregate(marked, same, lambda regions, t: F.transform(regions, lambda r: after(r, t)))
    return F.when(F.col("ext").isin(*JS_EXTS, *PYTHON_EXTS), walked).otherwise(same)


def _odd(line: Column, delimiter: str) -> Column:
    n = (F.length(line) - F.length(F.replace(line, F.lit(delimiter), F.lit("")))) / len(delimiter)
    return n % 2 == 1


def _step(state: Column, event: Column) -> Column:
    """Advance over one line: leave text that is only shown, keep the first flow per rule."""
    line = event["line"]
    is_js, is_py = F.col("ext").isin(*JS_EXTS), F.col("ext").isin(*PYTHON_EXTS)
    closes_block = F.contains(line, F.lit("*/"))
    opens_block = F.contains(line, F.lit("/*")) & ~F.contains(
        F.substr(line, F.instr(line, "/*")), F.lit("*/")
    )
    js_skip = is_js & (state["block"] | line.startswith("//") | opens_block)
    block = F.when(state["block"], ~closes_block).otherwise(opens_block & ~line.startswith("//")) & is_js

    opener = F.when(_odd(line, '"""'), F.lit('"""')).when(_odd(line, "'''"), F.lit("'''")).otherwise(F.lit(""))
    is_open = state["open"] != ""
    closes = F.contains(line, state["open"])
    inert_start = ~T.matches(line, EXEC_CONTEXT)
    starts = is_py & ~is_open & (opener != "")
    py_skip = is_py & F.when(is_open, state["inert"]).otherwise(starts & inert_start)

    flow = event["flow"]
    seen = F.exists(state["hits"], lambda h: h["rule_id"] == flow["rule_id"])
    report = ~js_skip & ~py_skip & flow["rule_id"].isNotNull() & ~line.startswith("#") & ~seen
    hit = F.struct(
        flow["rule_id"].alias("rule_id"), flow["category"].alias("category"), event["severity"].alias("severity"),
        event["line_no"].cast("int").alias("line_no"), flow["taints"].alias("taints"), flow["sink"].alias("sink"),
        line.alias("snippet"),
    )
    return F.struct(
        F.when(~is_py, F.lit("")).when(is_open, F.when(closes, F.lit("")).otherwise(state["open"]))
        .otherwise(opener).alias("open"),
        F.when(starts, inert_start).otherwise(state["inert"]).alias("inert"),
        block.alias("block"),
        F.when(report, F.concat(state["hits"], F.array(hit))).otherwise(state["hits"]).alias("hits"),
    )


MARKERS = ('"""', "'''", "/*", "*/")


def taint_hits(policy: Policy = DEFAULT_POLICY) -> Column:
    """First flow per rule of the file, as array<struct>."""
    return F.when(F.contains(F.col("content"), F.lit("|")), part_hits(F.col("lines"), None, policy))


def part_hits(lines: Column, entered: Column | None = None, policy: Policy = DEFAULT_POLICY) -> Column:
    """First flow per rule of a file's lines, or of a part of them that is entered in a region; line numbers are the part's.

    Only lines that carry a flow or open or close a text region become events, so the
    running state passes over few elements and its list holds two hits at most.
    """

    def with_flow(line: Column, i: Column) -> Column:
        text = F.trim(line)
        return F.struct((i + 1).alias("line_no"), text.alias("line"), line_flow(text).alias("flow"))

    regions = F.col("ext").isin(*JS_EXTS, *PYTHON_EXTS)
    events = F.filter(
        F.transform(lines, with_flow),
        lambda e: e["flow"]["rule_id"].isNotNull() | (regions & T.contains_any(e["line"], MARKERS)),
    )

    def with_severity(e: Column) -> Column:
        flow_severity = e["flow"]["severity"]
        lowered = flow_severity.isin("Critical", "High") & installer_downgrade(e["line"], e["line"], policy)
        return F.struct(
            e["line_no"].alias("line_no"), e["line"].alias("line"), e["flow"].alias("flow"),
            F.when(lowered, "Medium").otherwise(flow_severity).alias("severity"),
        )

    return F.aggregate(F.transform(events, with_severity), _region_state(entered), _step)["hits"]


def scan_taint(files: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return explode_hits(targets(files).select(*KEYS, taint_hits(policy).alias("hits")), KEYS, "hits")


def first_per_bundle(hits: DataFrame) -> DataFrame:
    """One row per bundle and rule: the main file first, then by path.

    min_by combines before the shuffle: at most one row per task, bundle and rule moves.
    """
    rest = [c for c in hits.columns if c not in ("bundle_id", "rule_id")]
    order = F.struct(~F.col("is_main"), F.col("rel_path"), F.col("line_no"))
    best = hits.groupBy("bundle_id", "rule_id").agg(F.min_by(F.struct(*rest), order).alias("best"))
    return best.select("bundle_id", "rule_id", "best.*")


def split_commands(files: DataFrame) -> DataFrame:
    """Every pipeline of two or more commands with its command names, in order."""
    rows = targets(files).where(F.contains("content", F.lit("|"))).select(
        "bundle_id", "rel_path",
        F.filter(
            F.transform(
                F.col("lines"),
                lambda s, i: F.struct((i + 1).alias("line_no"), F.when(F.contains(s, F.lit("|")), segments(F.trim(s))).alias("parts")),
            ),
            lambda e: F.size(e["parts"]) >= 2,
        ).alias("lines"),
    )
    per_line = rows.select("bundle_id", "rel_path", F.explode_outer("lines").alias("l")).where(F.col("l").isNotNull())
    commands = per_line.select("bundle_id", "rel_path", F.col("l.line_no").alias("line_no"), F.posexplode("l.parts").alias("position", "segment"))
    return commands.withColumn("command", command_name(F.col("segment")))


