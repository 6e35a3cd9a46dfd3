"""Front matter of main files as columns.

Read are top-level keys with plain, quoted, folded (>) and literal (|) text, lists and maps in block or flow form and
comments. Whatever a YAML reader would refuse yields no manifest, and the job goes on: lines that are no entry, text
with an unclosed quote or bracket, a second ': ' in plain text, a repeated key, a value of the wrong kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The leading block between two '---' lines; the rest of the text is the body.
BLOCK = r"(?s)^\s*---(.*?)\n---"
# The value of a top-level key: the rest of its line, and the indented, list, comment and empty lines below it.
VALUE = r"(?m)^(?:%s)[ \t]*:((?:[ \t][^\n]*+)?(?:\n(?:[ \t#][^\n]*+|-(?:[ \t][^\n]*+)?|)(?=\n|\z))*+)"
KEY = r"""[A-Za-z0-9_"'][^:#\n]*"""
NAME, DESCRIPTION, LICENSE = "name", "description", "license"
TOOLS, COMPATIBILITY = "allowed[-_]tools", "compatibility(?:-info)?"
FIELDS = (NAME, DESCRIPTION, LICENSE, TOOLS, COMPATIBILITY)
VALUES = ("name", "description", "license", "tools", "compatibility")
DOUBLE, SINGLE = r'"(?:[^"\\]|\\.)*+"', r"'(?:[^']|'')*+'"
COMMENT = r"(?:^|[ \t])#.*$"
BLANK = r"^[ \t]*(?:#.*)?$"


def value_of(block: Column, key: str) -> Column:
    return F.regexp_extract(block, VALUE % key, 1)


def bare(text: Column) -> Column:
    """Text of one line without the comment behind it and the white space around it."""
    line = F.regexp_replace(text, r"^[ \t]+|[ \t]+$", "")
    quoted = F.regexp_extract(line, rf"^({DOUBLE}|{SINGLE})[ \t]*(?:#.*)?$", 1)
    return F.when(quoted != "", quoted).otherwise(F.regexp_replace(F.regexp_replace(line, COMMENT, ""), r"[ \t]+$", ""))


def head(value: Column) -> Column:
    """What stands on the key's own line."""
    return bare(F.split(value, "\n", 2)[0])


def _below(value: Column) -> Column:
    lines = F.split(value, "\n")
    return F.slice(lines, F.lit(2), F.size(lines))


def _is_block_text(value: Column) -> Column:
    return head(value).rlike(r"^[|>][+-]?[0-9]?[+-]?$")


def _block_text(value: Column) -> Column:
    """Text below > or |: less its indent; folded lines are joined by spaces, empty ones stay breaks."""
    lines = _below(value)
    indent = F.length(F.regexp_extract(F.array_join(F.filter(lines, lambda s: F.trim(s) != ""), "\n"), r"^([ \t]*)", 1))
    text = F.array_join(F.transform(lines, lambda s: F.substr(s, indent + 1)), "\n")
    bare = F.regexp_replace(text, r"\s+$", "")
    folded = F.regexp_replace(F.regexp_replace(bare, r"(?<!\n)\n(?!\n)", " "), r"\n\n", "\n")
    body = F.when(head(value).startswith(">"), folded).otherwise(bare)
    return F.concat(body, F.when(F.contains(head(value), F.lit("-")) | (body == ""), "").otherwise("\n"))


def _flow(value: Column) -> Column:
    """Plain or quoted text over one or several lines, as one line without comments."""
    lines = F.transform(F.split(value, "\n"), bare)
    return F.array_join(F.filter(lines, lambda s: s != ""), " ")


def unquoted(text: Column) -> Column:
    return (
        F.when(text.rlike(f"^{DOUBLE}$"), F.regexp_replace(F.regexp_replace(text, '^"|"$', ""), r'\\(["\\/])', "$1"))
        .when(text.rlike(f"^{SINGLE}$"), F.replace(F.regexp_replace(text, "^'|'$", ""), F.lit("''"), F.lit("'")))
        .otherwise(text)
    )


def scalar(value: Column) -> Column:
    return F.when(_is_block_text(value), _block_text(value)).otherwise(unquoted(_flow(value)))


def _is_text(value: Column) -> Column:
    """The value can be read as text."""
    flow = _flow(value)
    quoted = flow.rlike(f"^(?:{DOUBLE}|{SINGLE})$")
    plain = ~flow.rlike(r"""^["'\[{&*!|>%@`]|^[-?](?:\s|$)|:(?:\s|$)""")
    return _is_block_text(value) | quoted | plain


def _inline(value: Column, opening: str, closing: str) -> Column:
    """Items between brackets, with and without which the value is no list or map in flow form."""
    return F.split(F.regexp_extract(_flow(value), rf"^{opening}(.*){closing}$", 1), ",")


def string_list(value: Column) -> Column:
    """[a, b] on the key's line, or '- a' lines below it."""
    below = F.transform(_below(value), lambda s: F.regexp_extract(s, r"^[ \t]*-[ \t]+(.*)$", 1))
    items = F.when(head(value).startswith("["), _inline(value, r"\[", r"\]")).otherwise(below)
    return F.filter(F.transform(items, lambda s: unquoted(bare(s))), lambda s: s != "")


def _is_list(value: Column) -> Column:
    lines = F.filter(_below(value), lambda s: ~s.rlike(BLANK))
    listed = (head(value) == "") & F.forall(lines, lambda s: s.rlike(r"^[ \t]*-(?:[ \t].*)?$"))
    return listed | _flow(value).rlike(r"^\[[^\[\]]*\]$")


def entries(value: Column) -> Column:
    """array<struct<key, value>> of a map: indented 'k: v' lines below the key, or {k: v, …}."""
    below = F.filter(_below(value), lambda s: ~s.rlike(BLANK))
    items = F.when(head(value).startswith("{"), _inline(value, r"\{", r"\}")).otherwise(below)
    return F.transform(
        F.filter(items, lambda s: F.contains(s, F.lit(":"))),
        lambda s: F.struct(
            unquoted(bare(F.regexp_extract(s, "^([^:]+):", 1))).alias("key"),
            unquoted(bare(F.regexp_extract(s, "^[^:]+:(.*)$", 1))).alias("value"),
        ),
    )


def _is_map(value: Column, found: Column) -> Column:
    lines = F.filter(_below(value), lambda s: ~s.rlike(BLANK))
    mapped = (head(value) == "") & F.forall(lines, lambda s: s.rlike(r"^[ \t]+[^:#\-\s][^:]*:(?:[ \t].*)?$"))
    return (mapped | _flow(value).rlike(r"^\{[^{}]*\}$")) & (F.size(F.array_distinct(F.transform(found, lambda e: e["key"]))) == F.size(found))


def _keys_are_sound(block: Column) -> Column:
    """All lines at the margin are entries, and no key that is read stands twice."""
    lines = F.filter(F.split(block, "\n"), lambda s: ~s.rlike(r"^(?:[ \t#].*|-(?:[ \t].*)?|)$"))
    shaped = F.forall(lines, lambda s: s.rlike(rf"^{KEY}:(?:[ \t].*)?$"))
    found = F.filter(lines, lambda s: s.rlike(rf"^(?:{'|'.join(FIELDS)})[ \t]*:"))
    names = F.transform(found, lambda s: F.replace(F.regexp_extract(s, r"^([A-Za-z_-]+)", 1), F.lit("_"), F.lit("-")))
    alike = F.transform(names, lambda s: F.when(s == "compatibility-info", F.lit("compatibility")).otherwise(s))
    return shaped & (F.size(F.array_distinct(alike)) == F.size(alike))


def held(rows: DataFrame, column: str) -> DataFrame:
    """The column worked out once a row: what reads it is not merged with what makes it.

    The optimizer would otherwise write an expression out at each place that uses it.
    """
    return rows.withColumn(column, F.explode_outer(F.array(column)))


def has_block(content: Column) -> Column:
    return content.rlike(BLOCK)


def block_of(content: Column) -> Column:
    return F.regexp_extract(content, BLOCK, 1)


def parse_blocks(rows: DataFrame) -> DataFrame:
    """Manifest fields out of (bundle_id, rel_path, has_manifest, block), nulls without a readable manifest."""
    read = held(rows.select("bundle_id", "rel_path", "has_manifest", "block"), "block")
    b = F.col("block")
    values = F.struct(
        _keys_are_sound(b).alias("sound"), b.rlike(r"(?m)^license[ \t]*:").alias("licensed"),
        *[value_of(b, key).alias(name) for name, key in zip(VALUES, FIELDS)],
    )
    valued = held(read.select("bundle_id", "rel_path", "has_manifest", values.alias("v")), "v")
    v = F.col("v")
    parsed = F.struct(
        (
            F.col("has_manifest") & v["sound"] & _is_text(v["name"]) & _is_text(v["description"]) & _is_text(v["license"]) & _is_list(v["tools"])
            & _is_map(v["compatibility"], entries(v["compatibility"]))
        ).alias("readable"),
        scalar(v["name"]).alias("name"), scalar(v["description"]).alias("description"), string_list(v["tools"]).alias("allowed_tools"),
        entries(v["compatibility"]).alias("compatibility"), F.when(v["licensed"], scalar(v["license"])).alias("license"),
    )
    done = held(valued.select("bundle_id", "rel_path", parsed.alias("m")), "m")
    m = F.col("m")

    def known(value: Column) -> Column:
        return F.when(m["readable"], value)

    # A readable map has no key twice.
    out = done.select("bundle_id", "rel_path", F.struct(
        m["readable"].alias("has_manifest"), known(m["name"]).alias("name"), known(m["description"]).alias("description"),
        known(m["allowed_tools"]).alias("allowed_tools"), known(F.map_from_entries(m["compatibility"])).alias("compatibility"), known(m["license"]).alias("license"),
    ).alias("m"))
    return out.select("bundle_id", "rel_path", "m.*")


def bundles(files: DataFrame) -> DataFrame:
    """One row per main file."""
    rows = files.where("is_main").select(
        "bundle_id", "rel_path", has_block(F.col("content")).alias("has_manifest"), block_of(F.col("content")).alias("block"))
    return parse_blocks(rows)
