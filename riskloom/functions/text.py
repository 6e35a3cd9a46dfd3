"""Text helpers: everything works inside one row, so no step here shuffles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.packs.loader import java_regex, rare_start

# A Unicode noncharacter: stands for a line break swallowed by a continuation.
JOIN_MARK = "\ufdd0"

# Extensions by continuation style.
BACKSLASH_EXTS = ("sh", "bash", "zsh", "ksh", "fish", "csh", "tcsh", "yaml", "yml", "dockerfile")
BACKTICK_EXTS = ("ps1", "psm1", "psd1")
PLUS_EXTS = ("js", "jsx", "ts", "tsx", "mjs", "cjs", "py", "pyw", "java", "cs", "ps1", "psm1", "psd1")


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(java_regex(pattern))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def matches_any(text: Column, patterns) -> Column:
    return any_of([matches(text, p) for p in patterns])


def contains_any(text: Column, literals) -> Column:
    return any_of([F.contains(text, F.lit(s)) for s in literals])


def holds(folded: Column, need) -> Column:
    """The folded text holds the literals a pattern needs (see literal_need)."""
    if isinstance(need, str):
        return F.contains(folded, F.lit(rare_start(need)))
    parts = [holds(folded, part) for part in need[1]]
    return all_of(parts) if need[0] == "and" else any_of(parts)


def folded(text: Column) -> Column:
    """Lower case for literal tests in front of (?i): long s and the dotless and dotted i match s and i there.

    Few texts hold one of the three, and translating costs far more than looking for them.
    """
    letters = "\u017f\u0131\u0130"
    return F.lower(F.when(contains_any(text, letters), F.translate(text, letters, "sii")).otherwise(text))


def unix_breaks(content: Column) -> Column:
    return F.replace(content, F.lit("\r\n"), F.lit("\n"))


def physical_lines(content: Column) -> Column:
    """Lines without their breaks; a final break does not open another line."""
    text = unix_breaks(content)
    parts = F.split(text, "\n")
    return F.when(text.endswith("\n") | (text == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def mark_continuations(content: Column, ext: Column) -> Column:
    """Replace each swallowed line break by one JOIN_MARK."""
    return mark_breaks(unix_breaks(content), ext)


def mark_breaks(content: Column, ext: Column) -> Column:
    """The same for text in which every line feed, and nothing else, is a break."""
    text = F.concat(content, F.lit("\n"))
    backslash = F.regexp_replace(text, java_regex(r"[^\S\n]*\\[^\S\n]*\n[^\S\n]*"), JOIN_MARK)
    plus = F.regexp_replace(text, java_regex(r"""(["'])[^\S\n]*\+[^\S\n]*\n[^\S\n]*"""), "$1" + JOIN_MARK)
    tick_and_plus = F.regexp_replace(plus, java_regex(r"[^\S\n]*`[^\S\n]*\n[^\S\n]*"), JOIN_MARK)
    joined = (
        F.when(ext.isin(*BACKSLASH_EXTS) & F.contains(content, F.lit("\\")), backslash)
        .when(ext.isin(*BACKTICK_EXTS), tick_and_plus)
        .when(ext.isin(*PLUS_EXTS) & F.contains(content, F.lit("+")), plus)
        .otherwise(text)
    )
    return joined


def glue_literals(line: Column) -> Column:
    glued = F.regexp_replace(line, java_regex(r"""["']\s*\+\s*["']"""), "")
    return F.when(F.contains(line, F.lit("+")), glued).otherwise(line)


def logical_lines(marked: Column) -> Column:
    """array<struct<line_no, text, folded>>; line_no is that of the first physical line.

    A line holding n marks stood on n+1 physical lines, so it is followed by n empty
    slots; positions in the array then are physical line numbers, in linear time.
    """

    def spread(line: Column) -> Column:
        total = F.length(line) - F.length(F.replace(line, F.lit(JOIN_MARK), F.lit("")))
        lead = F.length(line) - F.length(F.ltrim(line, F.lit(JOIN_MARK)))
        text = F.regexp_replace(F.trim(line, F.lit(JOIN_MARK)), JOIN_MARK + "+", " ")
        empty = F.lit(None).cast("string")
        return F.when(
            F.contains(line, F.lit(JOIN_MARK)),
            F.concat(F.array_repeat(empty, lead), F.array(text), F.array_repeat(empty, total - lead)),
        ).otherwise(F.array(line))

    parts = F.split(marked, "\n")
    slots = F.when(F.contains(marked, F.lit(JOIN_MARK)), F.flatten(F.transform(parts, spread))).otherwise(parts)
    numbered = F.transform(slots, lambda s, i: F.struct((i + 1).alias("line_no"), glue_literals(s).alias("text")))
    kept = F.filter(numbered, lambda s: s["text"].isNotNull() & (s["text"] != ""))
    return F.transform(
        kept,
        lambda s: F.struct(s["line_no"].alias("line_no"), s["text"].alias("text"), folded(s["text"]).alias("folded")),
    )


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_of_first(content: Column, pattern: str) -> Column:
    """1-based line on which the first match of the pattern starts."""
    return newline_count(F.split(content, java_regex(pattern), 2)[0]) + 1


def line_positions(lines: Column, condition) -> Column:
    """1-based numbers of the lines for which condition(line) holds."""
    flagged = F.transform(lines, lambda s, i: F.when(condition(s), i + 1))
    return F.filter(flagged, lambda i: i.isNotNull())


def any_between(positions: Column, low: Column, high: Column) -> Column:
    return F.exists(positions, lambda p: (p >= low) & (p <= high))


def first_between(positions: Column, low: Column, high: Column) -> Column:
    return F.array_min(F.filter(positions, lambda p: (p >= low) & (p <= high)))


def last_between(positions: Column, low: Column, high: Column) -> Column:
    return F.array_max(F.filter(positions, lambda p: (p >= low) & (p <= high)))


def line_text(lines: Column, line_no: Column) -> Column:
    return F.trim(F.try_element_at(lines, line_no))


#: What a match may show: the name a secret is given to and the quotes around it, or a scheme.
MASK_HEAD = r"""^(?:(?:api[_-]?key|apikey|api_secret|password|passwd|pwd|secret|token|key)\s*[=:]\s*["']|[a-z]+://)"""
MASK_END = """["']$"""
#: Else this many characters of a match of at least so many, and none of a shorter one.
MASK_KEEP, MASK_LEAST = 4, 12
#: Characters that belong to a secret if they follow the match.
MASK_TAIL = "[A-Za-z0-9+/_=-]*"


def secret_pattern(patterns) -> str:
    """One pattern for the places that any of the patterns matches."""
    return f"(?:{'|'.join(f'(?:{p})' for p in patterns)}){MASK_TAIL}"


def mask_matches(snippet: Column, patterns) -> Column:
    """The snippet with every match of the patterns hidden: what was found decides, not what it looks like."""
    def hidden(match: Column) -> Column:
        head = F.regexp_extract(match, java_regex(MASK_HEAD), 0)
        known = F.when(head != "", head).when(F.char_length(match) >= MASK_LEAST, F.left(match, F.lit(MASK_KEEP))).otherwise("")
        return F.concat(known, F.lit("****"), F.when(head != "", F.regexp_extract(match, MASK_END, 0)).otherwise(""))

    found = F.regexp_extract_all(snippet, F.lit(java_regex(secret_pattern(patterns))), F.lit(0))
    return F.aggregate(found, snippet, lambda text, match: F.replace(text, match, hidden(match)))
