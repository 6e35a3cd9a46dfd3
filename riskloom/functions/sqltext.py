"""Expression text for large generated conditions.

A rule pack turns into thousands of expression nodes. Written as text and handed to
`F.expr` once, it is parsed in the JVM in a fraction of the time the same tree takes
when it is assembled call by call from Python.
"""

from __future__ import annotations

from riskloom.packs.loader import MARKS, Need, blank_free_run, java_regex, literal_need, mark_bits, marks_of_any, min_width, rare_start


def quoted(value: str) -> str:
    body = value.replace("\\", "\\\\").replace("$", "\\u0024").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f"'{body}'"


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)


def rlike(text: str, pattern: str) -> str:
    return f"rlike({text}, {quoted(java_regex(pattern))})"


def any_rlike(text: str, patterns) -> str:
    return "(" + " OR ".join(rlike(text, p) for p in patterns) + ")" if patterns else "false"


def any_contains(text: str, literals) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(s)})" for s in literals) + ")" if literals else "false"


def distinct_words(text: str) -> str:
    """The text's pieces between blanks, each once: it holds the same literals without a blank, and is shorter."""
    return f"array_join({word_list(text)}, ' ')"


def word_list(text: str) -> str:
    return f"array_distinct(split({text}, ' '))"


def longest_word(words: str) -> str:
    """Bytes of the longest of the words, 0 without any: no run of characters without a blank has more of them."""
    return f"coalesce(array_max(transform({words}, w -> octet_length(w))), 0)"


def holds(folded: str, need: Need, words: str | None = None) -> str:
    """The folded text holds the literals a pattern needs; those without a blank are looked for in its distinct words, if given."""
    if isinstance(need, str):
        start = rare_start(need)
        return f"contains({words if words and ' ' not in start else folded}, {quoted(start)})"
    if need[0] == "and":
        # The part of fewest literals first: most texts lack it, and the others are not looked for.
        return "(" + " AND ".join(holds(folded, part, words) for part in sorted(need[1], key=literals_of)) + ")"
    return "(" + " OR ".join(holds(folded, part, words) for part in need[1]) + ")"


def literals_of(need: Need) -> int:
    """Literals that are looked for until the need is found wanting."""
    if isinstance(need, str):
        return 1
    counts = [literals_of(part) for part in need[1]]
    return min(counts) if need[0] == "and" else sum(counts)


def possible(folded: str, pattern: str, words: str | None = None, longest: str | None = None) -> str:
    """Cheap necessary condition of a match: literals, else a minimum length, of one word where no blank can match."""
    need = literal_need(pattern)
    if need:
        return holds(folded, need, words)
    if longest and blank_free_run(pattern) > 1:
        return f"{longest} >= {blank_free_run(pattern)}"
    return f"length({folded}) >= {min_width(pattern)}"


def any_possible(folded: str, patterns, words: str | None = None, longest: str | None = None, marks: str | None = None) -> str:
    """Some pattern possibly matches; with a column of marks, each one's own marks are tested before its literals."""
    def test(pattern: str) -> str:
        needed = has_marks([pattern], marks) if marks else "true"
        return possible(folded, pattern, words, longest) if needed == "true" else f"({needed} AND {possible(folded, pattern, words, longest)})"

    return "(" + " OR ".join(test(p) for p in patterns) + ")"


def guarded(text: str, folded: str, patterns) -> str:
    """Some pattern matches, each one tested only where it possibly can."""
    return "(" + " OR ".join(f"({possible(folded, p)} AND {rlike(text, p)})" for p in patterns) + ")"


def marks_column(text: str) -> str:
    """Which marks a text holds, as bits: one short scan each, shared by all rules."""
    return " | ".join(f"if(contains({text}, {quoted(m)}), {mark_bits([m])}, 0)" for m in MARKS)


def has_marks(patterns, marks: str = "marks") -> str:
    """The text holds the marks that all the patterns require."""
    bits = marks_of_any(patterns)
    return f"({marks} & {bits}) = {bits}" if bits else "true"
