"""Load rule packs, reject broken ones and derive the literals a pattern cannot match without."""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from collections import Counter
from functools import lru_cache

from riskloom.packs import core, parity
from riskloom.packs.model import Rule
from riskloom.packs.policy import Policy


class PackError(ValueError):
    pass


def load_packs(*packs: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """Join packs; duplicate ids (within or across packs) and bad patterns are errors."""
    rules = tuple(rule for pack in packs for rule in pack)
    repeated = sorted(k for k, n in Counter(r.rule_id for r in rules).items() if n > 1)
    if repeated:
        raise PackError(f"duplicate rule ids: {', '.join(repeated)}")
    for rule in rules:
        if not rule.patterns:
            raise PackError(f"{rule.rule_id}: no patterns")
        for pattern in rule.patterns + rule.excludes:
            try:
                re.compile(pattern)
            except re.error as err:
                raise PackError(f"{rule.rule_id}: bad pattern {pattern!r}: {err}") from err
    return rules


@lru_cache(maxsize=1)
def builtin_rules() -> tuple[Rule, ...]:
    return load_packs(core.RULES, parity.RULES)


def rules_of(policy: Policy) -> tuple[Rule, ...]:
    """The policy's rules, the disabled ones among them."""
    return policy.rules or builtin_rules()


# Repeated words of a command line (and bytes of a blob), as rules write them, and the same possessively. Java walks a repeated group
# that it may have to give back by recursion, and a line of thousands of flags exhausts a task's stack; a possessive
# group is a loop.
_FLAG = r"(?:-[a-zA-Z]*\s+)*"
_FLAGS = r"(?:-[a-zA-Z]*\s++)*+"
_NO_R = r"(?:-[a-qs-zA-QS-Z]*\s++)*+"  # flags up to the first that holds an r
_WITH_R = r"-[a-zA-Z]*[rR]"
_NC_FLAG = r"(-[a-z]*\s+)*"
_TEE_FLAG = r"(?:(?:-[A-Za-z]+|--(?:append|output-error(?:=\S+)?)|--)\s+)*"
_TEE_TARGET = r"\S*\.ssh/(?:authorized_keys|id_)"


def _end_of_branch(pattern: str, start: int) -> int:
    """Place of the first | outside groups and classes from start on."""
    depth, in_class, i = 0, False, start
    while True:
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            return i
        i += 1


@lru_cache(maxsize=None)
def possessive(pattern: str) -> str:
    """A pattern that matches the same texts and never gives back a word of a command line.

    The words after a run of flags decide where the run has to end, so that end is written out: before the first flag
    with an r, before a target that no flag can be, or before the last word that may be a flag or a host.
    """
    both = _FLAG + "(?:" + _WITH_R
    if both in pattern:
        # flags, then (a flag with r and a target | a target and a flag with r)
        start = pattern.index(both)
        branch = start + len(_FLAG) + len("(?:")
        bar = _end_of_branch(pattern, branch)
        pattern = pattern[:start] + "(?:" + _NO_R + pattern[branch : bar + 1] + _FLAGS + pattern[bar + 1 :]
    pattern = pattern.replace(r"\s+" + _FLAG + _WITH_R, r"\s++" + _NO_R + _WITH_R).replace(_FLAG, _FLAGS)
    pattern = pattern.replace(r"(?:-[a-qs-zA-QS-Z]*\s+)*", _NO_R)
    pattern = pattern.replace(r"(?:0x[0-9a-fA-F]{2}\s*){32,}", r"(?:0x[0-9a-fA-F]{2}\s*+){32,}+")
    pattern = pattern.replace(_NC_FLAG, r"(?:-[a-z]*\s++(?=-))*+(?:-[a-z]*\s+)?")
    return pattern.replace(_TEE_FLAG + _TEE_TARGET, f"(?:(?!{_TEE_TARGET})" + _TEE_FLAG[len("(?:") : -len("+)*")] + "++)*+" + _TEE_TARGET)


def java_regex(pattern: str) -> str:
    """Rule patterns use Unicode classes and a dot that stops at the line feed only."""
    return "(?dU)" + possessive(pattern)


# What a text must hold for a pattern to match: a literal, or ("and" | "or", parts).
Need = str | tuple[str, tuple["Need", ...]]
MAX_PARTS = 4


@lru_cache(maxsize=None)
def literal_need(pattern: str) -> Need | None:
    """Lower-case literals without which the pattern cannot match; None when there are none.

    Used as cheap substring tests in front of the regular expression.
    """
    return _need_of_sequence(list(sre_parser.parse(pattern)))


@lru_cache(maxsize=None)
def min_width(pattern: str) -> int:
    """Length of the shortest possible match."""
    return int(sre_parser.parse(pattern).getwidth()[0])


def _is_blank_free(items) -> bool:
    """The one item of a repeat matches no blank, folded or not."""
    if len(items) != 1:
        return False
    op, arg = items[0]
    if op is sre.LITERAL:
        return arg != ord(" ")
    if op is not sre.IN:
        return False
    return all(
        kind is sre.LITERAL and value != ord(" ") or kind is sre.RANGE and not value[0] <= ord(" ") <= value[1]
        or kind is sre.CATEGORY and value in (sre.CATEGORY_WORD, sre.CATEGORY_DIGIT, sre.CATEGORY_NOT_SPACE)
        for kind, value in arg
    )


@lru_cache(maxsize=None)
def blank_free_run(pattern: str) -> int:
    """So many characters in a row, none of them a blank, stand in every match of the pattern."""
    repeats = (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT)
    return max([int(arg[0]) for op, arg in sre_parser.parse(pattern) if op in repeats and _is_blank_free(list(arg[2]))], default=0)


def _weight(need: Need) -> int:
    """How telling a condition is: the literal's length, the best of an "and", the worst of an "or"."""
    if isinstance(need, str):
        return len(need)
    values = [_weight(part) for part in need[1]]
    return max(values) if need[0] == "and" else min(values)


def _need_of_sequence(items: list) -> Need | None:
    found: list[Need] = []
    run = ""
    for op, arg in items:
        if op is sre.LITERAL and chr(arg).isascii():
            run += chr(arg).lower()
            continue
        if op is sre.AT:
            continue
        if run:
            found.append(run)
            run = ""
        need = _need_of_item(op, arg)
        if need:
            found.append(need)
    if run:
        found.append(run)
    best = sorted(dict.fromkeys(found), key=_weight, reverse=True)[:MAX_PARTS]
    telling = [n for n in best if _weight(n) > 1] or best[:1]
    if len(telling) > 1:
        return ("and", tuple(telling))
    return telling[0] if telling else None


def _need_of_item(op, arg) -> Need | None:
    if op is sre.SUBPATTERN:
        return _need_of_sequence(list(arg[3]))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
        return _need_of_sequence(list(arg[2]))
    if op is sre.BRANCH:
        parts = [_need_of_sequence(list(branch)) for branch in arg[1]]
        if all(parts):
            return ("or", tuple(dict.fromkeys(parts))) if len(set(parts)) > 1 else parts[0]
    return None


# Characters of texts, the most frequent ones first; all others are rarer.
COMMON = " etaoinshrdlcumwfgypbv.,k-"


@lru_cache(maxsize=None)
def rare_start(literal: str) -> str:
    """The end of a literal from its rarest character on, at least two thirds of it and four characters.

    A substring test compares further at each place that has the literal's first character. Where a literal is only what
    a match cannot lack, its end is as well, and it is found to be missing several times faster.
    """
    last = len(literal) - max(4, -(-2 * len(literal) // 3))
    rank = {c: i for i, c in enumerate(COMMON)}
    places = range(max(last, 0) + 1)
    return literal[max(places, key=lambda i: (rank.get(literal[i : i + 1], len(COMMON)), -i)) :]


# Characters that code and commands use and prose mostly does not.
MARKS = "()/\\$=|.:-_+{}[]*~%#@&;<>"


@lru_cache(maxsize=None)
def required_marks(pattern: str) -> frozenset[str]:
    """Marks that occur in every match of the pattern."""
    return _marks_of(list(sre_parser.parse(pattern)))


def _marks_of(items: list) -> frozenset[str]:
    found: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL and chr(arg) in MARKS:
            found.add(chr(arg))
        elif op is sre.SUBPATTERN:
            found |= _marks_of(list(arg[3]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            found |= _marks_of(list(arg[2]))
        elif op is sre.BRANCH:
            found |= frozenset.intersection(*[_marks_of(list(branch)) for branch in arg[1]])
    return frozenset(found)


def mark_bits(marks) -> int:
    return sum(1 << MARKS.index(m) for m in marks)


def marks_of_any(patterns) -> int:
    """Bits of the marks that every one of the patterns requires."""
    return mark_bits(frozenset.intersection(*[required_marks(p) for p in patterns]))
