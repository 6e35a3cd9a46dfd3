"""Version and commit-id comparison columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_PREFIX = 7


def extract_version(text: Column) -> Column:
    found = F.regexp_extract(text, r"v?([0-9]+\.[0-9]+\.[0-9]+)", 1)
    return F.when(found != "", found)


def normalize(version: Column) -> Column:
    return F.regexp_replace(F.trim(version), "^[vV]", "")


def _core(version: Column) -> Column:
    return F.split(F.split(version, r"\+", 2)[0], "-", 2)[0]


def numbers(version: Column) -> Column:
    """Numeric parts as array<bigint>; null for a syntax that is not understood."""
    core = F.replace(_core(version), F.lit("_"), F.lit("."))
    valid = core.rlike(r"^[0-9]{1,18}(?:\.[0-9]{1,18})*+$")
    return F.when(valid, F.transform(F.split(core, r"\."), lambda p: p.cast("bigint")))


def prerelease(version: Column) -> Column:
    """Parts after the first '-', ordered numbers before words; null without one."""
    parts = F.split(F.split(version, r"\+", 2)[0], "-", 2)
    tail = F.get(parts, F.lit(1))

    def part(p: Column) -> Column:
        number = p.rlike("^[0-9]{1,18}$")
        return F.struct(
            (~number).alias("is_word"), F.when(number, p).otherwise("0").cast("bigint").alias("n"),
            F.when(number, "").otherwise(p).alias("word"),
        )

    return F.when(tail.isNotNull(), F.transform(F.split(tail, r"\."), part))


def is_outdated(current: Column, latest: Column) -> Column:
    """current < latest; unknown syntax is no evidence of an update."""
    c, l = normalize(current), normalize(latest)
    cn, ln = numbers(c), numbers(l)
    width = F.greatest(F.size(cn), F.size(ln))
    zero = F.lit(0).cast("bigint")
    cp = F.concat(cn, F.array_repeat(zero, width - F.size(cn)))
    lp = F.concat(ln, F.array_repeat(zero, width - F.size(ln)))
    cpre, lpre = prerelease(c), prerelease(l)
    older_pre = F.when(cpre.isNull(), F.lit(False)).when(lpre.isNull(), F.lit(True)).otherwise(cpre < lpre)
    return F.coalesce((c != l) & ((cp < lp) | ((cp == lp) & older_pre)), F.lit(False))


def same_commit(a: Column, b: Column) -> Column:
    """Equal, or one a prefix of at least seven characters of the other."""
    long_enough = F.least(F.length(a), F.length(b)) >= MIN_PREFIX
    return F.coalesce((a != "") & (b != "") & ((a == b) | (long_enough & (a.startswith(b) | b.startswith(a)))), F.lit(False))
