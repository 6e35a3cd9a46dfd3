"""URL, host and repository-address columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.text import any_of
from riskloom.packs.policy import Policy

URL = r"""https?://[^\s"'<>]+"""
INSTALLER_URL = r"""https?://[^\s'"`]+"""
# Fixed value: commands run by code rather than shown to a reader.
EXEC_CONTEXT = (
    r"(?i)(?:subprocess\.|os\.system|os\.popen|os\.exec|check_call|check_output|\bPopen\b|shell\s*=\s*true"
    r"|\beval\(|\bexec\(|child_process|execSync|spawnSync|\bsystem\()"
)


def urls(text: Column) -> Column:
    return F.when(
        F.contains(text, F.lit("http")), F.regexp_extract_all(text, F.lit("(?d)" + URL), 0)
    ).otherwise(F.array().cast("array<string>"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"https?://([^/\s:]+)", 1))


def hosts(text: Column) -> Column:
    found = F.transform(urls(text), host_of)
    return F.array_distinct(F.filter(found, lambda h: h != ""))


def targets_known_installer(text: Column, policy: Policy) -> Column:
    """A URL of the text points to an allow-listed host or one of its subdomains."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit("(?d)" + INSTALLER_URL), 0), host_of)
    return F.exists(
        found,
        lambda h: any_of([(h == d) | h.endswith("." + d) for d in policy.known_installer_domains]),
    )


REPOSITORY_PREFIX = r"^(?i:(?:https?://)?(?:www\.)?github\.com/)"


def repository_owner_and_name(url: Column) -> Column:
    """struct<owner, repo> of a repository address; null when it is not a valid one."""
    path = F.regexp_replace(F.regexp_replace(F.trim(url), REPOSITORY_PREFIX, ""), r"/+$", "")
    parts = F.split(path, "/")
    owner = F.get(parts, F.lit(0))
    repo = F.regexp_replace(F.get(parts, F.lit(1)), r"(?:\.git)+$", "")
    kind = F.get(parts, F.lit(2))
    valid = (
        F.trim(url).rlike(REPOSITORY_PREFIX)
        & owner.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?$")
        & repo.rlike(r"^[A-Za-z0-9._-]{1,100}$")
        & ~repo.isin(".", "..")
        & (kind.isNull() | (kind.isin("tree", "blob") & (F.size(parts) >= 4)))
    )
    return F.when(valid, F.struct(owner.alias("owner"), repo.alias("repo")))


def canonical_repository_url(url: Column) -> Column:
    parsed = repository_owner_and_name(url)
    return F.when(
        parsed.isNotNull(), F.concat(F.lit("https://github.com/"), parsed["owner"], F.lit("/"), parsed["repo"])
    )


def owner_label(url: Column) -> Column:
    owner = F.regexp_extract(url, r"github\.com/([^/]+)", 1)
    return F.when(url == "local", F.lit("local")).when(owner == "", F.lit("unknown")).otherwise(owner)
