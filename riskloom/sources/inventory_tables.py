"""Inventory tables derived from the star schema, in SQL that Spark and the check engine both read.

`{name}` stands for a base table or for one of the tables defined here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from riskloom.sources.derived import spread

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def repo(key: str) -> str:
    return f"concat('https://github.com/owner', {s(f'{key} % 50')}, '/repo', {s(f'{key} % 200')})"


TABLES = {
    "stored": f"""
SELECT o_orderkey AS ord, concat('b', {s('o_orderkey')}) AS id,
  CASE WHEN o_orderkey % 7 = 0 THEN 'local' ELSE {repo('o_custkey')} END AS repository_url,
  concat('packs/p', {s('o_orderkey % 300')}) AS file_path, concat('Bundle ', {s('o_custkey % 400')}) AS name,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('about ', lower(o_orderpriority)) END AS description,
  concat('c', {s('o_custkey % 700')}) AS checksum, o_orderkey % 3 = 0 AS installed, o_orderdate AS installed_at,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 101 AS INT) END AS score, o_orderkey % 7 = 0 AS local_only,
  concat('/home/u', {s('o_custkey % 100')}, '/.claude/skills/p', {s('o_orderkey')},
    CASE WHEN o_orderkey % 2 = 0 THEN concat(',/home/u', {s('o_custkey % 100')}, '/.codex/skills/p', {s('o_orderkey')}) ELSE '' END) AS paths,
  CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 'claude-code,codex' ELSE 'claude-code' END AS tools,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('1.', {s('o_custkey % 9')}, '.0') END AS version
FROM {{orders}}""",
    "fresh": f"""
SELECT concat('n', {s('min(o_orderkey)')}) AS id, repository_url, file_path, max(name) AS name, max(checksum) AS checksum
FROM (SELECT o_orderkey, {repo('o_custkey')} AS repository_url,
    concat('packs/p', {s('CASE WHEN o_orderkey % 5 = 2 THEN o_orderkey % 300 + 1000 ELSE o_orderkey % 300 END')}) AS file_path,
    concat('Bundle ', {s('o_custkey % 400')}) AS name,
    concat('c', {s('CASE WHEN o_orderkey % 6 = 1 THEN o_custkey % 700 + 7 ELSE o_custkey % 700 END')}) AS checksum
  FROM {{orders}} WHERE o_orderkey % 7 <> 0) t GROUP BY repository_url, file_path""",
    "commits": f"""
SELECT {repo('l_partkey')} AS repo, concat('packs/p', {s('l_orderkey % 300')}) AS path, l_orderkey * 10 + l_linenumber AS seq,
  md5(concat('k', {s('l_orderkey')}, '-', {s('l_linenumber')}, '-', {s('l_partkey')})) AS sha FROM {{lineitem}}""",
    "installs": f"""
SELECT concat({s('l_orderkey')}, '-', {s('l_linenumber')}, '-', {s('l_partkey')}, '-', {s('l_suppkey')}) AS id, {repo('l_partkey')} AS repo,
  concat('packs/p', {s('CASE WHEN l_suppkey % 6 = 5 THEN (l_orderkey + 1) % 300 ELSE l_orderkey % 300 END')}) AS path,
  CASE l_suppkey % 6 WHEN 0 THEN sha WHEN 1 THEN substring(sha, 1, 7) WHEN 2 THEN substring(sha, 1, 6) WHEN 3 THEN NULL
    WHEN 4 THEN concat('ffff', substring(sha, 1, 10)) ELSE sha END AS installed_sha
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    md5(concat('k', {s('l_orderkey')}, '-', {s('l_linenumber')}, '-', {s('l_partkey')})) AS sha FROM {{lineitem}}) t""",
    "plugins": f"""
SELECT p_partkey AS ord, concat('p', {s('p_partkey')}) AS id, concat('Bundle ', {s('p_partkey % 600')}) AS name,
  CASE WHEN p_partkey % 9 = 0 THEN 'claude-plugins-official' ELSE concat('market', {s('p_size')}) END AS marketplace,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE {repo('p_partkey')} END AS repository_url, p_partkey % 4 = 1 AS installed,
  CASE WHEN p_partkey % 4 = 1 THEN concat({s('p_size % 4')}, '.', {s('p_size % 7')}, '.', {s('p_partkey % 3')}) END AS installed_version,
  CASE WHEN p_partkey % 10 = 7 THEN NULL ELSE concat('ext-', {s('p_partkey')}) END AS external_id,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 101 AS INT) END AS score, p_type AS description
FROM {{part}}""",
    "available": f"""
SELECT p_partkey AS ord, concat('ext-', {s('p_partkey')}) AS plugin_id, concat('bundle ', {s('p_partkey % 600')}) AS name,
  CASE WHEN p_partkey % 9 = 0 THEN 'claude-plugins-official' ELSE concat('market', {s('p_size')}) END AS marketplace,
  CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 5 THEN concat({s('p_size % 4')}, '.', {s('p_size % 7')}, '.', {s('p_partkey % 3')})
    ELSE concat({s('p_size % 4 + 1')}, '.0.0') END AS version
FROM {{part}}""",
    "installed_list": f"""
SELECT concat('ext-', {s('CASE WHEN p_partkey % 6 = 5 THEN p_partkey + 1000000 ELSE p_partkey END')}) AS external_id,
  concat({s('p_size % 3')}, '.1.0') AS version, p_partkey % 2 = 0 AS enabled FROM {{part}} WHERE p_size % 3 <> 1""",
    "marketplaces": f"""
SELECT concat('market', {s('s_suppkey % 50')}) AS name, concat('owner', {s('s_suppkey')}, '/market') AS repo,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE md5({s('s_suppkey')}) END AS local_head,
  CASE WHEN s_suppkey % 3 = 0 THEN md5(concat('x', {s('s_suppkey')})) ELSE md5({s('s_suppkey')}) END AS remote_head,
  s_acctbal AS bytes FROM {{supplier}}""",
    "repositories": f"""
SELECT c_custkey AS ord, concat('r', {s('c_custkey')}) AS id,
  CASE c_custkey % 8 WHEN 0 THEN concat('https://github.com/owner', {s('c_custkey % 90')}, '/repo', {s('c_custkey % 60')})
    WHEN 1 THEN concat('http://www.github.com/owner', {s('c_custkey % 90')}, '/repo', {s('c_custkey % 60')}, '.git')
    WHEN 2 THEN concat(' github.com/owner', {s('c_custkey % 90')}, '/repo', {s('c_custkey % 60')}, '/ ')
    WHEN 3 THEN concat('https://GitHub.com/owner', {s('c_custkey % 90')}, '/repo', {s('c_custkey % 60')}, '/tree/main')
    WHEN 4 THEN concat('https://github.com/-bad', {s('c_custkey')}, '/repo')
    WHEN 5 THEN concat('https://gitlab.com/owner', {s('c_custkey')}, '/repo')
    WHEN 6 THEN concat('https://github.com/owner', {s('c_custkey % 90')}, '/repo', {s('c_custkey % 60')}, '/issues/1')
    ELSE concat('https://github.com/owner', {s('c_custkey % 90')}) END AS url,
  c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS description,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey * 100 AS BIGINT) END AS cached_bytes, CAST(c_custkey % 5 = 0 AS BOOLEAN) AS never_scanned
FROM {{customer}}""",
    "linked_bundles": f"""
SELECT concat('b', {s('o_orderkey')}) AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'local' WHEN o_orderkey % 9 = 1 THEN concat('http://github.com/stray/', {s('o_custkey')})
    ELSE url END AS repository_url, o_orderkey % 3 = 0 AS installed
FROM {{orders}} JOIN {{repositories}} r ON r.ord = o_custkey""",
    "linked_plugins": f"""
SELECT concat('p', {s('p_partkey')}) AS id, CASE WHEN p_partkey % 6 <> 0 THEN url END AS repository_url, p_name AS name
FROM {{part}} LEFT JOIN {{repositories}} r ON r.ord = p_partkey % 120 + 1""",
    "featured": f"""
SELECT concat('https://github.com/owner', {s('s_suppkey % 90')}, '/repo', {s('s_suppkey % 60')}) AS url, s_name AS name FROM {{supplier}}""",
    "tools": f"""
SELECT p_partkey AS ord, concat('tool', {s('p_partkey % 700')}) AS id, concat(
    CASE p_partkey % 9 WHEN 0 THEN '/opt/homebrew/bin/' WHEN 1 THEN '/home/a/.npm-global/bin/' WHEN 2 THEN 'C:\\Users\\a\\AppData\\Local\\pnpm\\'
      WHEN 3 THEN '/usr/local/Cellar/x/' WHEN 4 THEN 'C:\\Users\\a\\scoop\\shims\\' WHEN 5 THEN concat('/srv/env', {s('(p_partkey - p_partkey % 36)')}, '/lib/python3/site-packages/bin/')
      WHEN 6 THEN concat('C:\\env', {s('(p_partkey - p_partkey % 36)')}, '\\Python39\\Scripts\\') WHEN 7 THEN '/srv/app/node_modules/.bin/' ELSE '/usr/bin/' END,
    CASE WHEN p_partkey % 9 NOT IN (5, 6) OR p_partkey % 4 = 3 THEN concat('tool', {s('p_partkey')}) WHEN p_partkey % 4 = 0 THEN 'pip3.9'
      WHEN p_partkey % 4 = 1 THEN 'pip3' WHEN p_partkey % 9 = 5 THEN 'pip' ELSE 'pip.exe' END) AS detected_path,
  concat('@scope/tool', {s('p_partkey % 300')}) AS package_name,
  CASE p_partkey % 7 WHEN 0 THEN concat('v', {s('p_size')}, '.1') WHEN 1 THEN concat({s('p_size')}, '.1.0-beta.2') WHEN 2 THEN 'nightly'
    WHEN 3 THEN NULL WHEN 4 THEN concat({s('p_size')}, '.1.0+build7') WHEN 5 THEN concat({s('p_size')}, '_2') ELSE concat({s('p_size')}, '.1.0') END AS current_version,
  CASE p_partkey % 5 WHEN 0 THEN concat({s('p_size')}, '.1.0') WHEN 1 THEN concat({s('p_size')}, '.1.0-beta.11') WHEN 2 THEN concat('V', {s('p_size')}, '.1')
    WHEN 3 THEN concat({s('p_size + 1')}, '.0') ELSE concat({s('p_size')}, '.1.0-rc') END AS latest_version,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS description,
  CASE WHEN p_partkey % 4 = 0 THEN 'failed' END AS update_status, p_partkey * 60 AS checked_minute
FROM {{part}}""",
    "new_tools": f"""
SELECT detected_path, id, package_name, current_version, concat({s('ord % 5')}, '.9.0') AS latest_version, ord % 2 = 0 AS update_available,
  CASE WHEN ord % 4 = 1 THEN 'new text' END AS description FROM {{tools}} WHERE ord % 3 <> 2
UNION ALL SELECT concat(detected_path, '-new'), id, package_name, current_version, latest_version, false, description FROM {{tools}} WHERE ord % 8 = 0""",
    "scan_results": f"""
SELECT concat('b', {s('o_orderkey')}) AS bundle_id, CAST(o_custkey % 101 AS INT) AS score, o_orderdate AS scanned_at, o_orderpriority AS note FROM {{orders}}
UNION ALL SELECT concat('b', {s('o_orderkey + 1')}), CAST(o_custkey % 77 AS INT), o_orderdate, o_orderstatus FROM {{orders}} WHERE o_orderkey % 3 = 0""",
}


def needed(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", TABLES[name])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a derived one."""
    if name in BASE:
        base = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(base, base.columns[0])
    text = TABLES[name].replace("\\", "\\\\")
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in needed(name)})


def check_sql(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", TABLES[name])
