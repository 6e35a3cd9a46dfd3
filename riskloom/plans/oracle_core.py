"""Shared pieces of the check SQL (DuckDB): the same derived tables, stated in SQL."""

from __future__ import annotations

from riskloom.functions.paths import CLASS_OF_EXT, FILE_CLASSES
from riskloom.packs.policy import DEFAULT_POLICY as P
from riskloom.sources.payloads import BYTE_PREFIXES, DIRS, MANIFESTS, PAYLOADS


def q(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def inlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def rm(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def rm_any(text: str, patterns) -> str:
    return "(" + " OR ".join(rm(text, p) for p in patterns) + ")" if patterns else "false"


def has_any(text: str, literals) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(s)})" for s in literals) + ")"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], sql: str) -> None:
    CTES[name] = (deps, sql)


def with_ctes(names: tuple[str, ...], body: str) -> str:
    """Put the named tables, and what they need, in front of a query."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order) + "\n" + body


def pick(values, index: str) -> str:
    return f"{lst(values)}[CAST({index} AS BIGINT) + 1]"


cte("raw_files", (), f"""
SELECT doc_id, bundle_id,
  CASE WHEN is_main THEN 'SKILL.md' ELSE {pick(DIRS, f'doc_id % {len(DIRS)}')} || 'f' || doc_id || suffix END AS rel_path,
  CASE WHEN is_main THEN replace({pick(MANIFESTS, f'(doc_id % 20 + grp * 3) % {len(MANIFESTS)}')}, '@ID@', bundle_id) || chr(10) || text
       WHEN body IS NULL THEN text
       WHEN doc_id % 3 = 0 THEN body || chr(10) || text
       WHEN doc_id % 3 = 1 THEN text || chr(10) || body
       ELSE text || chr(13) || chr(10) || body || chr(10) END AS content
FROM (
  SELECT doc_id, text, doc_id // 200 AS grp, source || '-' || (doc_id // 200) AS bundle_id,
    ((doc_id // 20) % 10 = 0) AND ((doc_id + doc_id // 200) % 9 <> 4) AS is_main,
    {pick([s for s, _ in PAYLOADS], f'doc_id % {len(PAYLOADS)}')} AS suffix,
    {pick([b for _, b in PAYLOADS], f'doc_id % {len(PAYLOADS)}')} AS body
  FROM documents)
""")

EXT = r"lower(regexp_extract({name}, '^.+\.([^.]*)$', 1))"

_class_case = "CASE " + " ".join(
    f"WHEN ext IN {inlist(exts.split())} THEN {q(name)}" for name, exts in FILE_CLASSES.items()
) + " ELSE 'unknown' END"
assert len(CLASS_OF_EXT) == sum(len(e.split()) for e in FILE_CLASSES.values())

cte("all_files", ("raw_files",), f"""
SELECT *, CASE WHEN declared = 'unknown' AND starts_with(content, '#!') THEN 'script' ELSE declared END AS file_type,
  declared = 'binary' AS is_binary
FROM (
 SELECT *, {_class_case} AS declared FROM (
  SELECT *, {EXT.format(name="parts[-1]")} AS ext, CAST(strlen(content) AS BIGINT) AS size_bytes,
    len(list_filter(parts, lambda s: starts_with(s, '.'))) > 0 AS is_hidden,
    lower(parts[-1]) = 'skill.md' AS is_main,
    len(list_filter(parts, lambda s: (len(parts) >= 2 AND lower(s) IN {inlist(P.doc_path_indicators)})
        OR regexp_matches(lower(s), '^({'|'.join(P.doc_path_indicators)})-'))) > 0 AS is_doc_path
  FROM (SELECT *, string_split(rel_path, '/') AS parts FROM raw_files)))
""")

cte("files", ("all_files",), f"""
SELECT * FROM all_files
WHERE len(list_filter(parts[1:len(parts) - 1], lambda s: s IN {inlist([d for d in P.skip_dirs if d != '__pycache__'])})) = 0
  AND lower(parts[-1]) NOT IN {inlist(P.housekeeping_files)}
""")

cte("blobs", ("raw_files",), f"""
SELECT bundle_id, rel_path, {EXT.format(name="string_split(rel_path, '/')[-1]")} AS ext,
  unhex({pick(BYTE_PREFIXES, f'doc_id % {len(BYTE_PREFIXES)}')}) || encode(content) AS bytes
FROM raw_files
""")

cte("plines", ("files",), r"""
SELECT bundle_id, rel_path, ext, is_main, is_doc_path, file_type, is_binary, size_bytes, line_no, line FROM (
  SELECT bundle_id, rel_path, ext, is_main, is_doc_path, file_type, is_binary, size_bytes,
    CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_no, unnest(ls) AS line, len(ls) AS n
  FROM (SELECT *, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM files))
WHERE NOT (line_no = n AND line = '')
""")
