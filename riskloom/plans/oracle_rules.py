"""Check SQL for lines, rule hits, grading, deduplication and scores."""

from __future__ import annotations

from riskloom.functions.text import BACKSLASH_EXTS, BACKTICK_EXTS, PLUS_EXTS
from riskloom.functions.urls import EXEC_CONTEXT, INSTALLER_URL
from riskloom.operators import rule_scan as R
from riskloom.operators import findings as FN
from riskloom.packs.loader import builtin_rules
from riskloom.packs.policy import DEFAULT_POLICY as P
from riskloom.plans.oracle_core import cte, has_any, inlist, q, rm, rm_any

MARKDOWN = "(ext IN ('md', 'markdown', 'mdx') OR is_main)"

# Logical lines by gaps and islands over the physical lines.
cte("slines", ("plines",), rf"""
WITH flagged AS (
  SELECT *,
    ext IN {inlist(BACKSLASH_EXTS)} AND {rm('line', r'\\\s*$')} AS by_slash,
    ext IN {inlist(BACKTICK_EXTS)} AND {rm('line', r'`\s*$')} AS by_tick,
    ext IN {inlist(PLUS_EXTS)} AND regexp_matches(line, '["'']\s*\+\s*$') AS by_plus
  FROM plines),
grouped AS (
  SELECT *, by_slash OR by_tick OR by_plus AS goes_on,
    sum(CASE WHEN before THEN 0 ELSE 1 END) OVER (PARTITION BY bundle_id, rel_path ORDER BY line_no) AS grp
  FROM (SELECT *, coalesce(lag(by_slash OR by_tick OR by_plus) OVER (PARTITION BY bundle_id, rel_path ORDER BY line_no), false) AS before
        FROM flagged)),
pieces AS (
  SELECT *, CASE WHEN goes_on THEN regexp_replace(piece0, '\s*[\\`+]\s*$', '') ELSE piece0 END AS piece
  FROM (SELECT *, CASE WHEN before THEN regexp_replace(line, '^\s+', '') ELSE line END AS piece0 FROM grouped))
SELECT bundle_id, rel_path, any_value(ext) AS ext, any_value(is_main) AS is_main, any_value(is_doc_path) AS is_doc_path,
  min(line_no) AS line_no,
  regexp_replace(string_agg(piece, ' ' ORDER BY line_no), '["'']\s*\+\s*["'']', '', 'g') AS line
FROM pieces GROUP BY bundle_id, rel_path, grp
""")


def applies(rule) -> str:
    if not rule.file_types:
        return "true"
    return f"(is_main OR ('.' || ext) IN {inlist(rule.file_types)})"


def line_case(rule) -> str:
    return (
        f"CASE WHEN {applies(rule)} AND {rm_any('line', rule.line_patterns)}"
        f" AND NOT {rm_any('line', rule.excludes)} THEN {q(rule.rule_id)} END"
    )


def content_case(rule) -> str:
    options = []
    for p in rule.content_patterns:
        found = f"regexp_extract(content, {q(p)}, 0)"
        options.append(
            f"CASE WHEN {rm('content', p)} AND NOT {rm_any(found, rule.excludes)} THEN "
            f"{{'rule_id': {q(rule.rule_id)}, 'line_no': CAST(len(string_split(content[:instr(content, {found}) - 1], chr(10))) AS INTEGER),"
            f" 'snippet': {found}}} END"
        )
    return f"CASE WHEN {applies(rule)} THEN coalesce({', '.join(options)}) END"


cte("raw_line_hits", ("slines",), f"""
SELECT * FROM (
  SELECT bundle_id, rel_path, ext, is_main, is_doc_path, line_no, line AS snippet,
    unnest(list_filter([{', '.join(line_case(r) for r in builtin_rules() if r.line_patterns)}], lambda x: x IS NOT NULL)) AS rule_id
  FROM slines WHERE line <> '')
""")

cte("content_hits", ("files",), f"""
SELECT bundle_id, rel_path, ext, is_main, is_doc_path, hit.line_no AS line_no, hit.snippet AS snippet, hit.rule_id AS rule_id FROM (
  SELECT bundle_id, rel_path, ext, is_main, is_doc_path,
    unnest(list_filter([{', '.join(content_case(r) for r in builtin_rules() if r.content_patterns)}], lambda x: x IS NOT NULL)) AS hit
  FROM files)
""")

# The context tests as joins from a hit to the neighbouring physical lines.
_near = (
    "SELECT h.bundle_id, h.rel_path, h.line_no, string_agg(p.line, chr(10) ORDER BY p.line_no) AS win "
    "FROM raw_line_hits h JOIN plines p ON p.bundle_id = h.bundle_id AND p.rel_path = h.rel_path "
    "AND p.line_no BETWEEN h.line_no {low} AND h.line_no {high} WHERE h.rule_id = {rule} GROUP BY ALL"
)
cte("shell_window", ("raw_line_hits", "plines"), _near.format(low="+ 0", high=f"+ {R.SHELL_TRUE_LINES - 1}", rule=q("SUBPROCESS_CALL")))
cte("exec_window", ("raw_line_hits", "plines"), _near.format(low=f"- {R.EXEC_LOOKBACK}", high="+ 0", rule=q(R.PACKAGE_INSTALL)))
cte("statement_head", ("raw_line_hits", "plines"), f"""
SELECT h.bundle_id, h.rel_path, h.line_no, arg_max(trim(p.line), p.line_no) AS head
FROM raw_line_hits h JOIN plines p ON p.bundle_id = h.bundle_id AND p.rel_path = h.rel_path
  AND p.line_no BETWEEN h.line_no - {R.HEAD_LOOKBACK} AND h.line_no
WHERE h.rule_id = {q(R.PACKAGE_INSTALL)} AND trim(p.line) <> '' AND NOT regexp_matches(trim(p.line), '^[rRbBfFuU]{{0,2}}["'']')
GROUP BY ALL
""")
cte("loop_exit", ("raw_line_hits", "plines"), f"""
SELECT bundle_id, rel_path, loop_no AS line_no,
  min(CASE WHEN is_exit AND NOT is_out THEN line_no END) AS exit_no, min(CASE WHEN is_out THEN line_no END) AS out_no
FROM (SELECT h.bundle_id, h.rel_path, h.line_no AS loop_no, p.line_no,
    len(regexp_extract(p.line, '^\\s*', 0)) <= len(regexp_extract(o.line, '^\\s*', 0)) AS is_out,
    {rm('trim(p.line)', R.LOOP_EXIT)} AS is_exit
  FROM raw_line_hits h
  JOIN plines o ON o.bundle_id = h.bundle_id AND o.rel_path = h.rel_path AND o.line_no = h.line_no
  JOIN plines p ON p.bundle_id = h.bundle_id AND p.rel_path = h.rel_path AND p.line_no > h.line_no
  WHERE h.rule_id = 'RESOURCE_ABUSE_INFINITE_LOOP' AND trim(p.line) <> '')
GROUP BY ALL
""")
_quote_open = (
    "regexp_matches(regexp_replace(regexp_replace(regexp_extract(pl.line, "
    + q("(?i)^(.*?)" + R.INSTALL_COMMAND.replace("(?i)", "")) + ", 1), '\\\\.', '', 'g'), "
    + q("""'[^']*'|"[^"]*\"""") + ", '', 'g'), " + q("""['"]""") + ")"
)
cte("line_verdicts", ("raw_line_hits", "plines", "shell_window", "exec_window", "statement_head", "loop_exit"), f"""
SELECT h.*, CASE
  WHEN h.rule_id = {q(R.PACKAGE_INSTALL)} AND {MARKDOWN} THEN CASE WHEN NOT is_main THEN 'documentation' END
  WHEN h.rule_id = {q(R.PACKAGE_INSTALL)} THEN CASE WHEN h.ext IN {inlist(R.SOURCE_EXTS)} AND {rm('pl.line', R.INSTALL_COMMAND)}
      AND {_quote_open} AND {rm('sh.head', R.DISPLAY_STATEMENT)} AND NOT {rm('ew.win', EXEC_CONTEXT)} THEN 'display_text' END
  WHEN h.rule_id IN ('SVG_EMBEDDED_SCRIPT', 'PDF_EMBEDDED_JAVASCRIPT') THEN CASE WHEN {MARKDOWN} THEN 'markdown' END
  WHEN h.rule_id = 'DATA_EXFIL_JS_FS_ACCESS' THEN CASE WHEN NOT {has_any('lower(pl.line)', R.SENSITIVE_TARGETS)} THEN 'no_sensitive_target' END
  WHEN h.rule_id = 'RESOURCE_ABUSE_INFINITE_LOOP' THEN CASE WHEN le.exit_no < coalesce(le.out_no, 2147483647) THEN 'loop_exits' END
  WHEN h.rule_id = 'SUBPROCESS_CALL' THEN CASE WHEN NOT {rm('lower(sw.win)', r'shell\s*=\s*true')} THEN 'no_shell' END
  WHEN h.rule_id = 'PROMPT_INJECTION_CONCEALMENT' THEN CASE WHEN {has_any('lower(pl.line)', R.CONCEALMENT_EXCEPTIONS)} THEN 'instruction_to_user' END
  END AS reason
FROM (SELECT r.* FROM raw_line_hits r) h
LEFT JOIN (SELECT bundle_id, rel_path, line_no, line FROM plines) pl USING (bundle_id, rel_path, line_no)
LEFT JOIN shell_window sw USING (bundle_id, rel_path, line_no)
LEFT JOIN exec_window ew USING (bundle_id, rel_path, line_no)
LEFT JOIN statement_head sh USING (bundle_id, rel_path, line_no)
LEFT JOIN loop_exit le USING (bundle_id, rel_path, line_no)
""")

_columns = "bundle_id, rel_path, ext, is_main, is_doc_path, line_no, snippet, rule_id"
cte("rule_hits", ("line_verdicts", "content_hits"), f"""
SELECT {_columns} FROM line_verdicts WHERE reason IS NULL
UNION ALL SELECT {_columns} FROM content_hits
""")

_hard = dict(P.hard_trigger_overrides)
cte("rules", (), "SELECT * FROM (VALUES " + ", ".join(
    f"({q(r.rule_id)}, {q(r.category)}, {q(r.severity)}, {q(r.confidence)}, {r.weight}, "
    f"{str(_hard.get(r.rule_id, r.hard_trigger)).lower()}, {q(r.cwe_id)}, {q(r.description)})" for r in builtin_rules()
) + ") t(rule_id, category, severity0, confidence, weight0, hard0, cwe_id, description)")

_suppress = " OR ".join(
    f"(h.rule_id = {q(r.rule_id)} AND o.rule_id IN {inlist(r.suppressed_by)})" for r in builtin_rules() if r.suppressed_by
)
cte("kept_hits", ("rule_hits",), f"""
SELECT h.* FROM rule_hits h WHERE NOT EXISTS (
  SELECT 1 FROM rule_hits o WHERE o.bundle_id = h.bundle_id AND o.rel_path = h.rel_path AND o.line_no = h.line_no AND ({_suppress}))
""")

_hosts = (
    f"list_transform(regexp_extract_all(lower(snippet), {q(INSTALLER_URL)}), "
    "lambda u: regexp_extract(u, 'https?://([^/\\s:]+)', 1))"
)
KNOWN_INSTALLER = "len(list_filter({hosts}, lambda x: {test})) > 0".format(
    hosts=_hosts,
    test=" OR ".join(f"x = {q(d)} OR ends_with(x, {q('.' + d)})" for d in P.known_installer_domains),
)


def graded_sql(source: str) -> str:
    return f"""
WITH first_step AS (
  SELECT *, rule_id = {q(R.PACKAGE_INSTALL)} AND is_main AS notice,
    rule_id IN {inlist(R.INSTALLER_RULES)} AND {KNOWN_INSTALLER} AND NOT {rm('snippet', EXEC_CONTEXT)} AS installer
  FROM {source} JOIN rules USING (rule_id)),
second_step AS (
  SELECT *, CASE WHEN notice THEN 'Info' WHEN installer AND severity0 IN ('Critical', 'High') THEN 'Medium' ELSE severity0 END AS severity1,
    CASE WHEN notice THEN 0 WHEN installer THEN least(weight0, {R.INSTALLER_WEIGHT}) ELSE weight0 END AS weight1,
    hard0 AND NOT notice AND NOT installer AS hard1, is_doc_path AND NOT is_main AS in_docs
  FROM first_step)
SELECT bundle_id, rel_path, ext, is_main, is_doc_path, line_no, snippet, rule_id, category, confidence, cwe_id, description,
  CASE WHEN in_docs AND hard1 AND starts_with(rule_id, 'PROMPT_INJECTION_') THEN
         CASE WHEN severity1 IN ('Critical', 'High') THEN 'Medium' WHEN severity1 = 'Medium' THEN 'Low' ELSE severity1 END
       WHEN in_docs AND NOT hard1 THEN
         CASE severity1 WHEN 'Critical' THEN 'High' WHEN 'High' THEN 'Medium' WHEN 'Medium' THEN 'Low' ELSE severity1 END
       ELSE severity1 END AS severity,
  CAST(CASE WHEN in_docs AND (NOT hard1 OR starts_with(rule_id, 'PROMPT_INJECTION_')) THEN greatest(weight1 // 2, 1) ELSE weight1 END AS INTEGER) AS weight,
  hard1 AND NOT (in_docs AND starts_with(rule_id, 'PROMPT_INJECTION_')) AS hard_trigger
FROM second_step
WHERE NOT (in_docs AND rule_id IN {inlist(P.skip_in_docs)})
"""


cte("graded", ("kept_hits", "rules"), graded_sql("kept_hits"))
cte("graded_lines", ("line_verdicts", "rules"), graded_sql(f"(SELECT {_columns} FROM line_verdicts WHERE reason IS NULL)"))
