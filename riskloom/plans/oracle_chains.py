"""Check SQL for chains and taint: joins between matching lines instead of array arithmetic."""

from __future__ import annotations

from riskloom.functions.urls import EXEC_CONTEXT, INSTALLER_URL
from riskloom.operators import chains as C
from riskloom.operators import taint as X
from riskloom.packs.policy import DEFAULT_POLICY as P
from riskloom.plans.oracle_core import cte, inlist, q, rm

cte("ctargets", ("files",), r"""
SELECT bundle_id, rel_path, ext, is_main, replace(
  CASE WHEN is_main THEN regexp_replace(front, '[^\n]', '', 'g') || content[len(front) + 1:] ELSE content END,
  chr(13) || chr(10), chr(10)) AS content
FROM (SELECT *, regexp_extract(content, '(?s)^\s*---.*?\n---', 0) AS front FROM files
      WHERE is_main OR (file_type = 'script' AND NOT is_binary AND NOT is_doc_path))
""")

_flags = {
    "fetches": C.FETCH, "pipe_exec": C.PIPE_EXEC, "exec_cmd": C.EXEC_COMMAND, "exec_bare": C.EXEC_BARE,
    "chmod_x": C.CHMOD_X, "fetch_url": C.FETCH_URL, "to_file": C.FETCH_TO_FILE, "sens_read": C.SENSITIVE_READ,
    "sens_path": C.SENSITIVE_PATH, "b64": C.BASE64, "b64_dec": C.BASE64_DECODE, "net_send": C.NET_SEND,
    "net_out": C.NET_OUT, "env_print": C.ENV_PRINT, "env_secret": C.ENV_SECRET,
}
cte("cflags", ("ctargets",), "SELECT *, " + ", ".join(f"{rm('line', p)} AS {n}" for n, p in _flags.items()) + """ FROM (
 SELECT * FROM (SELECT bundle_id, rel_path, ext, is_main, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_no, unnest(ls) AS line, len(ls) AS n
   FROM (SELECT *, string_split(content, chr(10)) AS ls FROM ctargets)) WHERE NOT (line_no = n AND line = ''))""")

KEY = "bundle_id, rel_path, ext, is_main"


def after(first: str, second: str, span: int, agg: str = "min") -> str:
    """Lines matching `first` with the nearest (or last) line matching `second` within the span."""
    return (
        f"SELECT a.bundle_id, a.rel_path, a.ext, a.is_main, a.line_no AS s, {agg}(b.line_no) AS e "
        f"FROM cflags a JOIN cflags b ON a.bundle_id = b.bundle_id AND a.rel_path = b.rel_path "
        f"AND b.line_no BETWEEN a.line_no + 1 AND a.line_no + {span} WHERE ({first}) AND ({second}) GROUP BY ALL"
    )


def earliest(sub: str) -> str:
    return f"SELECT {KEY}, min(s) AS s, arg_min(e, s) AS e FROM ({sub}) GROUP BY ALL"


def on_content(pattern: str) -> str:
    return (
        f"SELECT {KEY}, CAST(len(string_split(content[:instr(content, regexp_extract(content, {q(pattern)}, 0)) - 1], chr(10))) AS INTEGER) AS s, "
        f"CAST(NULL AS INTEGER) AS e FROM ctargets WHERE {rm('content', pattern)}"
    )


def same_line(cond: str, end: str = "min(line_no)") -> str:
    return f"SELECT {KEY}, min(line_no) AS s, {end} AS e FROM cflags WHERE {cond} GROUP BY ALL"


RUN = "b.exec_cmd OR b.pipe_exec OR b.exec_bare"
NET = "b.net_send OR b.net_out"
_chmod = (
    "SELECT f.bundle_id, f.rel_path, f.ext, f.is_main, f.line_no AS s, min(m.s) AS c, arg_min(m.e, m.s) AS e FROM cflags f JOIN ("
    + after("a.chmod_x", RUN, C.CHMOD_EXEC_SPAN)
    + f") m ON m.bundle_id = f.bundle_id AND m.rel_path = f.rel_path AND m.s BETWEEN f.line_no + 1 AND f.line_no + {C.CHMOD_SPAN} "
    "WHERE f.fetches AND (f.to_file OR f.fetch_url) GROUP BY ALL"
)
_exfil = (
    "SELECT bundle_id, rel_path, ext, is_main, s, e, enc FROM (SELECT x.*, EXISTS (SELECT 1 FROM cflags b WHERE b.bundle_id = x.bundle_id "
    f"AND b.rel_path = x.rel_path AND b.b64 AND b.line_no BETWEEN x.s + 1 AND x.s + {C.EXFIL_SPAN}) AS enc FROM ("
    + earliest(after("a.sens_read", NET, C.EXFIL_SPAN, "max"))
    + ") x)"
)
_env = (
    "SELECT bundle_id, rel_path, ext, is_main, min(s) AS s, arg_min(coalesce(e, -1), s) AS e FROM ("
    "SELECT a.bundle_id, a.rel_path, a.ext, a.is_main, a.line_no AS s, n.e FROM cflags a LEFT JOIN ("
    + after("a.env_print OR a.env_secret", NET, C.ENV_SEND_SPAN)
    + ") n ON n.bundle_id = a.bundle_id AND n.rel_path = a.rel_path AND n.s = a.line_no "
    "WHERE (a.env_print OR a.env_secret) AND (n.e IS NOT NULL OR a.env_secret)) GROUP BY ALL"
)
_decode = (
    "SELECT bundle_id, rel_path, ext, is_main, min(s) AS s, arg_min(e, s) AS e, arg_min(direct, s) AS direct FROM ("
    "SELECT a.bundle_id, a.rel_path, a.ext, a.is_main, a.line_no AS s, CASE WHEN a.pipe_exec THEN a.line_no ELSE n.e END AS e, a.pipe_exec AS direct "
    "FROM cflags a LEFT JOIN ("
    + after("a.b64_dec", "b.exec_cmd", C.DECODE_EXEC_SPAN)
    + ") n ON n.bundle_id = a.bundle_id AND n.rel_path = a.rel_path AND n.s = a.line_no "
    "WHERE a.b64_dec AND (a.pipe_exec OR n.e IS NOT NULL)) GROUP BY ALL"
)

# (rule, variant, priority within the rule, places)
CANDIDATES = (
    ("PIPELINE_FETCH_EXECUTE", "same_line", 1, same_line("fetches AND pipe_exec")),
    ("PIPELINE_FETCH_EXECUTE", "save_then_run", 2, earliest(after("a.fetches AND a.to_file", RUN, C.FETCH_EXEC_SPAN))),
    ("PIPELINE_DOWNLOAD_CHMOD_EXEC", "chmod", 1, f"SELECT {KEY}, min(s) AS s, arg_min(e, s) AS e FROM ({_chmod}) GROUP BY ALL"),
    ("PIPELINE_SENSITIVE_EXFIL", "read_encode_send", 1, on_content(C.READ_ENCODE_SEND)),
    ("PIPELINE_SENSITIVE_EXFIL", "read_send", 2, on_content(C.READ_SEND)),
    ("PIPELINE_SENSITIVE_EXFIL", "find_send", 3, on_content(C.FIND_KEY_SEND)),
    ("PIPELINE_SENSITIVE_EXFIL", "encode_later", 4, f"SELECT {KEY}, s, e FROM ({_exfil}) WHERE enc"),
    ("PIPELINE_SENSITIVE_EXFIL", "send_later", 5, f"SELECT {KEY}, s, e FROM ({_exfil}) WHERE NOT enc"),
    ("PIPELINE_SENSITIVE_EXFIL", "find_send_later", 6, earliest(after(
        "a.sens_path AND contains(lower(a.line), 'find')", f"({NET}) AND contains(lower(b.line), 'curl')", C.FIND_SEND_SPAN))),
    ("PIPELINE_FIND_EXEC", "exec", 1, on_content(C.FIND_EXEC)),
    ("PIPELINE_FIND_EXEC", "xargs", 2, on_content(C.FIND_XARGS)),
    ("PIPELINE_ENV_HARVEST", "same_line", 1, on_content(C.ENV_SEND)),
    ("PIPELINE_ENV_HARVEST", "send_later", 2, f"SELECT {KEY}, s, e FROM ({_env}) WHERE e > 0"),
    ("PIPELINE_ENV_HARVEST", "secret_only", 3, f"SELECT {KEY}, s, CAST(NULL AS INTEGER) AS e FROM ({_env}) WHERE e < 0"),
    ("PIPELINE_BASE64_EXEC", "same_line", 1, f"SELECT {KEY}, s, e FROM ({_decode}) WHERE direct"),
    ("PIPELINE_BASE64_EXEC", "run_later", 2, f"SELECT {KEY}, s, e FROM ({_decode}) WHERE NOT direct"),
    ("COMPOUND_LAUNDERING_CHAIN", "convert_read", 1,
     "SELECT t.bundle_id, t.rel_path, t.ext, t.is_main, CAST(coalesce(min(CASE WHEN contains(lower(l.line), 'pandoc') THEN l.line_no END), "
     "min(CASE WHEN contains(lower(l.line), 'pdftotext') THEN l.line_no END)) AS INTEGER) AS s, CAST(NULL AS INTEGER) AS e "
     "FROM ctargets t JOIN cflags l ON l.bundle_id = t.bundle_id AND l.rel_path = t.rel_path "
     f"WHERE {rm('t.content', C.DOC_CONVERT)} AND {rm('t.content', C.READ_CONVERTED)} GROUP BY ALL"),
)


def known_installer(text: str) -> str:
    hosts = (
        f"list_transform(regexp_extract_all(lower({text}), {q(INSTALLER_URL)}), "
        "lambda u: regexp_extract(u, 'https?://([^/\\s:]+)', 1))"
    )
    test = " OR ".join(f"x = {q(d)} OR ends_with(x, {q('.' + d)})" for d in P.known_installer_domains)
    return f"len(list_filter({hosts}, lambda x: {test})) > 0"


def chain_sql(rule_ids=tuple(C.RULES)) -> str:
    parts = [
        f"SELECT {q(rule)} AS rule_id, {q(C.RULES[rule][0])} AS category, {q(C.RULES[rule][1])} AS severity0, "
        f"{q(variant)} AS variant, {prio} AS prio, {KEY}, s, e FROM ({sql})"
        for rule, variant, prio, sql in CANDIDATES if rule in rule_ids
    ]
    chosen = (
        "SELECT * FROM (" + " UNION ALL ".join(parts)
        + ") QUALIFY row_number() OVER (PARTITION BY bundle_id, rel_path, rule_id ORDER BY prio) = 1"
    )
    return f"""
SELECT c.bundle_id, c.rel_path, c.ext, c.is_main, c.rule_id, c.category,
  CASE WHEN c.rule_id IN {inlist(C.INSTALLER_RULES)} AND c.severity0 IN ('Critical', 'High') AND {known_installer('coalesce(trim(d.line), chr(32))')}
    AND NOT {rm('trim(d.line)', EXEC_CONTEXT)} AND NOT {rm("coalesce(trim(x.line), '')", EXEC_CONTEXT)} THEN 'Medium' ELSE c.severity0 END AS severity,
  c.variant, CAST(c.s AS INTEGER) AS line_no, CAST(c.e AS INTEGER) AS end_line, trim(d.line) AS snippet
FROM ({chosen}) c
LEFT JOIN cflags d ON d.bundle_id = c.bundle_id AND d.rel_path = c.rel_path AND d.line_no = c.s
LEFT JOIN cflags x ON x.bundle_id = c.bundle_id AND x.rel_path = c.rel_path AND x.line_no = c.e
"""


cte("chain_hits", ("ctargets", "cflags"), chain_sql())

cte("commands", ("cflags",), f"""
SELECT bundle_id, rel_path, ext, is_main, line_no, position, segment,
  lower(regexp_split_to_array(trim(regexp_replace(regexp_replace(segment, {q(X.ENV_PREFIX)}, ''), {q(X.SUDO_PREFIX)}, '')), '\\s+')[1]) AS command
FROM (SELECT bundle_id, rel_path, ext, is_main, line_no, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS position, unnest(parts) AS segment
  FROM (SELECT *, list_filter(list_transform(regexp_extract_all(trim(line), {q(X.SEGMENT)}), lambda s: trim(s)), lambda s: s <> '') AS parts
        FROM cflags WHERE contains(line, '|')) WHERE len(parts) >= 2)
""")


def _mask(table: dict, name: str) -> str:
    return "CASE " + " ".join(f"WHEN {name} = {q(k)} THEN {v}" for k, v in table.items()) + " ELSE 0 END"


_sends = f"command IN {inlist(X.SENDERS)} AND (" + " OR ".join(f"contains(segment, {q(f)})" for f in X.SEND_FLAGS) + ")"
_runs = f"command IN {inlist(X.INTERPRETERS)}"
cte("flows", ("commands",), f"""
SELECT * FROM (
 SELECT *, CASE
   WHEN {_runs} AND (taints & 12) <> 0 THEN ['TAINT_CMD_INJECTION', 'CmdInjection', 'High']
   WHEN {_runs} AND (taints & 1) <> 0 THEN ['TAINT_CMD_INJECTION', 'CmdInjection', 'Medium']
   WHEN {_runs} AND (taints & 2) <> 0 THEN ['TAINT_CMD_INJECTION', 'CmdInjection', 'High']
   WHEN command = 'tee' AND (taints & 1) <> 0 THEN ['TAINT_DATA_EXFIL', 'Network', 'Medium']
   WHEN {_sends} AND (taints & 1) <> 0 THEN ['TAINT_DATA_EXFIL', 'Network', 'Critical']
   WHEN {_sends} AND (taints & 8) <> 0 THEN ['TAINT_DATA_EXFIL', 'Network', 'Medium'] END AS verdict
 FROM (SELECT *, bit_or({_mask(X.SOURCES, "split_part(command, '.', 1)")} | {_mask(X.TRANSFORMS, 'command')})
     OVER (PARTITION BY bundle_id, rel_path, line_no ORDER BY position) AS taints FROM commands))
WHERE verdict IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY bundle_id, rel_path, line_no ORDER BY position) = 1
""")

# Text regions (docstrings, block comments) by a recursive walk over the lines that open or close one.
cte("region_lines", ("cflags",), f"""
SELECT *, row_number() OVER (PARTITION BY bundle_id, rel_path ORDER BY line_no) AS step,
  (len(t) - len(replace(t, '\"\"\"', ''))) // 3 AS n_dq, (len(t) - len(replace(t, '''''''', ''))) // 3 AS n_sq,
  NOT {rm('t', EXEC_CONTEXT)} AS plain
FROM (SELECT bundle_id, rel_path, ext, line_no, trim(line) AS t FROM cflags WHERE ext IN {inlist(X.JS_EXTS + X.PYTHON_EXTS)})
WHERE contains(t, '\"\"\"') OR contains(t, '''''''') OR contains(t, '/*') OR contains(t, '*/')
""")


def skipped_sql() -> str:
    """Lines inside a region, as (file, line): walk the marker lines in order."""
    return f"""
WITH RECURSIVE walk AS (
  SELECT bundle_id, rel_path, 0::BIGINT AS step, 0 AS line_no, '' AS open, false AS inert, false AS block FROM (SELECT DISTINCT bundle_id, rel_path FROM region_lines)
  UNION ALL
  SELECT r.bundle_id, r.rel_path, r.step, r.line_no,
    CASE WHEN r.ext IN {inlist(X.JS_EXTS)} THEN '' WHEN w.open <> '' THEN CASE WHEN contains(r.t, w.open) THEN '' ELSE w.open END
         WHEN r.n_dq % 2 = 1 THEN '\"\"\"' WHEN r.n_sq % 2 = 1 THEN '''''''' ELSE '' END,
    CASE WHEN w.open = '' AND (r.n_dq % 2 = 1 OR r.n_sq % 2 = 1) THEN r.plain ELSE w.inert END,
    CASE WHEN r.ext NOT IN {inlist(X.JS_EXTS)} THEN false WHEN w.block THEN NOT contains(r.t, '*/')
         ELSE NOT starts_with(r.t, '//') AND contains(r.t, '/*') AND NOT contains(r.t[instr(r.t, '/*'):], '*/') END
  FROM walk w JOIN region_lines r ON r.bundle_id = w.bundle_id AND r.rel_path = w.rel_path AND r.step = w.step + 1)
SELECT * FROM walk"""


cte("region_states", ("region_lines",), skipped_sql())
cte("taint_hits", ("flows", "cflags", "region_states"), f"""
SELECT bundle_id, rel_path, ext, is_main, rule_id, category, severity, line_no, taints, sink, snippet FROM (
 SELECT *, row_number() OVER (PARTITION BY bundle_id, rel_path, rule_id ORDER BY line_no) AS rn FROM (
  SELECT f.bundle_id, f.rel_path, f.ext, f.is_main, verdict[1] AS rule_id, verdict[2] AS category,
    CASE WHEN verdict[3] IN ('Critical', 'High') AND {known_installer('trim(l.line)')} AND NOT {rm('trim(l.line)', EXEC_CONTEXT)}
      THEN 'Medium' ELSE verdict[3] END AS severity,
    f.line_no, CAST(taints AS INTEGER) AS taints, command AS sink, trim(l.line) AS snippet,
    (SELECT arg_max({{'open': s.open, 'inert': s.inert, 'block': s.block}}, s.step) FROM region_states s
      WHERE s.bundle_id = f.bundle_id AND s.rel_path = f.rel_path AND s.line_no < f.line_no) AS st,
    (SELECT arg_max({{'open': s.open, 'inert': s.inert, 'block': s.block}}, s.step) FROM region_states s
      WHERE s.bundle_id = f.bundle_id AND s.rel_path = f.rel_path AND s.line_no = f.line_no) AS own
  FROM flows f JOIN cflags l ON l.bundle_id = f.bundle_id AND l.rel_path = f.rel_path AND l.line_no = f.line_no)
 WHERE NOT starts_with(snippet, '#')
   AND NOT (ext IN {inlist(X.JS_EXTS)} AND (starts_with(snippet, '//') OR coalesce(st.block, false) OR coalesce(own.block, false)))
   AND NOT (ext IN {inlist(X.PYTHON_EXTS)} AND ((coalesce(st.open, '') <> '' AND st.inert) OR (coalesce(st.open, '') = '' AND coalesce(own.open, '') <> '' AND own.inert))))
WHERE rn = 1
""")
cte("taint_first", ("taint_hits",), """
SELECT * FROM taint_hits
QUALIFY row_number() OVER (PARTITION BY bundle_id, rule_id ORDER BY is_main DESC, rel_path, line_no) = 1
""")
