"""Check SQL for manifests, character and byte checks, consistency, structure, coverage and cross-bundle signals."""

from __future__ import annotations

from riskloom.functions.text import MASK_END, MASK_HEAD, MASK_KEEP, MASK_LEAST, secret_pattern
from riskloom.operators import consistency as K
from riskloom.operators import content_checks as U
from riskloom.operators import coverage as V
from riskloom.operators import cross_bundle as B
from riskloom.operators import findings as FN
from riskloom.operators import references as RF
from riskloom.packs.policy import DEFAULT_POLICY as P
from riskloom.plans.oracle_core import cte, has_any, inlist, lst, q, rm, rm_any
from riskloom.sources.payloads import MANIFESTS


def n_of(text: str, char_class: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, {q(char_class)}, '', 'g')))"


SUSPECT = f"[{U.LOOKALIKES}]"
ZW = f"[{U.ZW}]"

cte("lookalikes", ("files",), f"""
SELECT * FROM (SELECT bundle_id, rel_path, content, {n_of('content', SUSPECT)} AS n_suspect, {n_of('content', '[A-Za-z]')} AS n_latin FROM files)
WHERE n_suspect >= {U.MIN_LOOKALIKES} AND n_latin > 0 AND n_suspect / (n_latin + n_suspect) < {U.LOOKALIKE_SHARE}
""")
cte("zero_widths", ("files",), f"""
SELECT * FROM (SELECT bundle_id, rel_path, content, {n_of('content', ZW)} AS n_zero_width,
  greatest(length(content) // 1000, 1) * {U.ZERO_WIDTH_PER_1000} AS threshold FROM files)
WHERE n_zero_width > threshold
""")
cte("controls", ("files",), f"""
SELECT bundle_id, rel_path, content, {n_of('content', U.C0)} AS n_c0, {n_of('content', U.DEL)} AS n_del, {n_of('content', U.C1)} AS n_c1
FROM files WHERE {rm('content', U.CONTROL)}
""")


def first_line(source: str, pattern: str) -> str:
    return (
        f"(SELECT {{'no': min(p.line_no), 'line': arg_min(p.line, p.line_no)}} FROM plines p "
        f"WHERE p.bundle_id = {source}.bundle_id AND p.rel_path = {source}.rel_path AND {rm('p.line', pattern)})"
    )


def unicode_part(source: str, rule: str, severity: str, pattern: str) -> str:
    return (
        f"SELECT bundle_id, rel_path, {q(rule)} AS rule_id, 'Obfuscation' AS category, {q(severity)} AS severity, "
        f"place.no AS line_no, place.line AS snippet FROM (SELECT *, {first_line('s', pattern)} AS place FROM {source} s)"
    )


cte("unicode_hits", ("lookalikes", "zero_widths", "controls", "plines"), " UNION ALL ".join([
    unicode_part("lookalikes", "HOMOGLYPH_ATTACK", "High", SUSPECT),
    unicode_part("zero_widths", "UNICODE_STEGANOGRAPHY", "Medium", ZW),
    unicode_part("controls", "UNICODE_INVISIBLE_CHARS", "Medium", U.CONTROL_PLACE),
]))
cte("asset_hits", ("plines",), f"""
SELECT bundle_id, rel_path, 'ASSET_PROMPT_INJECTION' AS rule_id, 'PromptInjection' AS category,
  CASE WHEN {rm_any('line', U.PI_STRONG)} THEN 'High' ELSE 'Medium' END AS severity, line_no, line AS snippet
FROM plines WHERE regexp_matches(lower(rel_path), '(assets|templates|references|data)/') AND ({rm_any('line', U.PI_STRONG)} OR {rm('line', U.PI_ROLE)})
UNION ALL
SELECT bundle_id, rel_path, 'ASSET_SUSPICIOUS_URL', 'SocialEngineering', 'Medium', line_no, line
FROM plines WHERE regexp_matches(lower(rel_path), '(assets|templates|references|data)/') AND {rm('line', U.FREE_DOMAIN_URL)}
""")

_sig = " ".join(f"WHEN {rm('code', p)} THEN {q(n)}" for n, p in U.SIGNATURES)
_typed = rf"""
SELECT bundle_id, rel_path, ext, CASE WHEN code = '' THEN 'unknown' {_sig}
  WHEN is_text AND svg_at > 0 AND (txt[svg_at + 4:svg_at + 4] IN ('', ' ', '>', '/') OR regexp_matches(txt[svg_at + 4:], '^\\x0[9ad]')) THEN 'svg'
  WHEN is_text AND regexp_matches(txt, '^(\s|\\x0[9abcd])*(<!doctype html|<html)') THEN 'html'
  WHEN is_text AND starts_with(txt, '#!') THEN CASE WHEN contains(shebang, 'python') THEN 'python-script' WHEN contains(shebang, 'node') THEN 'javascript' ELSE 'shell-script' END
  WHEN is_text THEN 'text' ELSE 'unknown' END AS detected
FROM (
 SELECT *, instr(txt, '<svg') AS svg_at, split_part(txt, '\x0a', 1) AS shebang,
   len(list_filter(pairs, x -> x = '00')) = 0 AND len(list_filter(pairs, x -> x >= '80')) / len(pairs) < 0.30 AS is_text
 FROM (SELECT bundle_id, rel_path, ext, code, regexp_extract_all(code, '..') AS pairs, lower(CAST(unhex(code) AS VARCHAR)) AS txt
       FROM (SELECT *, hex(bytes)[1:{2 * U.SAMPLE_BYTES}] AS code FROM @SOURCE@)))
""".replace("x -> ", "lambda x: ")
cte("typed_blobs", ("blobs",), _typed.replace("@SOURCE@", "blobs"))
cte("typed_files", ("files",), _typed.replace("@SOURCE@", "(SELECT *, encode(content) AS bytes FROM files)"))
_labels = " ".join(f"WHEN ext IN {inlist(e.split())} THEN {q(label)}" for label, e in U.EXPECTED.items())
_foreign = U.FOREIGN + U.IMAGES
_mismatches = f"""
SELECT * FROM (SELECT bundle_id, rel_path, ext, detected, CASE {_labels} ELSE ext || ' file' END AS expected,
  CASE WHEN ext IN {inlist(U.TEXT_EXTS)} AND detected IN {inlist(_foreign)} THEN 'Critical'
    WHEN ext IN {inlist(U.TEXT_EXTS)} AND detected IN ('html', 'svg') THEN 'High'
    WHEN ext IN {inlist(U.PHP_EXTS)} AND detected IN {inlist(_foreign)} THEN 'Critical'
    WHEN ext IN {inlist(U.IMAGE_EXTS)} AND detected IN {inlist(U.FOREIGN + ('shell-script', 'python-script', 'javascript', 'html', 'svg'))} THEN 'High' END AS severity
  FROM @SOURCE@ WHERE ext <> '') WHERE severity IS NOT NULL
"""
cte("mismatches", ("typed_blobs",), _mismatches.replace("@SOURCE@", "typed_blobs"))
cte("file_mismatches", ("typed_files",), _mismatches.replace("@SOURCE@", "typed_files"))

# Manifests: what each of payloads.MANIFESTS says, written down by hand.
# (name, description, allowed tools, compatibility, license); None where the text holds no manifest.
MANIFEST_FACTS = (
    ("@ID@", "Collect and parse json logs from the docker api, then load them into sql", ("Read", "Write", "Bash"), (), "MIT"),
    ("@ID@", "Send and upload parsed json reports from the docker api to a webhook", ("Read", "Shell"), ("os:linux",), "Apache-2.0"),
    ("Bad_Name", "Simple calculator with a template and a quick style", ("Grep",), (), None),
    ("a", "short", (), (), ""),
    ("@ID@", "help tool utility simple basic easy", ("Glob", "file-write"), ("network:required",), None),
    ("double--hyphen", "alpha, beta, gamma, delta, epsilon, zeta, eta, theta", (), (), "MIT"),
    ("@ID@", "tools such as alpha, beta, gamma, delta, epsilon, zeta, eta, theta", (), ("os:any", "note:offline"), "BSD"),
    None,
    ("@ID@", "Do anything, a universal general purpose helper", ("Terminal", "fileread"), (), "MIT"),
    None,
    ("@ID@", "", (), (), "MIT"),
    ("@ID@", "Gather credentials and sync secrets with the docker api json export", (), ("internet:yes",), "MIT"),
    ("@ID@", "Format python code with regex rules and lint it for the docker team", ("Read", "Write", "Bash", "Grep", "Glob"), (), "MIT"),
    ("@ID@", "Collect metrics from the api and load them into sql\n", (), (), "MIT"),
    ("@ID@", "Send the parsed reports\nto a webhook of the api", ("Read", "Write"), ("os:linux", "network:none"), None),
    None,
    None,
    None,
    ("@ID@", "plain text over several lines, of use", (), (), "it's free"),
    None,
)
assert len(MANIFEST_FACTS) == len(MANIFESTS)
_no_list = "CAST([] AS VARCHAR[])"
_facts = " UNION ALL ".join(
    f"SELECT {i} AS variant, {f is not None and 'true' or 'false'} AS has_manifest, "
    + (f"{q(f[0])} AS raw_name, {q(f[1])} AS description, {lst(f[2]) if f[2] else _no_list} AS allowed_tools, {lst(f[3]) if f[3] else _no_list} AS compat, CAST({q(f[4])} AS VARCHAR) AS license"
       if f else "NULL AS raw_name, NULL AS description, CAST(NULL AS VARCHAR[]) AS allowed_tools, CAST(NULL AS VARCHAR[]) AS compat, NULL AS license")
    for i, f in enumerate(MANIFEST_FACTS)
)
cte("bundles", ("files",), f"""
SELECT bundle_id, rel_path, has_manifest, replace(raw_name, '@ID@', bundle_id) AS name, description, allowed_tools, compat, license
FROM files JOIN ({_facts}) f ON f.variant = (doc_id % 20 + doc_id // 200 * 3) % {len(MANIFESTS)} WHERE is_main
""")

# Consistency.
_network = (
    f"({rm_any('content', K.NETWORK)} AND (len(list_filter(regexp_extract_all(content, {q(K.HTTP_URL)}), "
    "lambda u: NOT contains(u, '127.0.0.1') AND NOT contains(u, 'localhost'))) > 0 "
    f"OR ({rm('content', K.SOCKET)} AND NOT contains(content, '127.0.0.1') AND NOT contains(content, 'localhost'))))"
)
_caps = ", ".join(f"CASE WHEN {rm_any('content', p)} THEN {q(n)} END" for n, (_, p) in K.CAPABILITIES.items())
cte("capabilities", ("files",), f"""
SELECT * FROM (SELECT bundle_id, rel_path, unnest(list_filter([{_caps}, CASE WHEN {_network} THEN 'NETWORK' END], lambda x: x IS NOT NULL)) AS capability
FROM files WHERE file_type = 'script' AND NOT is_binary)
""")
_synonym = "CASE " + " ".join(f"WHEN t = {q(a)} THEN {q(b)}" for a, b in K.SYNONYMS.items()) + " ELSE t END"
_levels = " ".join(f"WHEN {q(n)} THEN {q(level)}" for n, (level, _) in K.CAPABILITIES.items())
cte("undeclared", ("capabilities", "bundles"), f"""
SELECT c.bundle_id, c.rel_path,
  CASE WHEN capability = 'NETWORK' THEN 'ALLOWED_TOOLS_NETWORK_USAGE' ELSE 'ALLOWED_TOOLS_' || capability || '_VIOLATION' END AS rule_id,
  CASE WHEN capability = 'NETWORK' THEN 'Network' ELSE 'PolicyViolation' END AS category,
  CASE capability WHEN 'NETWORK' THEN 'Medium' {_levels} END AS severity
FROM capabilities c JOIN bundles b USING (bundle_id)
WHERE len(allowed_tools) > 0 AND (capability = 'NETWORK' OR NOT EXISTS (
  SELECT 1 FROM (SELECT bundle_id, regexp_replace(lower(unnest(allowed_tools)), '[-_ ]', '', 'g') AS t FROM bundles) d
  WHERE d.bundle_id = c.bundle_id AND upper({_synonym}) = c.capability))
""")
cte("contradictions", ("capabilities", "bundles"), f"""
SELECT bundle_id, rule_id, category, 'Medium' AS severity FROM (
  SELECT bundle_id, 'TOOL_ABUSE_UNDECLARED_NETWORK' AS rule_id, 'PolicyViolation' AS category FROM bundles
  WHERE has_manifest AND len(compat) > 0 AND len(list_filter(compat, lambda s: regexp_matches(lower(s), 'network|internet'))) = 0
  UNION ALL SELECT bundle_id, 'SOCIAL_ENG_MISLEADING_DESC', 'SocialEngineering' FROM bundles
  WHERE has_manifest AND {rm('description', K.SIMPLE_FEATURE)})
WHERE bundle_id IN (SELECT bundle_id FROM capabilities WHERE capability = 'NETWORK')
""")
cte("description_metrics", ("bundles",), f"""
SELECT bundle_id, description, CAST(len(words) AS INTEGER) AS n_words,
  CAST(len(list_filter(words, lambda w: w IN {inlist(K.VAGUE_WORDS)})) AS INTEGER) AS n_vague,
  CAST(len(list_filter(words, lambda w: w IN {inlist(K.TECH_WORDS)})) AS INTEGER) AS n_tech,
  CAST(length(description) - length(replace(description, ',', '')) AS INTEGER) AS n_commas,
  {rm_any('description', K.GENERIC)} AS is_generic, regexp_matches(lower(description), 'example|such as|including|e\\.g\\.') AS is_example_list
FROM (SELECT *, list_filter(regexp_split_to_array(lower(description), '\\s+'), lambda w: w <> '') AS words FROM bundles WHERE description <> '')
""")
cte("description_findings", ("description_metrics",), f"""
SELECT bundle_id, 'TRIGGER_OVERLY_GENERIC' AS rule_id, 'SocialEngineering' AS category, 'Medium' AS severity FROM description_metrics WHERE is_generic
UNION ALL SELECT bundle_id, 'TRIGGER_DESCRIPTION_TOO_SHORT', 'SocialEngineering', 'Low' FROM description_metrics WHERE n_words < {K.MIN_WORDS}
UNION ALL SELECT bundle_id, 'TRIGGER_VAGUE_DESCRIPTION', 'SocialEngineering', 'Low' FROM description_metrics WHERE n_vague / n_words > {K.VAGUE_SHARE} AND n_tech < 2
UNION ALL SELECT bundle_id, 'TRIGGER_KEYWORD_BAITING', 'SocialEngineering', 'Medium' FROM description_metrics WHERE n_commas >= {K.BAIT_COMMAS} AND NOT is_example_list
""")

# References.
_refs = " || ".join(f"regexp_extract_all(text, {q(p)}, 1)" for p in RF.PATTERNS)
cte("refs", ("files",), f"""
SELECT DISTINCT bundle_id, rel_path, is_main, reference FROM (
  SELECT bundle_id, rel_path, is_main, regexp_replace(unnest({_refs}), '^\\s+|\\s+$', '', 'g') AS reference
  FROM (SELECT *, replace(content, chr(13) || chr(10), chr(10)) AS text FROM files))
WHERE reference <> '' AND NOT regexp_matches(reference, '^(https?://|ftp://|#|/)') AND NOT contains(reference, '..')
""")
cte("imports", ("files",), f"""
SELECT DISTINCT bundle_id, rel_path, module FROM (
  SELECT bundle_id, rel_path, split_part(CASE WHEN regexp_extract(hit, '^from\\s+(\\S+)', 1) <> '' THEN regexp_extract(hit, '^from\\s+(\\S+)', 1)
    ELSE regexp_extract(hit, 'import\\s+(\\S+)$', 1) END, '.', 1) AS module
  FROM (SELECT bundle_id, rel_path, unnest(regexp_extract_all(content, {q(RF.IMPORT)}, 0)) AS hit FROM files))
WHERE module NOT IN {inlist(RF.STDLIB + RF.THIRD_PARTY)}
""")

# Structure.
cte("orphans", ("files", "refs", "bundles"), """
SELECT bundle_id, rel_path FROM files f WHERE file_type = 'script' AND bundle_id IN (SELECT bundle_id FROM bundles)
  AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.is_main AND r.bundle_id = f.bundle_id
    AND (ends_with(f.rel_path, replace(r.reference, '\\', '/')) OR ends_with(replace(r.reference, '\\', '/'), f.rel_path)))
""")
cte("missing_refs", ("files", "refs"), """
SELECT DISTINCT bundle_id, replace(reference, '\\', '/') AS rel_path FROM refs r WHERE is_main
  AND NOT EXISTS (SELECT 1 FROM files f WHERE f.bundle_id = r.bundle_id
    AND (ends_with(f.rel_path, replace(r.reference, '\\', '/')) OR ends_with(replace(r.reference, '\\', '/'), f.rel_path)))
""")
cte("no_main", ("files",), "SELECT bundle_id FROM files GROUP BY 1 HAVING NOT bool_or(is_main)")
_hidden = "is_hidden AND ext IN"
cte("structure", ("files", "bundles", "orphans", "missing_refs", "no_main"), f"""
SELECT bundle_id, NULL AS rel_path, 'STRUCTURE_MISSING_SKILL_MD' AS rule_id, 'High' AS severity, 'PolicyViolation' AS category FROM no_main
UNION ALL SELECT *, 'PolicyViolation' FROM (
  SELECT bundle_id, rel_path, 'FRONTMATTER_PARSE_ERROR', 'Medium' FROM bundles WHERE NOT has_manifest
  UNION ALL SELECT bundle_id, rel_path, 'STRUCTURE_INVALID_NAME', 'Medium' FROM bundles WHERE name <> ''
    AND NOT (regexp_full_match(name, '[a-z0-9-]+') AND length(name) BETWEEN 2 AND 64 AND NOT starts_with(name, '-') AND NOT ends_with(name, '-') AND NOT contains(name, '--'))
  UNION ALL SELECT bundle_id, rel_path, 'STRUCTURE_NAME_DIR_MISMATCH', 'Medium' FROM bundles WHERE name <> '' AND name <> bundle_id
  UNION ALL SELECT bundle_id, rel_path, 'STRUCTURE_INVALID_DESCRIPTION', 'Medium' FROM bundles WHERE has_manifest AND (strlen(description) < 10 OR strlen(description) > 1024)
  UNION ALL SELECT bundle_id, rel_path, 'MANIFEST_MISSING_LICENSE', 'Low' FROM bundles WHERE has_manifest AND trim(coalesce(license, '')) = ''
  UNION ALL SELECT bundle_id, rel_path, 'STRUCTURE_COMPATIBILITY_TOO_LONG', 'Low' FROM bundles WHERE has_manifest
    AND list_sum(list_transform(compat, lambda s: strlen(trim(regexp_extract(s, '^[^:]+:(.*)$', 1))))) > 500
  UNION ALL SELECT bundle_id, rel_path, 'STRUCTURE_HIDDEN_FILE', 'Medium' FROM files WHERE is_hidden
  UNION ALL SELECT bundle_id, rel_path, 'HIDDEN_EXECUTABLE_SCRIPT', 'High' FROM files WHERE {_hidden} ('py', 'sh', 'bash', 'js', 'ts')
  UNION ALL SELECT bundle_id, rel_path, 'HIDDEN_DATA_FILE', 'Medium' FROM files WHERE {_hidden} ('db', 'sqlite', 'sqlite3', 'env', 'json')
  UNION ALL SELECT bundle_id, rel_path, 'PYCACHE_FILES_DETECTED', 'Low' FROM files WHERE contains(rel_path, '__pycache__/')
  UNION ALL SELECT bundle_id, rel_path, 'STRUCTURE_DISALLOWED_SUBDIR', 'Medium' FROM files WHERE len(list_filter(parts[1:len(parts) - 1], lambda s: s NOT IN {inlist(P.allowed_subdirs)})) > 0
  UNION ALL SELECT bundle_id, rel_path, 'STRUCTURE_DISALLOWED_EXTENSION', 'Medium' FROM files WHERE ext <> '' AND ('.' || ext) NOT IN {inlist(P.allowed_extensions)}
  UNION ALL SELECT bundle_id, rel_path, 'STRUCTURE_BINARY_CONTENT', 'Low' FROM files WHERE is_binary
  UNION ALL SELECT bundle_id, rel_path, 'STRUCTURE_ORPHAN_SCRIPT', 'Low' FROM orphans
  UNION ALL SELECT bundle_id, rel_path, 'STRUCTURE_MISSING_REFERENCE', 'Medium' FROM missing_refs) t(bundle_id, rel_path, rule_id, severity)
WHERE bundle_id NOT IN (SELECT bundle_id FROM no_main)
""")

# Coverage.
cte("classed", ("files",), f"""
SELECT bundle_id, rel_path, size_bytes, file_type, CASE
  WHEN file_type IN ('markdown', 'script', 'config') OR (file_type = 'asset' AND ext IN {inlist(V.TEXT_ASSETS)}) THEN 'readable'
  WHEN ext IN {inlist(V.INERT_ASSETS)} OR (NOT is_binary AND (split_part(lower(parts[-1]), '.', 1) IN {inlist(V.ANCILLARY_STEMS)} OR ext IN {inlist(V.ANCILLARY_EXTS)})) THEN 'ignored'
  WHEN is_binary THEN 'binary' ELSE 'other' END AS class
FROM files
""")
cte("shares", ("classed",), """
SELECT *, round(CASE WHEN total_bytes > 0 THEN readable_bytes / total_bytes * 100 ELSE 100 END, 4) AS share FROM (
  SELECT bundle_id, CAST(sum(CASE WHEN class <> 'ignored' THEN size_bytes ELSE 0 END) AS BIGINT) AS total_bytes,
    CAST(sum(CASE WHEN class = 'readable' THEN size_bytes ELSE 0 END) AS BIGINT) AS readable_bytes,
    count(*) FILTER (class = 'binary') AS n_opaque FROM classed GROUP BY 1)
""")


def coverage_sql(max_files: int, max_bytes: int) -> str:
    return f"""
SELECT bundle_id, rel_path, 'UNANALYZABLE_BINARY' AS rule_id, 'Medium' AS severity, 'PolicyViolation' AS category FROM classed WHERE class = 'binary'
UNION ALL SELECT bundle_id, rel_path, 'OVERSIZED_FILE', 'Info', 'PolicyViolation' FROM classed WHERE size_bytes > {max_bytes}
UNION ALL SELECT bundle_id, NULL, 'LOW_ANALYZABILITY', 'Low', 'PolicyViolation' FROM shares WHERE share < 70 AND n_opaque > 0
UNION ALL SELECT bundle_id, NULL, 'EXCESSIVE_FILE_COUNT', 'Info', 'PolicyViolation' FROM classed GROUP BY bundle_id HAVING count(*) > {max_files}
"""


cte("coverage", ("classed", "shares"), coverage_sql(P.max_files, P.max_scan_bytes))

# Cross-bundle.
cte("texts", ("files", "bundles"), """
SELECT bundle_id, content AS text FROM files WHERE NOT is_binary UNION ALL SELECT bundle_id, description FROM bundles WHERE description <> ''
""")
_flags = {"collects": B.COLLECTOR, "sends": B.SENDER, **{n: (p,) for n, p in B.SHARED_PATTERNS.items()}}
cte("signals", ("texts",), "SELECT bundle_id, " + ", ".join(f"bool_or({rm_any('text', p)}) AS {n}" for n, p in _flags.items()) + " FROM texts GROUP BY 1")
cte("relay", ("signals",), """
SELECT 'CROSS_SKILL_DATA_RELAY' AS rule_id, 'Network' AS category, 'High' AS severity,
  (SELECT count(*) FROM signals WHERE collects) AS n_collectors, (SELECT count(*) FROM signals WHERE sends) AS n_senders
WHERE EXISTS (SELECT 1 FROM (SELECT bundle_id FROM signals WHERE collects LIMIT 2) c JOIN (SELECT bundle_id FROM signals WHERE sends LIMIT 2) s ON c.bundle_id <> s.bundle_id)
""")
cte("shared_domains", ("texts",), f"""
SELECT domain, count(*) AS n_bundles, min(bundle_id) AS first_bundle, max(bundle_id) AS last_bundle FROM (
  SELECT DISTINCT bundle_id, lower(regexp_extract(u, 'https?://([^/\\s:]+)', 1)) AS domain
  FROM (SELECT bundle_id, unnest(regexp_extract_all(text, {q('''https?://[^\\s"'<>]+''')})) AS u FROM texts))
WHERE domain <> '' AND domain NOT IN {inlist(B.COMMON_DOMAINS)} GROUP BY 1 HAVING count(*) >= 2
""")
cte("host_names", ("texts",), f"""
SELECT DISTINCT bundle_id, domain FROM (SELECT bundle_id, lower(regexp_extract(u, 'https?://([^/\\s:]+)', 1)) AS domain
  FROM (SELECT bundle_id, unnest(regexp_extract_all(text, {q('''https?://[^\\s"'<>]+''')})) AS u FROM texts))
WHERE domain <> '' AND domain NOT IN {inlist(B.COMMON_DOMAINS)}
""")
cte("shared_patterns", ("signals",), " UNION ALL ".join(
    f"SELECT {q(n)} AS pattern, count(*) AS n_bundles FROM signals WHERE {n} HAVING count(*) >= 2" for n in B.SHARED_PATTERNS
))
cte("roles", ("bundles",), f"""
SELECT words, collects, sends, count(*) AS n_bundles, min(bundle_id) AS first_bundle, max(bundle_id) AS last_bundle, list(bundle_id) AS members,
  array_to_string(words, ' ') AS context FROM (
  SELECT bundle_id, list_sort(list_filter(regexp_split_to_array(lower(description), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND w NOT IN {inlist(B.STOP_WORDS)})) AS words,
    {has_any('lower(description)', B.COLLECTOR_WORDS)} AS collects, {has_any('lower(description)', B.SENDER_WORDS)} AS sends
  FROM bundles WHERE description <> '') GROUP BY ALL
""")
cte("word_pairs", ("roles",), """
SELECT word_a, word_b, CAST(sum(c) AS BIGINT) AS n_collectors, CAST(sum(s) AS BIGINT) AS n_senders, CAST(sum(c) * sum(s) - sum(b) AS BIGINT) AS n_pairs FROM (
  SELECT x AS word_a, y AS word_b, n_bundles * CAST(collects AS INT) AS c, n_bundles * CAST(sends AS INT) AS s, n_bundles * CAST(collects AND sends AS INT) AS b
  FROM (SELECT *, unnest(list_distinct(words)) AS y FROM (SELECT *, unnest(list_distinct(words)) AS x FROM roles)) WHERE x < y
  UNION ALL
  SELECT x, x, n_bundles * CAST(collects AND again AS INT), n_bundles * CAST(sends AS INT), n_bundles * CAST(collects AND sends AND again AS INT)
  FROM (SELECT *, len(list_filter(words, lambda w: w = x)) > 1 AS again FROM (SELECT *, unnest(list_distinct(words)) AS x FROM roles)))
GROUP BY 1, 2 HAVING sum(c) * sum(s) - sum(b) > 0
""")
cte("corpus", ("relay", "shared_domains", "word_pairs", "shared_patterns"), """
SELECT rule_id, category, severity, 'relay' AS subject FROM relay
UNION ALL SELECT 'CROSS_SKILL_SHARED_URL', 'Obfuscation', 'Medium', domain FROM shared_domains
UNION ALL SELECT 'CROSS_SKILL_COMPLEMENTARY_TRIGGERS', 'SocialEngineering', 'Low', word_a || ' / ' || word_b FROM word_pairs
UNION ALL SELECT 'CROSS_SKILL_SHARED_PATTERN', 'Obfuscation', 'Medium', pattern FROM shared_patterns
""")

# Findings of all analyzers.
_tail = "NULL AS confidence, CAST(NULL AS INTEGER) AS weight, CAST(NULL AS BOOLEAN) AS hard_trigger"
KIND = f"""CASE WHEN {rm('upper(rule_id)', '^(?:' + '|'.join(FN.SECURITY_PREFIXES) + ')')} THEN 'Security'
  WHEN {rm('upper(rule_id)', '^(?:' + '|'.join(FN.AUDITABILITY_PREFIXES) + ')')} THEN 'Auditability'
  WHEN {rm('upper(rule_id)', '^(?:' + '|'.join(FN.STRUCTURE_PREFIXES) + ')')} THEN 'Structure'
  WHEN category = 'Obfuscation' THEN 'Auditability' WHEN category IN ('SocialEngineering', 'PolicyViolation') THEN 'Structure' ELSE 'Security' END"""
_UNION_OF = ("graded", "chain_hits", "taint_first", "unicode_hits", "asset_hits", "undeclared", "contradictions", "description_findings", "coverage", "file_mismatches")
_union = f"""
SELECT * FROM (SELECT *, {KIND} AS kind FROM (
  SELECT bundle_id, rel_path, line_no, rule_id, category, severity, confidence, weight, hard_trigger, snippet, NULL AS analyzer, description FROM graded
  UNION ALL SELECT bundle_id, rel_path, line_no, rule_id, category, severity, {_tail}, snippet, 'chains', NULL FROM chain_hits
  UNION ALL SELECT bundle_id, rel_path, line_no, rule_id, category, severity, {_tail}, snippet, 'taint', NULL FROM taint_first
  UNION ALL SELECT bundle_id, rel_path, line_no, rule_id, category, severity, {_tail}, snippet, 'unicode', NULL FROM unicode_hits
  UNION ALL SELECT bundle_id, rel_path, line_no, rule_id, category, severity, {_tail}, snippet, 'assets', NULL FROM asset_hits
  UNION ALL SELECT bundle_id, rel_path, NULL, 'FILE_MAGIC_MISMATCH', 'Obfuscation', severity, {_tail}, NULL, 'files', NULL FROM file_mismatches
  UNION ALL SELECT bundle_id, rel_path, NULL, rule_id, category, severity, {_tail}, NULL, 'consistency', NULL FROM undeclared
  UNION ALL SELECT bundle_id, NULL, NULL, rule_id, category, severity, {_tail}, NULL, 'consistency', NULL FROM contradictions
  UNION ALL SELECT bundle_id, NULL, NULL, rule_id, category, severity, {_tail}, NULL, 'consistency', NULL FROM description_findings
  UNION ALL SELECT bundle_id, rel_path, NULL, rule_id, category, severity, {_tail}, NULL, 'analyzability', NULL FROM coverage))
"""
cte("all_findings", _UNION_OF, _union + "WHERE kind <> 'Structure'")
cte("all_findings_strict", (*_UNION_OF, "structure"), _union.replace("FROM coverage))", f"FROM coverage UNION ALL SELECT bundle_id, rel_path, NULL, rule_id, category, severity, {_tail}, NULL, 'strict_structure', NULL FROM structure))"))
RANK = "CASE severity WHEN 'Critical' THEN 5 WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 ELSE 1 END"
_hidden = f"""CASE WHEN regexp_extract(m, {q(MASK_HEAD)}, 0) <> '' THEN regexp_extract(m, {q(MASK_HEAD)}, 0) || '****' || regexp_extract(m, {q(MASK_END)}, 0) WHEN length(m) >= {MASK_LEAST} THEN m[:{MASK_KEEP}] || '****' ELSE '****' END"""
MASKED = f"""list_reduce(list_concat([snippet], regexp_extract_all(snippet, {q(secret_pattern(FN.secret_patterns()))}, 0)), lambda t, m: replace(t, m, {_hidden}))"""
cte("findings", ("all_findings",), f"""
SELECT * EXCLUDE (rn) REPLACE ({MASKED} AS snippet) FROM (SELECT *, row_number() OVER (
  PARTITION BY bundle_id, rel_path, rule_id, line_no, coalesce(snippet, '')
  ORDER BY {RANK} DESC, coalesce(hard_trigger, false) DESC, coalesce(weight, -1) DESC, coalesce(snippet, '') DESC) AS rn FROM all_findings) WHERE rn = 1
""")
_defaults = " ".join(f"WHEN {q(s)} THEN {w}" for s, w in FN.DEFAULT_WEIGHT.items())
_factors = " ".join(f"WHEN {q(s)} THEN {w}" for s, w in FN.CONFIDENCE_FACTOR.items())
cte("weighted", ("findings",), f"""
SELECT *, CAST(round(CASE WHEN weight IS NOT NULL AND hard_trigger THEN weight::DOUBLE
  ELSE coalesce(weight, CASE severity {_defaults} END) * CAST(CASE confidence {_factors} ELSE 1.0 END AS DOUBLE) END) AS INTEGER) AS eff,
  coalesce(hard_trigger, false) OR (analyzer IS NOT NULL AND severity = 'Critical') AS blocks
FROM findings
""")


def scores_sql(kinds, source: str = "weighted") -> str:
    keep = f"AND kind IN {inlist(kinds)}" if kinds else ""
    return f"""
SELECT b.bundle_id, CAST(score AS INTEGER) AS score,
  CASE WHEN score >= 90 THEN 'Safe' WHEN score >= 70 THEN 'Low' WHEN score >= 50 THEN 'Medium' WHEN score >= 30 THEN 'High' ELSE 'Critical' END AS level,
  blocked, n_findings, n_security, n_auditability, n_structure
FROM (SELECT bundle_id, coalesce(blocked, false) AS blocked, coalesce(n_findings, 0) AS n_findings, coalesce(n_security, 0) AS n_security,
    coalesce(n_auditability, 0) AS n_auditability, coalesce(n_structure, 0) AS n_structure,
    CASE WHEN blocked THEN least(raw, 29) ELSE raw END AS score
  FROM (SELECT f.bundle_id, c.* EXCLUDE (bundle_id), round(greatest(100 - coalesce(lost, 0), 0)) AS raw FROM (SELECT DISTINCT bundle_id FROM files) f
    LEFT JOIN (SELECT bundle_id, bool_or(blocks) AS blocked, count(*) AS n_findings, count(*) FILTER (kind = 'Security') AS n_security,
        count(*) FILTER (kind = 'Auditability') AS n_auditability, count(*) FILTER (kind = 'Structure') AS n_structure FROM {source} GROUP BY 1) c USING (bundle_id)
    LEFT JOIN (SELECT bundle_id, sum(w * (1 - pow(0.5, n)) / 0.5) AS lost FROM (
        SELECT bundle_id, rule_id, max(eff) AS w, count(DISTINCT coalesce(rel_path, '')) AS n FROM {source} WHERE eff > 0 {keep} GROUP BY ALL) GROUP BY 1) d USING (bundle_id))) b
"""


cte("reports", ("weighted", "files", "classed"), f"""SELECT s.*, partial_scan FROM ({scores_sql(P.score_kinds)}) s
JOIN (SELECT bundle_id, bool_or(class = 'binary') AS partial_scan FROM classed GROUP BY 1) USING (bundle_id)""")
