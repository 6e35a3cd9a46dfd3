"""Queries over the corpus of bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import paths as PT
from riskloom.functions import text as T
from riskloom.functions import urls as UR
from riskloom.operators import (
    chains, consistency, content_checks, coverage, cross_bundle, findings, manifest, references, rule_scan, segments, structure, taint,
)
from riskloom.packs.policy import DEFAULT_POLICY, Policy
from riskloom.plans import oracle_chains, oracle_checks, oracle_rules, scan
from riskloom.plans.oracle_checks import KIND, RANK
from riskloom.plans.oracle_core import cte, inlist, q, rm, with_ctes
from riskloom.plans.registry import add
from riskloom.session import Steps
from riskloom.sources import derived as D
from riskloom.sources import encoding
from riskloom.sources.payloads import BYTE_PREFIXES

FILE_LIMIT, BYTE_LIMIT = 6, 8192
FILE_COLUMNS = ["bundle_id", "rel_path", "ext", "file_type", "size_bytes", "is_binary", "is_hidden", "is_main", "is_doc_path"]
HIT = ["bundle_id", "rel_path", "line_no", "rule_id", "snippet"]
SMALL = Policy(max_files=FILE_LIMIT, max_scan_bytes=BYTE_LIMIT)


def sel(table: str, columns: str = "*", where: str = "") -> str:
    return with_ctes((table,), f"SELECT {columns} FROM {table}" + (f" WHERE {where}" if where else ""))


def bundles(s, d):
    return manifest.bundles(D.files(s, d))


def found(s, d):
    return scan.bundle_findings(D.files(s, d))


def reports(s, d):
    return scan.bundle_reports(D.files(s, d))


# --- files in, scope and limits
add("corpus_files", lambda s, d: D.files(s, d).select(*FILE_COLUMNS), sel("files", ", ".join(FILE_COLUMNS)))
add(
    "out_of_scope_files",
    lambda s, d: D.with_file_columns(D.raw_files(s, d)).select("bundle_id", "rel_path").exceptAll(
        D.files(s, d).select("bundle_id", "rel_path")),
    with_ctes(("files", "all_files"), "SELECT bundle_id, rel_path FROM all_files EXCEPT ALL SELECT bundle_id, rel_path FROM files"),
)
add(
    "readme_and_inert_files",
    lambda s, d: D.files(s, d).select(
        "bundle_id", "rel_path", PT.is_readme(F.col("rel_path")).alias("is_readme"),
        F.col("ext").isin(*DEFAULT_POLICY.inert_extensions).alias("is_inert")).where("is_readme OR is_inert"),
    with_ctes(("files",), f"""SELECT * FROM (SELECT bundle_id, rel_path, regexp_matches(lower(parts[-1]), '^readme\\.(.*\\.)?md$') AS is_readme,
      ext IN {inlist(DEFAULT_POLICY.inert_extensions)} AS is_inert FROM files) WHERE is_readme OR is_inert"""),
)
add("beyond_file_limit", lambda s, d: coverage.beyond_file_limit(D.files(s, d), FILE_LIMIT), with_ctes(("files",), f"""
SELECT bundle_id, rel_path FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY rel_path) AS n FROM files) WHERE n > {FILE_LIMIT}"""))
add("beyond_byte_limit", lambda s, d: coverage.beyond_byte_limit(D.files(s, d), BYTE_LIMIT),
    sel("files", f"bundle_id, rel_path, size_bytes, size_bytes - {BYTE_LIMIT} AS unseen_bytes", f"size_bytes > {BYTE_LIMIT}"))


def utf16_decode(s, d):
    docs = D.read_table(s, d, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 6
    data = (
        F.when(k == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .when(k == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
        .when(k == 2, F.encode("text", "UTF-16LE")).when(k == 3, F.encode("text", "UTF-16BE"))
        .when(k == 4, F.concat(F.unhex(F.lit("0001020304FFFE")), F.encode("text", "UTF-8")))
        .otherwise(F.encode("text", "UTF-8"))
    )
    rows = encoding.with_text(docs.select("doc_id", data.alias("data")), "data")
    return rows.select("doc_id", "kind", "is_binary", F.md5("text").alias("text_md5"))


add("utf16_decode", utf16_decode, """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'le-bom' WHEN 1 THEN 'be-bom' WHEN 2 THEN 'le' WHEN 3 THEN 'be' END AS kind,
  doc_id % 6 = 4 AS is_binary, CASE WHEN doc_id % 6 <> 4 THEN md5(text) END AS text_md5 FROM documents""")
add(
    "symlinks",
    lambda s, d: coverage.symlink_findings(D.raw_files(s, d).withColumn("is_symlink", F.col("rel_path").endswith("7.sh"))),
    with_ctes(("raw_files",), """SELECT bundle_id, rel_path, 'SYMLINK' AS rule_id, 'FileSystem' AS display_category, 'Critical' AS severity
      FROM raw_files WHERE ends_with(rel_path, '7.sh')"""),
)
add("scannable_counts", lambda s, d: coverage.scannable_counts(D.files(s, d)), with_ctes(("files",), f"""
SELECT bundle_id, count(*) AS n_scannable, count(*) > {DEFAULT_POLICY.max_files} AS beyond_limit FROM files
WHERE ext NOT IN {inlist(DEFAULT_POLICY.inert_extensions)} AND NOT regexp_matches(lower(parts[-1]), '^readme\\.(.*\\.)?md$') GROUP BY 1"""))


def discovered(s, d):
    files = D.files(s, d)
    tree = files.select(
        F.split("bundle_id", "-")[0].alias("root"), "is_main",
        F.when(F.split("bundle_id", "-")[1] == "0", F.col("rel_path")).otherwise(F.concat(F.lit("packs/"), "bundle_id", F.lit("/"), "rel_path")).alias("rel_path"),
    )
    return coverage.discover_bundles(tree)


add("discover_bundles", discovered, with_ctes(("files",), """
SELECT split_part(bundle_id, '-', 1) AS root, CASE WHEN split_part(bundle_id, '-', 2) = '0' THEN '.' ELSE 'packs/' || bundle_id END AS directory,
  CASE WHEN split_part(bundle_id, '-', 2) = '0' THEN '.' ELSE bundle_id END AS name FROM files WHERE is_main"""))
add(
    "front_matter",
    lambda s, d: bundles(s, d).select(
        "bundle_id", "has_manifest", "name", "description", F.array_join("allowed_tools", ",").alias("tools"),
        F.array_join(F.transform(F.map_entries("compatibility"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",").alias("compat"),
        "license"),
    sel("bundles", """bundle_id, has_manifest, name, description, array_to_string(allowed_tools, ',') AS tools,
      array_to_string(list_transform(compat, lambda s: trim(regexp_extract(s, '^([^:]+):', 1)) || ':' || trim(regexp_extract(s, '^[^:]+:(.*)$', 1))), ',') AS compat, license"""),
)

# --- lines and rules
add(
    "physical_lines",
    lambda s, d: D.files(s, d).select("bundle_id", "rel_path", F.posexplode(T.physical_lines(F.col("content"))).alias("p", "line"))
    .groupBy("bundle_id", "rel_path").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max(F.length("line")).alias("longest"),
        F.count(F.when(F.trim("line") == "", 1)).alias("n_blank")),
    with_ctes(("plines",), """SELECT bundle_id, rel_path, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, CAST(max(length(line)) AS INTEGER) AS longest,
      count(*) FILTER (trim(line) = '') AS n_blank FROM plines GROUP BY ALL"""),
)
add(
    "logical_lines",
    lambda s, d: rule_scan.prepare(D.files(s, d)).select("bundle_id", "rel_path", F.explode("items").alias("i"))
    .select("bundle_id", "rel_path", "i.line_no", F.md5("i.text").alias("line_md5")),
    sel("slines", "bundle_id, rel_path, line_no, md5(line) AS line_md5", "line <> ''"),
)
add("line_rule_hits", lambda s, d: rule_scan.scan_lines(D.files(s, d)).select(*HIT), sel("line_verdicts", ", ".join(HIT), "reason IS NULL"))
add("content_rule_hits", lambda s, d: rule_scan.scan_content(D.files(s, d)).select(*HIT), sel("content_hits", ", ".join(HIT)))
add("suppressed_by_context", lambda s, d: rule_scan.suppressed_hits(D.files(s, d)).select(*HIT, "reason"),
    sel("line_verdicts", ", ".join(HIT) + ", reason", "reason IS NOT NULL"))
add("suppressed_by_rule", lambda s, d: rule_scan.drop_suppressed_rules(rule_scan.scan_rules(D.files(s, d))).select(*HIT),
    sel("kept_hits", ", ".join(HIT)))
GRADED = HIT + ["category", "severity", "confidence", "weight", "hard_trigger", "cwe_id"]
add("graded_hits", lambda s, d: findings.masked(graded(s, d)).select(*GRADED),
    with_ctes(("graded",), f"SELECT * REPLACE ({oracle_checks.MASKED} AS snippet) FROM (SELECT {', '.join(GRADED)} FROM graded)"))


def graded(s, d, policy=DEFAULT_POLICY):
    return rule_scan.grade_hits(rule_scan.drop_suppressed_rules(rule_scan.scan_rules(D.files(s, d), policy)), policy)


CUSTOM = Policy(disabled_rules=("SUDO", "GENERIC_SECRET"), severity_overrides=(("API_KEY", "Critical"),),
                hard_trigger_overrides=DEFAULT_POLICY.hard_trigger_overrides + (("RM_RF_ROOT", False), ("CHMOD_777", True)))
add(
    "policy_overrides", lambda s, d: graded(s, d, CUSTOM).where("NOT is_doc_path OR is_main").groupBy("rule_id", "severity", "hard_trigger").agg(
        F.count(F.lit(1)).alias("n")),
    with_ctes(("graded",), """SELECT rule_id, CASE WHEN rule_id = 'API_KEY' THEN 'Critical' ELSE severity END AS severity,
      CASE WHEN rule_id = 'RM_RF_ROOT' THEN false WHEN rule_id = 'CHMOD_777' THEN true ELSE hard_trigger END AS hard_trigger, count(*) AS n
      FROM graded WHERE (NOT is_doc_path OR is_main) AND rule_id NOT IN ('SUDO', 'GENERIC_SECRET') GROUP BY ALL"""),
)
add(
    "rule_coverage",
    lambda s, d: rule_scan.rules_table(s).join(
        rule_scan.scan_rules(D.files(s, d)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("bundle_id").alias("n_bundles")),
        "rule_id", "left").select("rule_id", "category", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("n_bundles", F.lit(0)).alias("n_bundles")),
    with_ctes(("rules", "rule_hits"), """SELECT rule_id, any_value(category) AS category, count(h.bundle_id) AS n_hits, count(DISTINCT h.bundle_id) AS n_bundles
      FROM rules LEFT JOIN rule_hits h USING (rule_id) GROUP BY 1"""),
)
add(
    "masked_secrets",
    lambda s, d: findings.masked(graded(s, d).where("category = 'Secrets'")).select(
        "bundle_id", "rel_path", "line_no", "rule_id", F.col("snippet").alias("masked")),
    sel("graded", f"bundle_id, rel_path, line_no, rule_id, {oracle_checks.MASKED} AS masked", "category = 'Secrets'"),
)
add(
    "installer_lines",
    lambda s, d: D.files(s, d).where(F.contains("content", F.lit("http"))).select(
        "bundle_id", "rel_path", F.explode_outer(F.filter(
            F.transform(T.physical_lines(F.col("content")), lambda x, i: F.struct(
                (i + 1).alias("line_no"), F.when(F.contains(x, F.lit("http")), UR.targets_known_installer(x, DEFAULT_POLICY)).alias("known"),
                T.matches(x, UR.EXEC_CONTEXT).alias("run_by_code"))), lambda p: p["known"])).alias("p"))
    .where("p IS NOT NULL").select("bundle_id", "rel_path", "p.line_no", "p.run_by_code"),
    with_ctes(("plines",), f"SELECT bundle_id, rel_path, line_no, {rm('line', UR.EXEC_CONTEXT)} AS run_by_code FROM plines WHERE {oracle_chains.known_installer('line')}"),
)

# --- chains and taint
add(
    "chain_targets", lambda s, d: chains.targets(D.files(s, d)).select("bundle_id", "rel_path", "is_main", F.md5("content").alias("text_md5")),
    sel("ctargets", "bundle_id, rel_path, is_main, md5(content) AS text_md5"),
)
CHAIN = ["bundle_id", "rel_path", "rule_id", "category", "severity", "variant", "line_no", "end_line", "snippet"]
for _name, _rule in (
    ("chain_fetch_execute", "PIPELINE_FETCH_EXECUTE"), ("chain_download_chmod", "PIPELINE_DOWNLOAD_CHMOD_EXEC"),
    ("chain_sensitive_exfil", "PIPELINE_SENSITIVE_EXFIL"), ("chain_find_exec", "PIPELINE_FIND_EXEC"),
    ("chain_env_harvest", "PIPELINE_ENV_HARVEST"), ("chain_base64_exec", "PIPELINE_BASE64_EXEC"),
    ("chain_laundering", "COMPOUND_LAUNDERING_CHAIN"),
):
    add(
        _name, lambda s, d, r=_rule: chains.scan_chains(D.files(s, d), (r,)).select(*CHAIN),
        with_ctes(("ctargets", "cflags"), f"SELECT {', '.join(CHAIN)} FROM ({oracle_chains.chain_sql((_rule,))})"),
    )
add("split_commands", lambda s, d: taint.split_commands(D.files(s, d)), sel("commands", "bundle_id, rel_path, line_no, position, segment, command"))
FLOW = ["bundle_id", "rel_path", "rule_id", "category", "severity", "line_no", "taints", "sink", "snippet"]
add("taint_flows", lambda s, d: taint.scan_taint(D.files(s, d)).select(*FLOW), sel("taint_hits", ", ".join(FLOW)))
add("taint_first_per_bundle", lambda s, d: taint.first_per_bundle(taint.scan_taint(D.files(s, d))).select(*FLOW), sel("taint_first", ", ".join(FLOW)))

# --- the same in segments of lines, as for files too long for a row
SHORT = 40


def segment_lines(s, d, files=None):
    files = D.files(s, d) if files is None else files
    steps = Steps(s, "segments-query")
    return steps.keep(segments.lines_of(files), "lines"), steps


def segmented_taint(s, d):
    lines, steps = segment_lines(s, d, D.files(s, d).where("is_main OR (file_type = 'script' AND NOT is_binary AND NOT is_doc_path)"))
    return segments.taint_hits(lines, steps, length=SHORT)


add("segmented_logical_lines", lambda s, d: segments.logical_lines(*segment_lines(s, d), SHORT).select("bundle_id", "rel_path", "line_no", F.md5("text").alias("line_md5")),
    sel("slines", "bundle_id, rel_path, line_no, md5(line) AS line_md5", "line <> ''"))
add("segmented_rule_hits", lambda s, d: segments.rule_hits(*segment_lines(s, d), length=SHORT).select(*HIT), sel("line_verdicts", ", ".join(HIT), "reason IS NULL"))
add("segmented_taint_flows", lambda s, d: segmented_taint(s, d).select(*FLOW), sel("taint_hits", ", ".join(FLOW)))

# --- characters, bytes, addresses
_shown = (
    "array_to_string(list_transform(regexp_extract_all(content, " + q(oracle_checks.SUSPECT) + ")[1:10], "
    "lambda c: '''' || c || ''' (U+' || printf('%04X', unicode(c)) || ') -> ''' || translate(c, "
    + q(content_checks.LOOKALIKES) + ", " + q(content_checks.TWINS) + ") || ''''), ', ')"
)
add("lookalike_letters", lambda s, d: content_checks.lookalike_stats(D.files(s, d)).drop("content"),
    sel("lookalikes", f"bundle_id, rel_path, CAST(n_suspect AS INTEGER) AS n_suspect, CAST(n_latin AS INTEGER) AS n_latin, {_shown} AS characters"))
add("zero_width_density", lambda s, d: content_checks.zero_width_stats(D.files(s, d)).drop("content"),
    sel("zero_widths", "bundle_id, rel_path, CAST(n_zero_width AS INTEGER) AS n_zero_width, CAST(threshold AS INTEGER) AS threshold"))
add("zero_width_breakdown", lambda s, d: content_checks.zero_width_breakdown(D.files(s, d)), with_ctes(("zero_widths",), f"""
SELECT bundle_id, rel_path, printf('U+%04X', unicode(c)) AS code,
  CASE {' '.join(f'WHEN c = {q(c)} THEN {q(n)}' for c, n in content_checks.ZERO_WIDTH.items())} END AS name, CAST(count(*) AS INTEGER) AS n
FROM (SELECT bundle_id, rel_path, unnest(regexp_extract_all(content, {q(oracle_checks.ZW)})) AS c FROM zero_widths) GROUP BY ALL"""))
add("control_characters", lambda s, d: content_checks.control_stats(D.files(s, d)).drop("content"), sel("controls", "bundle_id, rel_path, " + ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ("n_c0", "n_del", "n_c1"))))
CHECK = ["bundle_id", "rel_path", "rule_id", "category", "severity", "line_no", "snippet"]
add("unicode_findings", lambda s, d: content_checks.scan_unicode(D.files(s, d)).select(*CHECK), sel("unicode_hits", ", ".join(CHECK)))
add("asset_findings", lambda s, d: content_checks.scan_assets(D.files(s, d)).select(*CHECK), sel("asset_hits", ", ".join(CHECK)))
add("content_types", lambda s, d: content_checks.with_content_type(D.blobs(s, d)).select("bundle_id", "rel_path", "ext", "detected"), sel("typed_blobs"))
add("type_mismatches", lambda s, d: content_checks.type_mismatches(D.blobs(s, d)), sel("mismatches"))
add(
    "checksums_and_ids",
    lambda s, d: D.files(s, d).withColumn("checksum", F.sha2("content", 256)).select(
        "bundle_id", "rel_path", "checksum",
        findings.finding_id(F.lit("RULE"), F.col("rel_path"), F.lit(7)).alias("finding_id"),
        F.substring(F.sha2(F.concat_ws(":", "checksum", "rel_path"), 256), 1, 16).alias("local_id")),
    with_ctes(("files",), """SELECT bundle_id, rel_path, sha256(content) AS checksum, sha256('RULE|' || rel_path || '|7')[:16] AS finding_id,
      sha256(sha256(content) || ':' || rel_path)[:16] AS local_id FROM files"""),
)
add(
    "page_url_hosts",
    lambda s, d: D.read_table(s, d, "pages").select("page_id", F.explode(UR.hosts(F.concat_ws(" ", "url", "html"))).alias("host")),
    f"""SELECT DISTINCT page_id, lower(regexp_extract(u, 'https?://([^/\\s:]+)', 1)) AS host
    FROM (SELECT page_id, unnest(regexp_extract_all(concat_ws(' ', url, html), {q('''https?://[^\\s"'<>]+''')})) AS u FROM pages) WHERE host <> ''""",
)
add("name_validity", lambda s, d: bundles(s, d).where("name <> ''").select("bundle_id", "name", structure.is_valid_name(F.col("name")).alias("is_valid")),
    sel("bundles", """bundle_id, name, regexp_full_match(name, '[a-z0-9-]+') AND length(name) BETWEEN 2 AND 64 AND NOT starts_with(name, '-')
      AND NOT ends_with(name, '-') AND NOT contains(name, '--') AS is_valid""", "name <> ''"))
add("file_references", lambda s, d: references.references(D.files(s, d)), sel("refs", "bundle_id, rel_path, reference"))
add("foreign_imports", lambda s, d: references.imports(D.files(s, d)), sel("imports"))


def with_modules(s, d):
    """Give some bundles the modules their scripts import."""
    files = D.files(s, d)
    renamed = F.when(F.col("rel_path").endswith("3.txt"), F.lit("helpers.py")).when(
        F.col("rel_path").endswith("4.txt"), F.lit("f12/__init__.py")).otherwise(F.col("rel_path"))
    return files.withColumn("rel_path", renamed)


add("local_modules", lambda s, d: references.local_modules(with_modules(s, d)), with_ctes(("imports", "files"), """
SELECT DISTINCT i.bundle_id, i.rel_path, m.reference FROM imports i JOIN (
  SELECT bundle_id, CASE WHEN ends_with(rel_path, '3.txt') THEN 'helpers.py' WHEN ends_with(rel_path, '4.txt') THEN 'f12/__init__.py' END AS reference,
  FROM files) m ON m.bundle_id = i.bundle_id AND m.reference IN (i.module || '.py', i.module || '/__init__.py')"""))

# --- declared against used, structure, coverage
add("description_metrics", lambda s, d: consistency.description_metrics(bundles(s, d)), sel("description_metrics"))
add("description_findings", lambda s, d: consistency.description_findings(bundles(s, d)), sel("description_findings"))
add("script_capabilities", lambda s, d: consistency.script_capabilities(D.files(s, d)), sel("capabilities"))
add("undeclared_capabilities", lambda s, d: consistency.undeclared_capabilities(consistency.script_capabilities(D.files(s, d)), bundles(s, d)), sel("undeclared"))
add("network_bundles", lambda s, d: consistency.network_bundles(consistency.script_capabilities(D.files(s, d))),
    sel("capabilities", "DISTINCT bundle_id", "capability = 'NETWORK'"))
add("manifest_contradictions", lambda s, d: consistency.manifest_contradictions(consistency.script_capabilities(D.files(s, d)), bundles(s, d)), sel("contradictions"))
add("orphan_scripts", lambda s, d: structure.orphan_scripts(D.files(s, d)).select("bundle_id", "rel_path"), sel("orphans", "bundle_id, rel_path"))
add("missing_references", lambda s, d: structure.missing_references(D.files(s, d)).select("bundle_id", "rel_path"), sel("missing_refs"))
add("structure_findings", lambda s, d: structure.structure_findings(D.files(s, d), bundles(s, d)), sel("structure"))
def _is_utf8(code: str) -> bool:
    try:
        return bytes.fromhex(code).decode() is not None
    except UnicodeDecodeError:
        return False


# What stands in front of a text decides: the text itself is valid.
_invalid = [i for i, code in enumerate(BYTE_PREFIXES) if not _is_utf8(code)]
add("invalid_utf8", lambda s, d: structure.invalid_utf8(D.blobs(s, d)).select("bundle_id", "rel_path"),
    sel("all_files", "bundle_id, rel_path", f"declared NOT IN ('asset', 'binary') AND doc_id % {len(BYTE_PREFIXES)} IN ({', '.join(map(str, _invalid))})"))
add("readable_share", lambda s, d: coverage.readable_share(D.files(s, d)), sel("shares"))
add("coverage_findings", lambda s, d: coverage.coverage_findings(D.files(s, d), SMALL), with_ctes(("classed", "shares"), oracle_checks.coverage_sql(FILE_LIMIT, BYTE_LIMIT)))
add("file_type_breakdown", lambda s, d: coverage.file_type_breakdown(D.files(s, d), SMALL), with_ctes(("files",), f"""
SELECT bundle_id, CAST(sum(n) AS BIGINT) AS n_files, string_agg(file_type || ': ' || n, ', ' ORDER BY file_type || ': ' || n) AS breakdown
FROM (SELECT bundle_id, file_type, count(*) AS n FROM files GROUP BY ALL) GROUP BY 1 HAVING sum(n) > {FILE_LIMIT}"""))

# --- signals shared between bundles


def texts(s, d):
    files = D.files(s, d)
    return cross_bundle.bundle_texts(files, manifest.bundles(files))


add("bundle_signals", lambda s, d: cross_bundle.bundle_signals(texts(s, d)), sel("signals"))
add("data_relay", lambda s, d: cross_bundle.data_relay(cross_bundle.bundle_signals(texts(s, d))), sel("relay"))
add("shared_domains", lambda s, d: cross_bundle.shared_domains(texts(s, d)), sel("shared_domains"))
add("shared_patterns", lambda s, d: cross_bundle.shared_patterns(cross_bundle.bundle_signals(texts(s, d))), sel("shared_patterns"))
add("complementary_descriptions", lambda s, d: cross_bundle.complementary_descriptions(bundles(s, d)), sel("word_pairs"))
_class = "md5(concat_ws('|', array_to_string(words, ' '), CAST(collects AS VARCHAR), CAST(sends AS VARCHAR)))"
_keys = f"""SELECT x AS word_a, y AS word_b, class_id, collects, sends, first_bundle, last_bundle
  FROM (SELECT *, unnest(list_distinct(words)) AS y FROM (SELECT *, unnest(list_distinct(words)) AS x FROM named)) WHERE x < y
  UNION ALL SELECT x, x, class_id, collects AND len(list_filter(words, lambda w: w = x)) > 1, sends, first_bundle, last_bundle
  FROM (SELECT *, unnest(list_distinct(words)) AS x FROM named)"""
cte("named", ("roles",), f"SELECT *, {_class} AS class_id FROM roles WHERE collects OR sends")
cte("word_keys", ("named",), _keys)
add("complementary_index", lambda s, d: cross_bundle.complementary_index(bundles(s, d)), with_ctes(("word_keys", "word_pairs"), """
SELECT word_a, word_b, class_id, collects, sends FROM word_keys SEMI JOIN word_pairs USING (word_a, word_b) WHERE collects OR sends"""))
add("complementary_members", lambda s, d: cross_bundle.complementary_members(bundles(s, d)), sel("named", "class_id, unnest(members) AS bundle_id"))
add("complementary_examples", lambda s, d: cross_bundle.complementary_examples(bundles(s, d)), with_ctes(("word_keys",), """
SELECT word_a, word_b, CASE WHEN c1 <> s2 THEN c1 ELSE c2 END AS collector, CASE WHEN c1 <> s2 THEN s2 ELSE s1 END AS sender FROM (
  SELECT word_a, word_b, min(first_bundle) FILTER (collects) AS c1, max(last_bundle) FILTER (collects) AS c2, min(first_bundle) FILTER (sends) AS s1, max(last_bundle) FILTER (sends) AS s2
  FROM word_keys GROUP BY ALL) WHERE c1 <> s2 OR c2 <> s1"""))
add("shared_domain_members", lambda s, d: cross_bundle.shared_domain_members(texts(s, d)), sel("host_names", "domain, bundle_id", "domain IN (SELECT domain FROM host_names GROUP BY 1 HAVING count(*) >= 2)"))
add("shared_pattern_members", lambda s, d: cross_bundle.shared_pattern_members(cross_bundle.bundle_signals(texts(s, d))), with_ctes(("signals",), " UNION ALL ".join(
    f"SELECT {q(n)} AS pattern, bundle_id FROM signals WHERE {n} AND (SELECT count(*) FROM signals WHERE {n}) >= 2" for n in cross_bundle.SHARED_PATTERNS)))


def corpus(s, d):
    files = D.files(s, d)
    return cross_bundle.corpus_findings(files, manifest.bundles(files))


add("corpus_findings", lambda s, d: corpus(s, d).select("rule_id", "category", "severity", "subject"), sel("corpus"))


def corpus_rescore(s, d):
    files = D.files(s, d)
    every = files.select("bundle_id").distinct()
    return findings.scores(findings.add_corpus_findings(scan.bundle_findings(files), corpus(s, d), every), bundles=every)


_cross = """(SELECT bundle_id, rel_path, rule_id, eff, kind, blocks FROM weighted UNION ALL
  SELECT b.bundle_id, NULL, c.rule_id, CAST(round(CASE c.severity WHEN 'High' THEN 50 WHEN 'Medium' THEN 25 ELSE 10 END * CAST(0.65 AS DOUBLE)) AS INTEGER), 'Security', false
  FROM (SELECT DISTINCT bundle_id FROM files) b, (SELECT DISTINCT rule_id, severity FROM corpus) c)"""
add("corpus_rescore", corpus_rescore, with_ctes(("weighted", "files", "corpus"), oracle_checks.scores_sql(DEFAULT_POLICY.score_kinds, _cross)))

# --- findings, scores and reports
FINDING = ["bundle_id", "rel_path", "line_no", "rule_id", "category", "severity", "confidence", "weight", "hard_trigger", "snippet", "analyzer", "kind"]
add("findings", lambda s, d: found(s, d).select(*FINDING), sel("findings", ", ".join(FINDING)))
add(
    "cooccurring_rules",
    lambda s, d: findings.with_cooccurring_rules(found(s, d)).where(F.size("same_line_rules") > 0).select(
        "bundle_id", "rel_path", "line_no", "rule_id", F.array_join("same_line_rules", ",").alias("others")),
    with_ctes(("findings",), """SELECT f.bundle_id, f.rel_path, f.line_no, f.rule_id, string_agg(o.rule_id, ',' ORDER BY o.rule_id) AS others
      FROM (SELECT *, row_number() OVER () AS n FROM findings) f JOIN findings o ON o.bundle_id = f.bundle_id
        AND coalesce(o.rel_path, '') = coalesce(f.rel_path, '') AND coalesce(o.line_no, 0) = coalesce(f.line_no, 0) AND o.rule_id <> f.rule_id
      GROUP BY f.n, f.bundle_id, f.rel_path, f.line_no, f.rule_id"""),
)
add("finding_kinds", lambda s, d: graded(s, d).select("rule_id", "category", findings.finding_kind(
    F.col("rule_id"), F.col("category"), F.lit(None).cast("string")).alias("kind")).groupBy("rule_id", "category", "kind").agg(F.count(F.lit(1)).alias("n")),
    with_ctes(("graded",), f"SELECT rule_id, category, {KIND} AS kind, count(*) AS n FROM graded GROUP BY ALL"))
add(
    "display_categories",
    lambda s, d: found(s, d).groupBy(findings.lookup(findings.DISPLAY_CATEGORY, F.col("category")).alias("display_category")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("rule_id").alias("n_rules")),
    with_ctes(("findings",), "SELECT CASE " + " ".join(f"WHEN category = {q(a)} THEN {q(b)}" for a, b in findings.DISPLAY_CATEGORY.items())
              + " END AS display_category, count(*) AS n, count(DISTINCT rule_id) AS n_rules FROM findings GROUP BY 1"),
)
add("bundle_reports", reports, sel("reports"))
add("reports_all_kinds", lambda s, d: findings.scores(found(s, d), None, D.files(s, d).select("bundle_id")),
    with_ctes(("weighted", "files"), oracle_checks.scores_sql(None)))
add("effective_weights", lambda s, d: found(s, d).select(
    "bundle_id", "rel_path", "line_no", "rule_id", findings.effective_weight().alias("eff"), findings.blocks().alias("blocks")),
    sel("weighted", "bundle_id, rel_path, line_no, rule_id, eff, blocks"))
add("severity_counts", lambda s, d: findings.severity_counts(found(s, d)), with_ctes(("findings",), "SELECT bundle_id, " + ", ".join(
    f"count(*) FILTER (severity = {q(v)}) AS n_{v.lower()}" for v in findings.SEVERITY_RANK) + " FROM findings GROUP BY 1"))
add("block_messages", lambda s, d: findings.hard_messages(found(s, d)), with_ctes(("weighted",), """
SELECT DISTINCT bundle_id, concat_ws(': ', rule_id, description) AS message FROM weighted WHERE blocks"""))
_advice = ", ".join(f"CASE WHEN list_contains(cats, {q(c)}) THEN {q(t)} END" for c, t in findings.ADVICE.items())


def advice(s, d):
    files = D.files(s, d)
    f = scan.bundle_findings(files)
    return findings.recommendations(f, findings.scores(f, bundles=files.select("bundle_id")))


add("recommendations", advice, with_ctes(("reports", "findings", "weighted"), f"""
SELECT DISTINCT bundle_id, 'Hard trigger: ' || concat_ws(': ', rule_id, description) AS recommendation FROM weighted WHERE blocks UNION ALL
SELECT bundle_id, unnest(CASE WHEN blocked THEN ['Blocked: hard triggers found.'] WHEN len(lines) = 0 THEN ['No issues found.'] ELSE lines END) AS recommendation
FROM (SELECT bundle_id, blocked, list_filter([CASE WHEN score < 50 THEN 'Severe risk: do not use without review.' WHEN score < 70 THEN 'Medium risk: review before use.' END, {_advice}], lambda a: a IS NOT NULL) AS lines
  FROM reports LEFT JOIN (SELECT bundle_id, list(DISTINCT category) AS cats FROM findings WHERE analyzer IS NULL GROUP BY 1) USING (bundle_id))"""))
add("install_gate", lambda s, d: findings.install_gate(reports(s, d)), with_ctes(("reports", "classed"), """
SELECT bundle_id, reason IS NULL AS installable, reason FROM (SELECT bundle_id, CASE WHEN blocked THEN 'hard_trigger'
  WHEN bundle_id IN (SELECT bundle_id FROM classed WHERE class = 'binary') THEN 'partial_scan' END AS reason FROM reports)"""))
add("top_issues", lambda s, d: findings.top_issues(found(s, d)), with_ctes(("findings",), f"""
SELECT * FROM (SELECT bundle_id, CAST(row_number() OVER (PARTITION BY bundle_id ORDER BY {RANK} DESC, coalesce(rel_path, ''), issue) AS INTEGER) AS position, rel_path, issue, severity
FROM (SELECT bundle_id, rel_path, concat_ws(': ', rule_id, description) AS issue, arg_max(severity, coalesce(line_no, -1) * 10 + {RANK}) AS severity FROM findings GROUP BY ALL)) WHERE position <= 3"""))
add("findings_by_signature", lambda s, d: findings.by_signature(found(s, d)), with_ctes(("findings",), """
SELECT bundle_id, severity, rel_path, rule_id, description, count(*) AS n_places, min(line_no) AS first_line, max(line_no) AS last_line FROM findings GROUP BY ALL"""))
add("signature_members", lambda s, d: findings.signature_members(found(s, d)), with_ctes(("findings",), """
SELECT sha256(concat_ws('|', coalesce(bundle_id, ''), coalesce(severity, ''), coalesce(rel_path, ''), coalesce(rule_id, ''), coalesce(description, '')))[:32] AS signature,
  bundle_id, rel_path, rule_id, line_no FROM findings"""))
ORDERED = ["bundle_id", "rel_path", "line_no", "severity", "rule_id"]
add("findings_in_file_order", lambda s, d: findings.in_file_order(found(s, d)).select(*ORDERED), with_ctes(("findings",), f"""
SELECT {', '.join(ORDERED)} FROM findings ORDER BY bundle_id, coalesce(rel_path, ''), coalesce(line_no, 0), {RANK} DESC, rule_id"""))
add("findings_in_severity_order", lambda s, d: findings.in_severity_order(found(s, d)).select(*ORDERED), with_ctes(("findings",), f"""
SELECT {', '.join(ORDERED)} FROM findings ORDER BY {RANK} DESC, coalesce(rel_path, ''), line_no NULLS LAST, bundle_id, rule_id"""))
_level_rank = "CASE level " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in findings.LEVEL_RANK.items()) + " END"
add("reports_by_level", lambda s, d: reports(s, d).orderBy(findings.lookup(findings.LEVEL_RANK, F.col("level")), "score", "bundle_id").select(
    "bundle_id", "level", "score", findings.tier_of_level(F.col("level")).alias("tier")),
    with_ctes(("reports",), f"""SELECT bundle_id, level, score, CASE WHEN level = 'Critical' THEN 'Severe' WHEN level IN ('High', 'Medium') THEN 'MidHigh' ELSE 'Safe' END AS tier
      FROM reports ORDER BY {_level_rank}, score, bundle_id"""))


def strict(s, d):
    return scan.bundle_findings(D.files(s, d), Policy(strict_structure=True)).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


add("strict_mode_kinds", strict, with_ctes(("all_findings_strict",), f"""
SELECT kind, severity, count(*) AS n FROM (SELECT DISTINCT ON (bundle_id, rel_path, rule_id, line_no, coalesce(snippet, '')) kind, severity FROM all_findings_strict
  ORDER BY bundle_id, rel_path, rule_id, line_no, coalesce(snippet, ''), {RANK} DESC) GROUP BY ALL"""))
