"""Queries over inventory tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import paths as PT
from riskloom.functions import urls as UR
from riskloom.functions import versions as VS
from riskloom.operators import findings as FN
from riskloom.operators import inventory as I
from riskloom.plans import oracle_chains, oracle_checks, oracle_rules  # noqa: F401 (fill the table list)
from riskloom.plans.oracle_core import cte, q, with_ctes
from riskloom.plans.registry import ORACLES, add
from riskloom.plans import scan
from riskloom.session import Steps
from riskloom.sources import catalogue, derived, reports as stored_reports
from riskloom.sources.inventory_tables import TABLES, check_sql, needed, table

for _name in TABLES:
    cte(_name, tuple(n for n in needed(_name) if n in TABLES), check_sql(_name))


def ask(tables, body: str) -> str:
    return with_ctes(tuple(tables), body)


# --- refresh
cte("by_source", ("stored",), "SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY repository_url, file_path ORDER BY installed DESC, ord) = 1")
cte("merged", ("fresh", "by_source"), """
SELECT coalesce(o.id, f.id) AS id, f.repository_url, f.file_path, f.name, f.checksum, coalesce(o.installed, false) AS installed, o.tools, o.version,
  CASE WHEN f.checksum IS NOT DISTINCT FROM o.checksum THEN o.score END AS score, o.id IS NULL AS is_new
FROM fresh f LEFT JOIN by_source o ON o.repository_url = f.repository_url AND o.file_path = f.file_path""")


def merged(s, d):
    return I.merge_scanned(table(s, d, "fresh"), table(s, d, "stored"))


add("stored_by_source", lambda s, d: I.stored_by_source(table(s, d, "stored")).select("repository_url", "file_path", "id", "installed"),
    ask(["by_source"], "SELECT repository_url, file_path, id, installed FROM by_source"))
add("merge_scanned", merged, ask(["merged"], "SELECT * FROM merged"))
add("stale_rows", lambda s, d: I.stale_rows(table(s, d, "stored"), merged(s, d)),
    ask(["stored", "merged"], "SELECT id FROM stored WHERE NOT installed AND id NOT IN (SELECT id FROM merged)"))
add("apply_refresh", lambda s, d: I.apply_refresh(table(s, d, "stored"), merged(s, d)), ask(["stored", "merged"], """
SELECT id, repository_url, file_path, name, checksum, installed, tools, version, score FROM merged
UNION ALL SELECT id, repository_url, file_path, name, checksum, installed, tools, version, score FROM stored WHERE installed AND id NOT IN (SELECT id FROM merged)"""))


def sums(s, d, changed=False):
    files = derived.files(s, d)
    text = F.when(F.col("rel_path").endswith("5.sh"), F.concat("content", F.lit("x"))).otherwise(F.col("content")) if changed else F.col("content")
    return files.select("bundle_id", "rel_path", F.md5(text).alias("checksum"))


def rescan(s, d):
    """Against a run in which some files held one character less and others had other names."""
    now = derived.files(s, d)
    content = F.when(F.col("rel_path").endswith("5.sh"), F.expr("left(content, length(content) - 1)")).otherwise(F.col("content"))
    path = F.when(F.col("rel_path").endswith("4.md"), F.concat("rel_path", F.lit("x"))).otherwise(F.col("rel_path"))
    before = now.select("bundle_id", path.alias("rel_path"), content.alias("content"))
    return I.rescan_needed(I.bundle_checksums(now), I.bundle_checksums(before)).select("bundle_id")


add("rescan_needed", rescan, ask(["files"], "SELECT DISTINCT bundle_id FROM files WHERE ends_with(rel_path, '5.sh') OR ends_with(rel_path, '4.md')"))

# --- updates
add("update_status", lambda s, d: I.update_status(table(s, d, "installs"), table(s, d, "commits")), ask(["installs", "commits"], """
SELECT id, repo, path, status, CASE WHEN status <> 'Unknown' THEN latest_sha END AS latest_sha FROM (
 SELECT *, CASE WHEN coalesce(installed_sha, '') = '' OR latest_sha IS NULL THEN 'Unknown' WHEN direct THEN 'UpToDate' WHEN as_of = latest_sha THEN 'UpToDate' ELSE 'UpdateAvailable' END AS status
 FROM (SELECT i.*, l.latest_sha, coalesce(installed_sha = latest_sha OR (length(installed_sha) >= 7 AND starts_with(latest_sha, installed_sha)), false) AS direct, p.as_of
  FROM installs i LEFT JOIN (SELECT repo, path, arg_max(sha, (seq, sha)) AS latest_sha FROM commits GROUP BY ALL) l USING (repo, path)
  LEFT JOIN (SELECT z.id, arg_max(c.sha, (c.seq, c.sha)) AS as_of FROM (
      SELECT i.id, i.repo, i.path, max(c.seq) AS at FROM installs i JOIN commits c ON c.repo = i.repo AND (c.sha = i.installed_sha OR (length(i.installed_sha) >= 7 AND starts_with(c.sha, i.installed_sha))) GROUP BY ALL) z
    JOIN commits c ON c.repo = z.repo AND c.path = z.path AND c.seq <= z.at GROUP BY 1) p USING (id)))"""))
add("plugin_updates", lambda s, d: I.plugin_updates(table(s, d, "plugins"), table(s, d, "available")), ask(["plugins", "available"], """
SELECT p.id, installed_version, version AS latest FROM plugins p JOIN available a ON a.plugin_id = p.external_id
WHERE installed AND trim(version) <> '' AND trim(installed_version) <> '' AND version <> installed_version"""))
add("marketplace_updates", lambda s, d: I.marketplace_updates(table(s, d, "marketplaces")), ask(["marketplaces"], """
SELECT name, repo, remote_head[:12] AS remote_short FROM marketplaces WHERE local_head IS NOT NULL AND remote_head <> local_head"""))
cte("best_offer", ("available",), f"""SELECT *, lower(name) AS key FROM available
QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY marketplace <> {q(I.OFFICIAL)}, ord) = 1""")
add("best_marketplace", lambda s, d: I.best_marketplace(table(s, d, "available")).select("key", "plugin_id", "marketplace"), ask(["best_offer"], "SELECT key, plugin_id, marketplace FROM best_offer"))
add(
    "upgrade_candidates",
    lambda s, d: I.upgrade_candidates(table(s, d, "stored"), table(s, d, "available"), table(s, d, "plugins"), table(s, d, "marketplaces")),
    ask(["stored", "best_offer", "plugins", "marketplaces"], """
SELECT s.id AS bundle_id, s.name, b.plugin_id, b.marketplace AS marketplace_name, m.repo AS marketplace_repo, b.version AS latest_version
FROM stored s JOIN best_offer b ON b.key = lower(trim(s.name)) LEFT JOIN (SELECT name, min(repo) AS repo FROM marketplaces GROUP BY 1) m ON m.name = b.marketplace
WHERE s.installed AND b.plugin_id NOT IN (SELECT external_id FROM plugins WHERE installed AND external_id IS NOT NULL)"""),
)


def plugins_with_commands(s, d):
    return table(s, d, "plugins").withColumn("marketplace_add_command", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("plugin marketplace add "), "marketplace", F.lit("#"), F.col("ord").cast("string"))))


def upgrade_commands(s, d):
    plugins = plugins_with_commands(s, d)
    found = I.upgrade_candidates(table(s, d, "stored"), table(s, d, "available"), plugins, table(s, d, "marketplaces"))
    return I.upgrade_commands(found, plugins).select("bundle_id", "plugin_id", "marketplace_name", "marketplace_add_command")


add("upgrade_commands", upgrade_commands, ask(["stored", "best_offer", "plugins"], """
SELECT s.id AS bundle_id, b.plugin_id, b.marketplace AS marketplace_name, c.command AS marketplace_add_command
FROM stored s JOIN best_offer b ON b.key = lower(trim(s.name))
LEFT JOIN (SELECT marketplace, 'plugin marketplace add ' || marketplace || '#' || min(ord) AS command FROM plugins WHERE ord % 3 = 0 GROUP BY 1) c ON c.marketplace = b.marketplace
WHERE s.installed AND b.plugin_id NOT IN (SELECT external_id FROM plugins WHERE installed AND external_id IS NOT NULL)"""))


def rescanned_plugins(s, d):
    p = table(s, d, "plugins")
    return p.select(F.when(F.col("ord") % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("x"), "id")).alias("id"), "repository_url", "marketplace", "name")


add("match_plugins", lambda s, d: I.match_plugins(rescanned_plugins(s, d), table(s, d, "plugins")), ask(["plugins"], """
SELECT id, existing_id, was_installed, same_id FROM (SELECT c.id, e.id AS existing_id, e.installed AS was_installed, c.id = e.id AS same_id,
  row_number() OVER (PARTITION BY c.id ORDER BY e.installed DESC, (c.id = e.id) DESC, e.id DESC) AS n
 FROM (SELECT CASE WHEN ord % 2 = 0 THEN id ELSE 'x' || id END AS id, repository_url, marketplace, name FROM plugins) c
 JOIN plugins e ON e.id = c.id OR (e.repository_url IS NOT DISTINCT FROM c.repository_url AND e.marketplace = c.marketplace AND e.name = c.name)) WHERE n = 1"""))
add("sync_installed", lambda s, d: I.sync_installed(table(s, d, "plugins"), table(s, d, "installed_list")), ask(["plugins", "installed_list"], """
SELECT external_id, coalesce(p.id, 'external::' || external_id) AS id, l.version IS NOT NULL AS installed, l.version AS installed_version, l.enabled,
  coalesce(p.installed, false) AND l.version IS NULL AS was_cleared, p.id IS NULL AS is_new
FROM (SELECT * FROM plugins WHERE external_id IS NOT NULL) p FULL JOIN installed_list l USING (external_id)"""))

# --- local state
add(
    "local_modifications",
    lambda s, d: I.local_modifications(sums(s, d), sums(s, d, True).where(~F.col("rel_path").endswith("7.sh"))),
    ask(["files"], """SELECT bundle_id, rel_path, CASE WHEN ends_with(rel_path, '7.sh') THEN 'New' ELSE 'Modified' END AS change
      FROM files WHERE ends_with(rel_path, '7.sh') OR ends_with(rel_path, '5.sh')"""),
)


def found_dirs(s, d):
    st = table(s, d, "stored")
    path = F.when(F.col("ord") % 4 == 0, I.split_list("paths")[0]).when(
        F.col("ord") % 4 == 1, F.concat(F.lit("/moved/p"), F.col("ord").cast("string"))).otherwise(F.concat(F.lit("/other/q"), F.col("ord").cast("string")))
    return st.select(path.alias("path"), "checksum")


add("match_directories", lambda s, d: I.match_directories(found_dirs(s, d), table(s, d, "stored")), ask(["stored"], """
SELECT f.path, coalesce(a.id, b.id, c.id) AS record, CASE WHEN a.id IS NOT NULL THEN 'path' WHEN b.id IS NOT NULL THEN 'name' WHEN c.id IS NOT NULL THEN 'checksum' ELSE 'new' END AS matched_by
FROM (SELECT CASE ord % 4 WHEN 0 THEN split_part(paths, ',', 1) WHEN 1 THEN '/moved/p' || ord ELSE '/other/q' || ord END AS path, checksum FROM stored) f
LEFT JOIN (SELECT p, arg_min(id, ord) AS id FROM (SELECT unnest(string_split(paths, ',')) AS p, id, ord FROM stored) GROUP BY 1) a ON a.p = f.path
LEFT JOIN (SELECT string_split(p, '/')[-1] AS n, arg_min(id, ord) AS id FROM (SELECT unnest(string_split(paths, ',')) AS p, id, ord FROM stored WHERE NOT installed AND local_only) GROUP BY 1) b ON b.n = string_split(f.path, '/')[-1]
LEFT JOIN (SELECT checksum, arg_min(id, ord) AS id FROM stored WHERE NOT installed AND local_only GROUP BY 1) c ON c.checksum = f.checksum"""))


def tool_entries(s, d):
    st = table(s, d, "stored")
    kept = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("z"), "checksum")).otherwise(F.col("checksum"))
    return st.select(F.explode(F.array(F.lit("codex"), F.lit("opencode"))).alias("tool_id"), F.concat(F.lit("p"), F.col("ord").cast("string")).alias("dir_name"), kept.alias("checksum"))


add("linked_tools", lambda s, d: I.linked_tools(table(s, d, "stored"), tool_entries(s, d)),
    ask(["stored"], "SELECT id, 'codex,opencode' AS tools FROM stored WHERE installed AND ord % 5 <> 0"))


def alive(s, d):
    paths = table(s, d, "stored").select(F.explode(I.split_list("paths")).alias("path"))
    return paths.where(~F.col("path").rlike("[37]$"))


add("reconcile_paths", lambda s, d: I.reconcile_paths(table(s, d, "stored"), alive(s, d)), ask(["stored"], """
SELECT id, n_paths, n_alive, first_alive, CASE WHEN n_alive > 0 THEN 'prune' WHEN local_only THEN 'delete' ELSE 'mark_uninstalled' END AS action FROM (
 SELECT id, local_only, count(*) AS n_paths, count(*) FILTER (NOT regexp_matches(p, '[37]$')) AS n_alive, min(p) FILTER (NOT regexp_matches(p, '[37]$')) AS first_alive
 FROM (SELECT id, local_only, unnest(string_split(paths, ',')) AS p FROM stored WHERE installed) GROUP BY ALL) WHERE n_alive < n_paths"""))
add("living_paths", lambda s, d: I.living_paths(table(s, d, "stored"), alive(s, d)), ask(["stored"], """
SELECT id, p AS path FROM (SELECT id, unnest(string_split(paths, ',')) AS p FROM stored WHERE installed) WHERE NOT regexp_matches(p, '[37]$')"""))
add("import_featured", lambda s, d: I.import_featured(table(s, d, "featured"), table(s, d, "repositories")), ask(["featured", "repositories"], """
SELECT f.url, f.name, CASE WHEN e.old IS NULL THEN 'added' WHEN e.old <> f.name THEN 'renamed' ELSE 'skipped' END AS status
FROM featured f LEFT JOIN (SELECT url, arg_min(name, ord) AS old FROM repositories GROUP BY 1) e USING (url)"""))
add("merge_catalogue", lambda s, d: I.merge_catalogue(table(s, d, "plugins"), table(s, d, "available")), ask(["plugins", "available"], """
SELECT p.id, p.name, coalesce(p.installed_version, c.v) AS version, coalesce(p.repository_url, c.m) AS origin FROM plugins p
LEFT JOIN (SELECT lower(name) AS key, arg_max_null(version, ord) AS v, arg_max_null(marketplace, ord) AS m FROM available GROUP BY 1) c ON c.key = lower(p.name)"""))

# --- upserts
add("upsert_tools", lambda s, d: I.upsert_tools(table(s, d, "tools"), table(s, d, "new_tools")), ask(["tools", "new_tools"], """
SELECT coalesce(n.detected_path, o.detected_path) AS detected_path, CASE WHEN n.id IS NULL THEN o.id ELSE n.id END AS id,
  CASE WHEN n.id IS NULL THEN o.package_name ELSE n.package_name END AS package_name, CASE WHEN n.id IS NULL THEN o.current_version ELSE n.current_version END AS current_version,
  CASE WHEN n.id IS NULL THEN o.latest_version ELSE n.latest_version END AS latest_version, CASE WHEN NOT coalesce(n.update_available, false) THEN o.update_status END AS update_status,
  coalesce(n.description, o.description) AS description FROM tools o FULL JOIN new_tools n ON n.detected_path = o.detected_path"""))
add("stale_tools", lambda s, d: I.stale_tools(table(s, d, "tools"), table(s, d, "new_tools"), table(s, d, "tools").where("ord % 4 = 0")), ask(["tools", "new_tools"], """
SELECT detected_path FROM tools WHERE ord % 4 <> 0 AND detected_path NOT IN (SELECT detected_path FROM new_tools)"""))
_owner = r"regexp_extract(path, '^([^/]*)', 1)"
_PATH = "regexp_replace(regexp_replace(trim(url), '^(?i:(https?://)?(www\\.)?github\\.com/)', ''), '/+$', '')"
CANON = f"""CASE WHEN regexp_matches(trim(url), '^(?i:(https?://)?(www\\.)?github\\.com/)') AND regexp_full_match({_PATH}, '[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?/[A-Za-z0-9._-]+(/(tree|blob)/.+)?')
  THEN 'https://github.com/' || split_part({_PATH}, '/', 1) || '/' || regexp_replace(split_part({_PATH}, '/', 2), '(\\.git)+$', '') END"""
add("repository_addresses", lambda s, d: table(s, d, "repositories").select("id", "url", UR.canonical_repository_url(F.col("url")).alias("canonical"), UR.owner_label(F.col("url")).alias("owner")),
    ask(["repositories"], f"""SELECT id, url, {CANON} AS canonical, CASE WHEN regexp_extract(url, 'github\\.com/([^/]+)', 1) = '' THEN 'unknown' ELSE regexp_extract(url, 'github\\.com/([^/]+)', 1) END AS owner FROM repositories"""))
add("canonical_repositories", lambda s, d: I.canonical_repositories(table(s, d, "repositories")), ask(["repositories"], f"""
SELECT c AS url, arg_min(id, o) AS id, arg_min(description, o) FILTER (description IS NOT NULL) AS description, arg_min(cached_bytes, o) FILTER (cached_bytes IS NOT NULL) AS cached_bytes, count(*) AS n_merged
FROM (SELECT *, CASE WHEN url <> c THEN 1000000000 ELSE 0 END + ord AS o FROM (SELECT *, coalesce({CANON}, url) AS c FROM repositories)) GROUP BY 1"""))
add("delete_repository", lambda s, d: I.delete_repository(table(s, d, "stored"), table(s, d, "featured")), ask(["stored", "featured"], """
SELECT id, CASE WHEN gone THEN 'local' ELSE repository_url END AS repository_url, installed FROM (
 SELECT *, repository_url IN (SELECT url FROM featured) AS gone FROM stored) WHERE NOT gone OR installed"""))

# --- views
KEY = "CASE WHEN repository_url = 'local' AND checksum IS NOT NULL THEN 'local::' || lower(trim(name)) || '::' || checksum ELSE 'id::' || id END"
add("merged_groups", lambda s, d: I.merged_groups(table(s, d, "stored")), ask(["stored"], f"""
SELECT group_key, id, description, version, local_only, n_members, coalesce(tools, '') AS tools FROM (
 SELECT group_key, arg_min(id, ord) AS id, arg_min(description, ord) FILTER (description IS NOT NULL) AS description, arg_min(version, ord) FILTER (version IS NOT NULL) AS version,
   bool_and(local_only) AS local_only, count(DISTINCT id) AS n_members FROM (SELECT *, {KEY} AS group_key FROM stored) GROUP BY 1)
LEFT JOIN (SELECT group_key, string_agg(DISTINCT t, ',' ORDER BY t) AS tools FROM (SELECT {KEY} AS group_key, unnest(string_split(tools, ',')) AS t FROM stored) WHERE t <> '' GROUP BY 1) USING (group_key)"""))
add("group_paths", lambda s, d: I.group_paths(table(s, d, "stored")), ask(["stored"], f"""
SELECT DISTINCT {KEY} AS group_key, unnest(string_split(paths, ',')) AS path FROM stored"""))
cte("latest_scans", ("scan_results", "stored"), f"""
SELECT group_key, bundle_id, score, scanned_at, note, local_path FROM (SELECT r.*, split_part(s.paths, ',', 1) AS local_path0, CASE WHEN s.id IS NULL THEN NULL ELSE split_part(s.paths, ',', 1) END AS local_path,
  coalesce(s.group_key, 'id::' || r.bundle_id) AS group_key FROM scan_results r LEFT JOIN (SELECT *, {KEY} AS group_key FROM stored) s ON s.id = r.bundle_id)
QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY scanned_at DESC, score DESC, bundle_id DESC, note DESC) = 1""")


def latest(s, d):
    return I.latest_scans(table(s, d, "scan_results"), table(s, d, "stored"))


LATEST = ["group_key", "bundle_id", "score", "scanned_at", "note", "local_path"]
add("latest_scans", lambda s, d: latest(s, d).select(*LATEST), ask(["latest_scans"], "SELECT * FROM latest_scans"))
cte("everything", ("stored", "plugins"), """
SELECT 'bundle' AS kind, id, name, repository_url, installed, score, NULL AS marketplace, description FROM stored
UNION ALL SELECT 'plugin', id, name, repository_url, installed, score, marketplace, description FROM plugins""")


def everything(s, d):
    return I.everything(table(s, d, "stored"), table(s, d, "plugins"))


add("everything", everything, ask(["everything"], "SELECT * FROM everything"))
add("pending_scans", lambda s, d: everything(s, d).where("installed AND score IS NULL").select("kind", "id"), ask(["everything"], "SELECT kind, id FROM everything WHERE installed AND score IS NULL"))
OWNER = "CASE WHEN repository_url = 'local' THEN 'local' WHEN coalesce(regexp_extract(repository_url, 'github\\.com/([^/]+)', 1), '') = '' THEN 'unknown' ELSE regexp_extract(repository_url, 'github\\.com/([^/]+)', 1) END"
add("owner_counts", lambda s, d: I.owner_counts(everything(s, d)), ask(["everything"], f"SELECT {OWNER} AS owner, count(*) AS n FROM everything GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM everything"))
add("kind_tabs", lambda s, d: I.kind_counts(everything(s, d)), ask(["everything"], "SELECT kind, count(*) AS n FROM everything GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM everything"))
add("marketplace_counts", lambda s, d: I.marketplace_counts(table(s, d, "plugins")), ask(["plugins"], "SELECT marketplace, count(*) FILTER (installed) AS n_installed, count(*) AS n_total FROM plugins GROUP BY 1"))
TIER = "CASE WHEN score >= 70 THEN 'safe' WHEN score >= 30 THEN 'midhigh' ELSE 'severe' END"
add("overview", lambda s, d: I.overview(table(s, d, "stored"), table(s, d, "plugins"), latest(s, d)), ask(["everything", "latest_scans", "plugins"], f"""
SELECT * FROM (SELECT count(*) FILTER (kind = 'bundle') AS n_bundles, count(*) FILTER (kind = 'plugin') AS n_plugins, count(*) FILTER (score IS NULL) AS n_pending FROM everything WHERE installed),
 (SELECT count(*) AS n_scanned, count(*) FILTER (t = 'severe') AS n_severe, count(*) FILTER (t = 'midhigh') AS n_midhigh, count(*) FILTER (t = 'safe') AS n_safe, max(scanned_at) AS last_scan
  FROM (SELECT {TIER} AS t, scanned_at FROM (SELECT score, scanned_at FROM latest_scans UNION ALL SELECT score, NULL FROM plugins WHERE installed AND score IS NOT NULL)))"""))
add("cache_statistics", lambda s, d: I.cache_statistics(table(s, d, "repositories")), ask(["repositories"], "SELECT count(*) AS n_repositories, count(cached_bytes) AS n_cached, CAST(sum(cached_bytes) AS BIGINT) AS total_bytes FROM repositories"))
add("reports_by_score", lambda s, d: latest(s, d).orderBy("score", "group_key").select("group_key", "score", FN.level_of_score(F.col("score")).alias("level")), ask(["latest_scans"], """
SELECT group_key, score, CASE WHEN score >= 90 THEN 'Safe' WHEN score >= 70 THEN 'Low' WHEN score >= 50 THEN 'Medium' WHEN score >= 30 THEN 'High' ELSE 'Critical' END AS level FROM latest_scans ORDER BY score, group_key"""))
add("reports_by_name", lambda s, d: latest(s, d).orderBy(F.lower("group_key"), "group_key").select("group_key", "score"), ask(["latest_scans"], "SELECT group_key, score FROM latest_scans ORDER BY lower(group_key), group_key"))
add("reports_by_newest", lambda s, d: latest(s, d).orderBy(F.col("scanned_at").desc_nulls_last(), "group_key").select("group_key", "scanned_at"), ask(["latest_scans"], "SELECT group_key, scanned_at FROM latest_scans ORDER BY scanned_at DESC NULLS LAST, group_key"))

add("reports_of_level", lambda s, d: I.reports_of(latest(s, d), "Medium", "::B").select("group_key", "score", "level"), ask(["latest_scans"], """
SELECT group_key, score, 'Medium' AS level FROM latest_scans WHERE score >= 50 AND score < 70 AND contains(lower(group_key), '::b')"""))
add("open_issues", lambda s, d: I.open_issues(latest(s, d), table(s, d, "plugins")), ask(["latest_scans", "plugins"], """
SELECT b AS n_bundle_issues, p AS n_plugin_issues, b + p AS n_issues FROM (SELECT (SELECT count(*) FROM latest_scans WHERE score < 70) AS b, (SELECT count(*) FROM plugins WHERE installed AND score < 70) AS p)"""))

# --- tools
_lower = "lower(replace(detected_path, chr(92), '/'))"


def _has(*parts: str) -> str:
    return "(" + " OR ".join(f"contains({_lower}, {q(p)})" for p in parts) + ")"


_m = dict(PT.MANAGER_DIRS)
MANAGER = (
    f"CASE WHEN {_has(*_m['pnpm'])} THEN 'pnpm' WHEN {_has(*_m['npm'])} OR ({_has('/node_modules/.bin/')} AND NOT {_has('/local/')}) THEN 'npm' "
    f"WHEN {_has(*_m['brew'])} THEN 'brew' WHEN {_has(*_m['scoop'])} THEN 'scoop' WHEN {_has(*_m['choco'])} THEN 'choco' "
    f"WHEN ({_has('/scripts/')} AND {_has('python', '/py')}) OR {_has('/site-packages/')} THEN 'pip' ELSE 'unknown' END"
)


def _norm(c: str) -> str:
    return f"regexp_replace(trim({c}), '^[vV]', '')"


def _nums(c: str) -> str:
    core = f"replace(split_part(split_part({c}, '+', 1), '-', 1), '_', '.')"
    return f"CASE WHEN regexp_full_match({core}, '[0-9]+(\\.[0-9]+)*') THEN list_transform(string_split({core}, '.'), lambda x: CAST(x AS BIGINT)) END"


def _pre(c: str) -> str:
    tail = f"regexp_extract(split_part({c}, '+', 1), '^[^-]*-(.*)$', 1)"
    return (
        f"CASE WHEN contains(split_part({c}, '+', 1), '-') THEN list_transform(string_split({tail}, '.'), "
        "lambda x: {'w': NOT regexp_full_match(x, '[0-9]+'), 'n': CASE WHEN regexp_full_match(x, '[0-9]+') THEN CAST(x AS BIGINT) ELSE 0 END, "
        "'t': CASE WHEN regexp_full_match(x, '[0-9]+') THEN '' ELSE x END}) END"
    )


cte("managed_tools", ("tools",), f"""
SELECT * EXCLUDE (c, l, cn, ln, cp, lp), coalesce(c <> l AND (pc < pl OR (pc = pl AND CASE WHEN cp IS NULL THEN false WHEN lp IS NULL THEN true ELSE cp < lp END)), false) AS outdated FROM (
 SELECT *, list_resize(cn, greatest(len(cn), len(ln)), 0) AS pc, list_resize(ln, greatest(len(cn), len(ln)), 0) AS pl FROM (
  SELECT *, {_nums('c')} AS cn, {_nums('l')} AS ln, {_pre('c')} AS cp, {_pre('l')} AS lp FROM (
   SELECT *, {MANAGER} AS manager, {_norm('current_version')} AS c, {_norm('latest_version')} AS l FROM tools)))""")
add("outdated_tools", lambda s, d: I.with_manager(table(s, d, "tools")).select("detected_path", "manager", "current_version", "latest_version", "outdated"),
    ask(["managed_tools"], "SELECT detected_path, manager, current_version, latest_version, outdated FROM managed_tools"))
add("manager_counts", lambda s, d: I.manager_counts(table(s, d, "tools")), ask(["managed_tools"], """
SELECT manager, count(*) AS n, count(*) FILTER (outdated) AS n_updates FROM managed_tools GROUP BY 1 UNION ALL SELECT 'all', count(*), count(*) FILTER (outdated) FROM managed_tools"""))
add("tools_of_manager", lambda s, d: I.tools_of(table(s, d, "tools"), "npm", "TOOL1").select("detected_path", "id", "manager", "outdated"), ask(["managed_tools", "tools"], """
SELECT detected_path, id, manager, outdated FROM managed_tools WHERE manager = 'npm' AND contains(id, 'tool1')"""))
add("package_bundles", lambda s, d: I.package_bundles(table(s, d, "tools")), ask(["managed_tools"], """
SELECT manager, package_name, arg_min(id, o) AS representative, first(current_version ORDER BY o) AS current_version, count(DISTINCT id) AS n_tools FROM (
 SELECT *, (CASE WHEN id = base THEN 0 WHEN starts_with(id, base) THEN 1 ELSE 2 END, id, ord) AS o FROM (SELECT *, lower(string_split(package_name, '/')[-1]) AS base FROM managed_tools)) GROUP BY ALL"""))
add("package_siblings", lambda s, d: I.package_siblings(table(s, d, "tools")), ask(["managed_tools"], """
SELECT DISTINCT manager, package_name, representative, id FROM (SELECT *, first(id) OVER (PARTITION BY manager, package_name ORDER BY o) AS representative FROM (
 SELECT *, (CASE WHEN id = base THEN 0 WHEN starts_with(id, base) THEN 1 ELSE 2 END, id, ord) AS o FROM (SELECT *, lower(string_split(package_name, '/')[-1]) AS base FROM managed_tools))) WHERE id <> representative"""))
add("preferred_executables", lambda s, d: I.preferred_executables(table(s, d, "tools")), ask(["managed_tools"], """
SELECT key, detected_path FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, ord) AS n FROM (
 SELECT ord, detected_path, CASE WHEN launcher THEN 'pip:' || regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE id END AS key,
  CASE WHEN NOT launcher THEN 10 WHEN regexp_matches(path, '/pip(\\.exe)?$') THEN 0 WHEN ends_with(path, '/pip3') THEN 1 ELSE 2 END AS rank
 FROM (SELECT *, replace(detected_path, chr(92), '/') AS path, manager = 'pip' AND NOT regexp_matches(detected_path, 'tool[0-9]+$') AS launcher FROM managed_tools))) WHERE n = 1"""))
add("extracted_versions", lambda s, d: table(s, d, "tools").select("detected_path", VS.extract_version(F.concat_ws(" ", F.lit("tool version"), "current_version")).alias("version")),
    ask(["tools"], "SELECT detected_path, nullif(regexp_extract(concat_ws(' ', 'tool version', current_version), 'v?([0-9]+\\.[0-9]+\\.[0-9]+)', 1), '') AS version FROM tools"))
add("fresh_checks", lambda s, d: table(s, d, "tools").withColumn("fresh", I.is_fresh(F.col("checked_minute"), F.lit(90000))).select("detected_path", "fresh"),
    ask(["tools"], "SELECT detected_path, 90000 - checked_minute < 3600 AS fresh FROM tools"))


def tool_paths(s, d):
    c = table(s, d, "customer").select("c_custkey")
    k = F.col("c_custkey").cast("string")
    forms = [
        F.concat(F.lit("~/.claude/skills/"), k), F.concat(F.lit("/home/u/.agents/skills/"), k), F.concat(F.lit("C:\\Users\\a\\.codex\\skills\\"), k),
        F.concat(F.lit("\\\\?\\C:\\Users\\a\\.gemini\\antigravity\\skills\\"), k), F.concat(F.lit("/root/.config/opencode/skills"), F.lit("")),
        F.concat(F.lit("/srv/.claude/skills/"), k), F.concat(F.lit("\\\\?\\UNC\\host\\share\\"), k), F.concat(F.lit("/home/u/.claude/skillset/"), k),
    ]
    path = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        path = F.when(F.col("c_custkey") % 8 == i, form).otherwise(path)
    return c.withColumn("path", path)


add("tools_of_paths", lambda s, d: tool_paths(s, d).select("c_custkey", PT.clean_windows_path(F.col("path")).alias("clean"), PT.tool_of_path(F.col("path")).alias("tool")), """
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN '~/.claude/skills/' || c_custkey WHEN 1 THEN '/home/u/.agents/skills/' || c_custkey WHEN 2 THEN 'C:/Users/a/.codex/skills/' || c_custkey
  WHEN 3 THEN 'C:/Users/a/.gemini/antigravity/skills/' || c_custkey WHEN 4 THEN '/root/.config/opencode/skills' WHEN 5 THEN '/srv/.claude/skills/' || c_custkey
  WHEN 6 THEN '//host/share/' || c_custkey ELSE '/home/u/.claude/skillset/' || c_custkey END AS clean,
  CASE c_custkey % 8 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'agents' WHEN 2 THEN 'codex' WHEN 3 THEN 'antigravity' WHEN 4 THEN 'opencode' END AS tool FROM customer""")
add("canonical_directories", lambda s, d: I.canonical_directories(table(s, d, "stored")), ask(["stored"], """
SELECT canonical, count(DISTINCT path) AS n_paths, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, arg_min(description, ord) FILTER (description IS NOT NULL) AS description
FROM (SELECT ord, description, path, string_split(path, '/')[-1] AS canonical, CASE WHEN contains(path, '/.claude/') THEN 'claude-code' ELSE 'codex' END AS tool
  FROM (SELECT ord, description, unnest(string_split(paths, ',')) AS path FROM stored)) GROUP BY 1"""))

add("canonical_directory_paths", lambda s, d: I.canonical_directory_paths(table(s, d, "stored")), ask(["stored"], """
SELECT DISTINCT string_split(path, '/')[-1] AS canonical, path FROM (SELECT unnest(string_split(paths, ',')) AS path FROM stored)"""))

# --- search and order
add("search_items", lambda s, d: I.search(everything(s, d), " Bundle 12 ").select("kind", "id", "name", "rank"), ask(["everything"], """
SELECT kind, id, name, CASE WHEN contains(lower(name), 'bundle 12') THEN 0 ELSE 1 END AS rank FROM everything
WHERE contains(lower(name), 'bundle 12') OR contains(lower(description), 'bundle 12') OR contains(lower(marketplace), 'bundle 12') ORDER BY rank, name, id"""))
add("search_descriptions", lambda s, d: I.search(everything(s, d), "urgent").select("kind", "id", "rank"), ask(["everything"], """
SELECT kind, id, CASE WHEN contains(lower(name), 'urgent') THEN 0 ELSE 1 END AS rank FROM everything
WHERE contains(lower(name), 'urgent') OR contains(lower(description), 'urgent') OR contains(lower(marketplace), 'urgent')"""))


def updates(s, d):
    return merged(s, d).where("score IS NULL AND installed").select("id")


add("facet_filters", lambda s, d: I.facet(table(s, d, "stored"), "owner7", "codex", updates(s, d)).select("id", "name"), ask(["stored", "merged"], """
SELECT id, name FROM stored WHERE contains(repository_url, '/owner7/') AND list_contains(string_split(tools, ','), 'codex') AND id IN (SELECT id FROM merged WHERE score IS NULL AND installed)"""))
add("inventory_order", lambda s, d: I.inventory_order(table(s, d, "stored"), updates(s, d), "bundle 7").select("id", "has_update", "name_hit"), ask(["stored", "merged"], """
SELECT id, id IN (SELECT id FROM merged WHERE score IS NULL AND installed) AS has_update, contains(lower(name), 'bundle 7') AS name_hit FROM stored WHERE installed
ORDER BY has_update DESC, name_hit DESC, installed_at DESC NULLS LAST, name, id"""))
add("tool_order", lambda s, d: I.tool_order(table(s, d, "tools"), "tool9").select("detected_path", "outdated", "id_hit"), ask(["managed_tools"], """
SELECT detected_path, outdated, contains(id, 'tool9') AS id_hit FROM managed_tools ORDER BY outdated DESC, id_hit DESC, id, detected_path"""))

# --- catalogue and stored reports
_DOC = (
    "concat('{\"categories\":[{\"id\":\"', p_type, '\",\"name\":{\"en\":\"', p_brand, '\",\"zh\":\"zh-', p_brand, '\"},\"marketplaces\":[{\"name\":\"m', CAST(p_size AS STRING), "
    "'\",\"repository_url\":\"u\",\"plugins\":[{\"name\":\"', p_name, '\",\"version\":\"1.', CAST(p_size AS STRING), '\",\"description\":{\"en\":\"a\",\"zh\":\"b\"}},"
    "{\"name\":\"extra\",\"description\":{\"en\":\"c\",\"zh\":\"d\"}}]}]}]}')"
)


def catalogue_rows(s, d):
    docs = table(s, d, "part").select("p_partkey", F.from_json(F.expr(_DOC), catalogue.SCHEMA)["categories"].alias("categories"))
    return catalogue.plugin_rows(docs, "zh-CN")


add("catalogue_plugins", catalogue_rows, """
SELECT p_partkey, p_type AS category, 'zh-' || p_brand AS category_name, 'm' || p_size AS marketplace, 'u' AS repository_url, p_name AS plugin, '1.' || p_size AS version, 'b' AS description FROM part
UNION ALL SELECT p_partkey, p_type, 'zh-' || p_brand, 'm' || p_size, 'u', 'extra', NULL, 'd' FROM part""")
add("report_json", lambda s, d: stored_reports.report_json(scan.bundle_reports(derived.files(s, d))), ask(["reports"], """
SELECT bundle_id, '{"bundle_id":"' || bundle_id || '","score":' || score || ',"level":"' || level || '","blocked":' || blocked || ',"partial_scan":' || partial_scan
  || ',"n_findings":' || n_findings || ',"n_security":' || n_security || ',"n_auditability":' || n_auditability || ',"n_structure":' || n_structure || '}' AS report FROM reports"""))


def stored_parts(s, d):
    """Reports written as parts and read again from where they were written."""
    files = derived.files(s, d)
    steps = Steps(s, "reports")
    facts = steps.keep(scan.scan_facts(files), "facts")
    found = steps.keep(scan.findings_of(facts), "findings")
    scored = FN.scores(found, bundles=scan.partial_bundles(facts))
    return steps.keep(stored_reports.report_parts(scored, found, FN.recommendations(found, scored)), "parts")


add("report_round_trip", lambda s, d: stored_reports.read_parts(stored_parts(s, d)), ask(["reports", "weighted"], """
SELECT bundle_id, score, level, blocked, partial_scan, n_findings, n_security, n_auditability, n_structure, severity, category, rule_id, description,
  rel_path AS file_path, line_no AS line_number, snippet AS code_snippet, kind AS finding_kind, eff AS effective_weight
FROM reports LEFT JOIN weighted USING (bundle_id)"""))
add("report_advice", lambda s, d: stored_reports.read_advice(stored_parts(s, d)), ORACLES["recommendations"])


def stored_texts(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey") % 5
    issues = (
        F.when(k == 0, F.lit('["[a.py] Error: bad call", "Warning: odd", " ", "[b.sh] Odd: thing", "plain"]'))
        .when(k == 1, F.lit('[{"severity":"High","description":"x","file_path":"c.py","line_number":3}]'))
        .when(k == 2, F.lit("[]"))
    )
    report = F.when(k == 3, F.lit('{"bundle_id":"r","score":42,"level":"High","blocked":false,"issues":[{"severity":"Low","description":"y"}]}'))
    return o.select(
        F.col("o_orderkey").alias("id"), report.alias("report"), issues.alias("issues"),
        F.when(k != 4, (F.col("o_custkey") % 101).cast("int")).alias("score"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("Medium")).otherwise(F.lit("Odd")).alias("level"))


add("stored_reports", lambda s, d: stored_reports.read_stored(stored_texts(s, d)), """
WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, CASE o_orderkey % 5 WHEN 3 THEN 42 WHEN 4 THEN NULL ELSE CAST(o_custkey % 101 AS INT) END AS score, o_orderkey % 2 = 0 AS ev FROM orders)
SELECT id, score, CASE WHEN k = 3 THEN 'High' WHEN k = 4 THEN NULL WHEN ev THEN 'Medium' WHEN score >= 90 THEN 'Safe' WHEN score >= 70 THEN 'Low' WHEN score >= 50 THEN 'Medium' WHEN score >= 30 THEN 'High' ELSE 'Critical' END AS level,
  i.severity, i.description, i.file_path
FROM o LEFT JOIN (VALUES (0, 'High', 'bad call', 'a.py'), (0, 'Medium', 'odd', NULL), (0, 'Info', 'Odd: thing', 'b.sh'), (0, 'Info', 'plain', NULL), (1, 'High', 'x', 'c.py'), (3, 'Low', 'y', NULL)) i(k, severity, description, file_path) USING (k)""")


def reported(s, d):
    return table(s, d, "plugins").select("marketplace", F.concat(F.lit("src"), (F.col("ord") % 20).cast("string"), F.lit("-0")).alias("report_id"))


def marketplace_reports(s, d):
    return I.merge_marketplace_reports(reported(s, d), scan.bundle_reports(derived.files(s, d)))


def marketplace_advice(s, d):
    files = derived.files(s, d)
    found = scan.bundle_findings(files)
    return I.marketplace_advice(reported(s, d), FN.recommendations(found, FN.scores(found, bundles=files.select("bundle_id"))))


_reported = "(SELECT DISTINCT marketplace, 'src' || (ord % 20) || '-0' AS bundle_id FROM plugins)"
add("marketplace_issues", lambda s, d: I.marketplace_issues(reported(s, d), scan.bundle_findings(derived.files(s, d))), ask(["plugins", "findings"], f"""
SELECT DISTINCT marketplace, concat_ws('/', bundle_id, rel_path) AS path, line_no, rule_id, severity FROM findings JOIN {_reported} USING (bundle_id)"""))
add("marketplace_advice", marketplace_advice, f"SELECT DISTINCT marketplace, recommendation FROM ({ORACLES['recommendations']}) JOIN ({ask(['plugins'], f'SELECT * FROM {_reported}')}) USING (bundle_id)")


add("marketplace_reports", marketplace_reports, ask(["plugins", "reports"], """
SELECT marketplace, score, blocked, partial_scan, n_reports, n_findings, CASE WHEN score >= 90 THEN 'Safe' WHEN score >= 70 THEN 'Low' WHEN score >= 50 THEN 'Medium' WHEN score >= 30 THEN 'High' ELSE 'Critical' END AS level FROM (
 SELECT marketplace, min(r.score) AS score, bool_or(blocked) AS blocked, bool_or(partial_scan) AS partial_scan, count(*) AS n_reports, CAST(sum(n_findings) AS BIGINT) AS n_findings
 FROM plugins p JOIN reports r ON r.bundle_id = 'src' || (p.ord % 20) || '-0' GROUP BY 1)"""))
