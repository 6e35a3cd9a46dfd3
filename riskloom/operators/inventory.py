"""Inventory jobs: refresh, update detection, identity matching, upserts and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import paths as P
from riskloom.functions.urls import canonical_repository_url, owner_label
from riskloom.functions.versions import is_outdated, same_commit
from riskloom.operators.findings import level_of_score, tier_of_level

OFFICIAL = "claude-plugins-official"
SOURCE = ["repository_url", "file_path"]


def split_list(col: str) -> Column:
    return F.filter(F.split(col, ","), lambda s: s != "")


def best_row(df: DataFrame, keys: list[str], order: Column, largest: bool = True) -> DataFrame:
    """One row per key: an aggregate, so rows collapse before they are exchanged."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if largest else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("best"))
    return best.select(*keys, "best.*").select(*df.columns)


# --- refresh of a repository's bundle list


def stored_by_source(stored: DataFrame) -> DataFrame:
    """One stored row per source: the installed one, else the first."""
    return best_row(stored, SOURCE, F.struct(~F.col("installed"), F.col("ord")), largest=False)


def merge_scanned(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Fresh rows keep id and install state of the stored row; scores only for unchanged text."""
    old = stored_by_source(stored).select(
        *SOURCE, F.col("id").alias("old_id"), F.col("checksum").alias("old_checksum"), F.col("score").alias("old_score"),
        F.col("installed").alias("old_installed"), F.col("tools").alias("old_tools"), F.col("version").alias("old_version"),
    )
    same = F.col("checksum").eqNullSafe(F.col("old_checksum"))
    return fresh.join(old, SOURCE, "left").select(
        F.coalesce("old_id", "id").alias("id"), *SOURCE, "name", "checksum",
        F.coalesce("old_installed", F.lit(False)).alias("installed"), F.col("old_tools").alias("tools"),
        F.col("old_version").alias("version"), F.when(same, F.col("old_score")).alias("score"),
        F.col("old_id").isNull().alias("is_new"),
    )


def stale_rows(stored: DataFrame, merged: DataFrame) -> DataFrame:
    return stored.where(~F.col("installed")).join(merged.select("id"), "id", "left_anti").select("id")


def apply_refresh(stored: DataFrame, merged: DataFrame) -> DataFrame:
    """New snapshot: replaced or inserted rows, without the stale ones."""
    kept = stored.where("installed").join(merged.select("id"), "id", "left_anti")
    columns = ["id", *SOURCE, "name", "checksum", "installed", "tools", "version", "score"]
    return merged.select(*columns).unionByName(kept.select(*columns))


def bundle_checksums(files: DataFrame) -> DataFrame:
    """One checksum for each bundle over all paths and contents: changed, renamed, swapped and repeated files all count.

    Contents are the bytes as stored where the table holds them, else the text.
    """
    body = F.col("bytes") if "bytes" in files.columns else F.encode("content", "UTF-8")
    each = F.xxhash64("rel_path", F.sha2(body, 256)).cast("decimal(38,0)")
    return files.groupBy("bundle_id").agg(
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(each).cast("string")).alias("checksum")
    )


def rescan_needed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Bundles whose text is new or changed since the previous run."""
    return current.join(previous.select("bundle_id", "checksum"), ["bundle_id", "checksum"], "left_anti")


# --- update detection


def update_status(installs: DataFrame, commits: DataFrame) -> DataFrame:
    """UpToDate, UpdateAvailable or Unknown per install.

    A match with the path's latest commit is up to date. Otherwise the installed commit
    gets a second chance: it may belong to another path of the repository, and the path's
    latest commit as of it is the path's latest exactly if none came after it. That is a
    comparison of positions, so no as-of join over a path's history is needed.

    A path's commits combine before they move, and so do the positions of an install; commits move once, by their prefix,
    which is not carried along. Which side of a join moves is left to statistics.
    """
    latest = commits.groupBy("repo", "path").agg(F.max(F.struct("seq", "sha")).alias("latest"))
    # The installed commit's position: by its first seven characters, then by the whole id.
    asked = installs.where(F.length("installed_sha") >= 7).select("id", F.col("repo").alias("asked_repo"), "installed_sha")
    placed = commits.select("repo", "seq", F.col("sha").alias("commit_sha"))
    same_prefix = (F.col("asked_repo") == F.col("repo")) & (F.substring("installed_sha", 1, 7) == F.substring("commit_sha", 1, 7))
    located = (
        asked.join(placed, same_prefix).where(same_commit(F.col("installed_sha"), F.col("commit_sha")))
        .groupBy("id").agg(F.max("seq").alias("installed_seq"))
    )
    rows = installs.join(located, "id", "left").join(latest, ["repo", "path"], "left")
    latest_sha = F.col("latest.sha")
    known = (F.coalesce("installed_sha", F.lit("")) != "") & latest_sha.isNotNull()
    current = same_commit(F.col("installed_sha"), latest_sha) | F.coalesce(F.col("installed_seq") >= F.col("latest.seq"), F.lit(False))
    status = F.when(~known, "Unknown").when(current, "UpToDate").otherwise("UpdateAvailable")
    return rows.select(
        "id", "repo", "path", status.alias("status"), F.when(known, latest_sha).alias("latest_sha"))


def plugin_updates(plugins: DataFrame, available: DataFrame) -> DataFrame:
    offered = available.where(F.trim("version") != "").select(F.col("plugin_id").alias("external_id"), F.col("version").alias("latest"))
    rows = plugins.where(F.col("installed") & (F.trim("installed_version") != "")).join(offered, "external_id")
    return rows.where(F.col("latest") != F.col("installed_version")).select("id", "installed_version", "latest")


def marketplace_updates(marketplaces: DataFrame) -> DataFrame:
    return marketplaces.where((F.col("local_head") != "") & (F.col("remote_head") != F.col("local_head"))).select(
        "name", "repo", F.substring("remote_head", 1, 12).alias("remote_short"))


def best_marketplace(available: DataFrame) -> DataFrame:
    """One offer per name: the official marketplace's, else the first listed."""
    named = available.where(F.trim("name") != "").withColumn("key", F.lower("name"))
    return best_row(named, ["key"], F.struct(F.col("marketplace") != OFFICIAL, F.col("ord")), largest=False)


def upgrade_candidates(stored: DataFrame, available: DataFrame, plugins: DataFrame, marketplaces: DataFrame) -> DataFrame:
    """Installed bundles for which a plugin of the same name is offered and not yet installed."""
    owned = plugins.where("installed").select(F.col("external_id").alias("plugin_id"))
    offers = best_marketplace(available).join(owned, "plugin_id", "left_anti").select(
        "key", "plugin_id", F.col("marketplace").alias("marketplace_name"), F.col("version").alias("latest_version"))
    repos = marketplaces.groupBy(F.col("name").alias("marketplace_name")).agg(F.min("repo").alias("marketplace_repo"))
    rows = stored.where(F.col("installed") & (F.trim("name") != "")).withColumn("key", F.lower(F.trim("name")))
    return rows.join(offers, "key").join(repos, "marketplace_name", "left").select(
        F.col("id").alias("bundle_id"), "name", "plugin_id", "marketplace_name", "marketplace_repo", "latest_version")


def add_commands(plugins: DataFrame) -> DataFrame:
    """The command that adds a marketplace: the first that one of its plugins' records knows."""
    known = plugins.where(F.col("marketplace_add_command").isNotNull())
    return known.groupBy(F.col("marketplace").alias("marketplace_name")).agg(F.min_by("marketplace_add_command", "ord").alias("marketplace_add_command"))


def upgrade_commands(candidates: DataFrame, plugins: DataFrame) -> DataFrame:
    """Upgrade candidates with the command that adds their marketplace, where one is known."""
    return candidates.join(add_commands(plugins), "marketplace_name", "left")


def match_plugins(scanned: DataFrame, existing: DataFrame) -> DataFrame:
    """Stored record of a scanned plugin: by id or by source; installed first, then same id.

    The OR condition is two equi-joins. Each source offers its one best record, so
    plugins that share a source do not meet all its records; a same-id record of that
    source still comes in through the id.
    """
    source = ["repository_url", "marketplace", "name"]
    e = existing.select(F.col("id").alias("existing_id"), F.col("installed").alias("was_installed"), *source)
    by_id = scanned.select("id").join(
        e.select("existing_id", "was_installed"), F.col("id") == F.col("existing_id")).withColumn("same_id", F.lit(True))
    best = e.groupBy(*source).agg(F.max(F.struct("was_installed", "existing_id")).alias("b"))
    l, r = scanned.alias("l"), best.alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in source]
    by_source = l.join(r, on).select("l.id", "r.b.existing_id", "r.b.was_installed").withColumn(
        "same_id", F.col("id") == F.col("existing_id"))
    both = by_id.select("id", "existing_id", "was_installed", "same_id").unionByName(by_source)
    order = F.struct("was_installed", "same_id", "existing_id")
    return both.groupBy("id").agg(F.max_by(F.struct("existing_id", "was_installed", "same_id"), order).alias("m")).select("id", "m.*")


def sync_installed(plugins: DataFrame, listed: DataFrame) -> DataFrame:
    """Set install state from a list of installed ids; rows not on the list are cleared."""
    known = plugins.where(F.col("external_id").isNotNull())
    rows = known.select("external_id", "id", "name", "installed", "installed_version").join(
        listed.select("external_id", "version", "enabled", F.lit(True).alias("on_list")), "external_id", "full_outer")
    on_list = F.coalesce("on_list", F.lit(False))
    return rows.select(
        "external_id", F.coalesce("id", F.concat(F.lit("external::"), "external_id")).alias("id"),
        on_list.alias("installed"), F.col("version").alias("installed_version"), "enabled",
        (F.coalesce("installed", F.lit(False)) & ~on_list).alias("was_cleared"), F.col("id").isNull().alias("is_new"),
    )


# --- local state


def local_modifications(installed: DataFrame, base: DataFrame) -> DataFrame:
    """Files that are new or differ from the base copy; deletions are not reported."""
    rows = installed.join(base.select("bundle_id", "rel_path", F.col("checksum").alias("base")), ["bundle_id", "rel_path"], "left")
    change = F.when(F.col("base").isNull(), "New").when(F.col("base") != F.col("checksum"), "Modified")
    return rows.select("bundle_id", "rel_path", change.alias("change")).where("change IS NOT NULL")


def match_directories(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Record of a directory on disk: by path, else by directory name, else by checksum.

    The two weaker ways only reach uninstalled local records. For them one record per
    name or checksum is chosen before the join, so equal checksums do not multiply.
    """
    path_owner = stored.select(F.explode(split_list("paths")).alias("path"), F.col("id").alias("record"), "ord")
    by_path = best_row(path_owner, ["path"], F.col("ord"), largest=False).select("path", F.col("record").alias("by_path"))
    free = stored.where(~F.col("installed") & F.col("local_only"))
    names = free.select(F.explode(split_list("paths")).alias("p"), F.col("id").alias("by_name"), "ord").select(
        F.element_at(F.split("p", "/"), -1).alias("dir_name"), "by_name", "ord")
    by_name = best_row(names, ["dir_name"], F.struct("ord", "by_name"), largest=False).drop("ord")
    by_sum = best_row(free.select("checksum", F.col("id").alias("by_checksum"), "ord"), ["checksum"], F.col("ord"), largest=False).drop("ord")
    rows = (
        found.withColumn("dir_name", F.element_at(F.split("path", "/"), -1))
        .join(by_path, "path", "left").join(by_name, "dir_name", "left").join(by_sum, "checksum", "left")
    )
    how = F.when(F.col("by_path").isNotNull(), "path").when(F.col("by_name").isNotNull(), "name").when(F.col("by_checksum").isNotNull(), "checksum").otherwise("new")
    return rows.select("path", F.coalesce("by_path", "by_name", "by_checksum").alias("record"), how.alias("matched_by"))


def linked_tools(stored: DataFrame, tool_entries: DataFrame) -> DataFrame:
    """Tools that hold a copy of an installed bundle: same directory name and checksum."""
    source = F.element_at(F.split(F.get(split_list("paths"), F.lit(0)), "/"), -1)
    rows = stored.where("installed").select("id", source.alias("dir_name"), "checksum")
    matched = rows.join(tool_entries, ["dir_name", "checksum"])
    return matched.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("tool_id")), ",").alias("tools"))


def reconcile_paths(stored: DataFrame, alive: DataFrame) -> DataFrame:
    """What becomes of installed rows some of whose paths are gone."""
    rows = stored.where("installed").select("id", "local_only", F.explode(split_list("paths")).alias("path"))
    marked = rows.join(alive.select("path").distinct().withColumn("alive", F.lit(True)), "path", "left")
    counts = marked.groupBy("id", "local_only").agg(
        F.count(F.lit(1)).alias("n_paths"), F.count("alive").alias("n_alive"), F.min(F.when(F.col("alive"), F.col("path"))).alias("first_alive"))
    action = F.when(F.col("n_alive") > 0, "prune").when(F.col("local_only"), "delete").otherwise("mark_uninstalled")
    return counts.where(F.col("n_alive") < F.col("n_paths")).select("id", "n_paths", "n_alive", "first_alive", action.alias("action"))


def living_paths(stored: DataFrame, alive: DataFrame) -> DataFrame:
    """The paths left to installed rows that keep some of theirs, a row each."""
    rows = stored.where("installed").select("id", F.explode(split_list("paths")).alias("path"))
    return rows.join(alive.select("path").distinct(), "path", "left_semi").select("id", "path")


def import_featured(featured: DataFrame, repositories: DataFrame) -> DataFrame:
    """Per featured repository: added, renamed or skipped."""
    existing = repositories.groupBy("url").agg(F.min_by("name", "ord").alias("old_name"))
    rows = featured.join(existing, "url", "left")
    status = F.when(F.col("old_name").isNull(), "added").when(F.col("old_name") != F.col("name"), "renamed").otherwise("skipped")
    return rows.select("url", "name", status.alias("status"))


def merge_catalogue(manifest_plugins: DataFrame, curated: DataFrame) -> DataFrame:
    """Curated values fill what the manifest leaves open."""
    extra = curated.groupBy(F.lower("name").alias("key")).agg(
        F.max_by("version", "ord").alias("c_version"), F.max_by("marketplace", "ord").alias("c_marketplace"))
    rows = manifest_plugins.withColumn("key", F.lower("name")).join(extra, "key", "left")
    return rows.select("id", "name", F.coalesce("installed_version", "c_version").alias("version"), F.coalesce("repository_url", "c_marketplace").alias("origin"))


# --- upserts and table care


def upsert_tools(old: DataFrame, new: DataFrame) -> DataFrame:
    """New values win; status is cleared by an update, a description survives a null."""
    n = new.select("detected_path", *[F.col(c).alias(f"n_{c}") for c in ("id", "package_name", "current_version", "latest_version", "update_available", "description")])
    rows = old.select("detected_path", "id", "package_name", "current_version", "latest_version", "update_status", "description").join(n, "detected_path", "full_outer")
    fresh = F.col("n_id").isNotNull()

    def newer(c: str) -> Column:
        return F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)

    return rows.select(
        "detected_path", newer("id"), newer("package_name"), newer("current_version"), newer("latest_version"),
        F.when(~F.coalesce("n_update_available", F.lit(False)), F.col("update_status")).alias("update_status"),
        F.coalesce("n_description", "description").alias("description"),
    )


def stale_tools(old: DataFrame, reported: DataFrame, on_disk: DataFrame) -> DataFrame:
    return (
        old.select("detected_path").join(reported.select("detected_path"), "detected_path", "left_anti")
        .join(on_disk.select("detected_path"), "detected_path", "left_anti")
    )


def canonical_repositories(repositories: DataFrame) -> DataFrame:
    """One row per canonical address: the record already stored under it, else the first; nulls filled from the rest."""
    rows = repositories.withColumn("canonical", F.coalesce(canonical_repository_url(F.col("url")), F.col("url")))
    order = F.struct(F.col("url") != F.col("canonical"), F.col("ord"))

    def first_known(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)

    return rows.groupBy(F.col("canonical").alias("url")).agg(
        F.min_by("id", order).alias("id"), first_known("description"), first_known("cached_bytes"), F.count(F.lit(1)).alias("n_merged"))


def address_map(repositories: DataFrame) -> DataFrame:
    """old and new: stored addresses that are not canonical, and what they become; others, and those of no known host, stay."""
    new = canonical_repository_url(F.col("url"))
    return repositories.select(F.col("url").alias("old"), new.alias("new")).where("new is not null and new <> old").distinct()


def with_new_addresses(rows: DataFrame, addresses: DataFrame, url: str = "repository_url") -> DataFrame:
    """Rows whose address is mapped get the new one. Addresses are distinct, so a popular repository's rows may be split over tasks."""
    moved = rows.join(addresses.select(F.col("old").alias(url), "new"), url, "left")
    return moved.withColumn(url, F.coalesce("new", url)).select(*rows.columns)


def canonical_addresses(repositories: DataFrame, bundles: DataFrame, plugins: DataFrame) -> dict[str, DataFrame]:
    """The three tables that hold addresses, under canonical ones; repositories that become equal are one row."""
    addresses = address_map(repositories)
    return {
        "repositories": canonical_repositories(repositories),
        "bundles": with_new_addresses(bundles, addresses), "plugins": with_new_addresses(plugins, addresses),
    }


def delete_repository(stored: DataFrame, removed: DataFrame) -> DataFrame:
    """Drop uninstalled rows of removed repositories, detach installed ones."""
    rows = stored.join(removed.select(F.col("url").alias("repository_url")).distinct().withColumn("gone", F.lit(True)), "repository_url", "left")
    gone = F.coalesce("gone", F.lit(False))
    return rows.where(~gone | F.col("installed")).select(
        "id", F.when(gone, "local").otherwise(F.col("repository_url")).alias("repository_url"), "installed")


# --- views over the inventory


def group_key(checksum="checksum", name="name", url="repository_url", id_="id") -> Column:
    local = (F.col(url) == "local") & F.col(checksum).isNotNull()
    return F.when(local, F.concat_ws("::", F.lit("local"), F.lower(F.trim(name)), checksum)).otherwise(F.concat(F.lit("id::"), id_))


def merged_groups(stored: DataFrame) -> DataFrame:
    """Records of one group as one row: first known scalars, number of members, distinct tools."""
    rows = stored.withColumn("group_key", group_key())
    first = F.col("ord")

    def first_known(c: str, usable: Column) -> Column:
        return F.min_by(c, F.when(usable, first)).alias(c)

    scalars = rows.groupBy("group_key").agg(
        F.min_by("id", first).alias("id"), first_known("description", F.col("description").isNotNull()),
        first_known("version", F.col("version").isNotNull()), F.min("local_only").alias("local_only"),
        F.countDistinct("id").alias("n_members"))
    tools = rows.select("group_key", F.explode(split_list("tools")).alias("tool")).distinct().groupBy("group_key").agg(
        F.array_join(F.array_sort(F.collect_list("tool")), ",").alias("tools"))
    return scalars.join(tools, "group_key", "left").withColumn("tools", F.coalesce("tools", F.lit("")))


def group_paths(stored: DataFrame) -> DataFrame:
    """All paths of a group's records, each once."""
    return stored.select(group_key().alias("group_key"), F.explode(split_list("paths")).alias("path")).distinct()


def latest_scans(results: DataFrame, stored: DataFrame) -> DataFrame:
    """Newest result per group, with the inventory's first path."""
    keys = stored.select(F.col("id").alias("bundle_id"), group_key().alias("group_key"), F.get(split_list("paths"), F.lit(0)).alias("local_path"))
    rows = results.join(keys, "bundle_id", "left").withColumn("group_key", F.coalesce("group_key", F.concat(F.lit("id::"), "bundle_id")))
    return best_row(rows, ["group_key"], F.struct("scanned_at", "score", "bundle_id", "note"))


def everything(stored: DataFrame, plugins: DataFrame) -> DataFrame:
    """Bundles and plugins in one table, tagged by kind."""
    b = stored.select(F.lit("bundle").alias("kind"), "id", "name", "repository_url", "installed", "score", "description")
    p = plugins.select(F.lit("plugin").alias("kind"), "id", "name", "repository_url", "installed", "score", "marketplace", "description")
    return b.unionByName(p, allowMissingColumns=True)


def owner_counts(items: DataFrame) -> DataFrame:
    """Items per owner, and the grand total as owner 'all'."""
    rows = items.withColumn("owner", owner_label(F.coalesce("repository_url", F.lit(""))))
    return rows.rollup("owner").agg(F.count(F.lit(1)).alias("n")).withColumn("owner", F.coalesce("owner", F.lit("all")))


def kind_counts(items: DataFrame) -> DataFrame:
    return items.rollup("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.coalesce("kind", F.lit("all")))


def with_manager(tools: DataFrame) -> DataFrame:
    return tools.withColumns({
        "manager": P.manager_of_path(F.col("detected_path")), "outdated": is_outdated(F.col("current_version"), F.col("latest_version"))})


def manager_counts(tools: DataFrame) -> DataFrame:
    return with_manager(tools).rollup("manager").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("outdated"), 1)).alias("n_updates")).withColumn(
        "manager", F.coalesce("manager", F.lit("all")))


def marketplace_counts(plugins: DataFrame) -> DataFrame:
    return plugins.groupBy("marketplace").agg(F.count(F.when(F.col("installed"), 1)).alias("n_installed"), F.count(F.lit(1)).alias("n_total"))


def overview(stored: DataFrame, plugins: DataFrame, latest: DataFrame) -> DataFrame:
    """Headline figures in one row."""
    items = everything(stored, plugins)
    state = items.where("installed").agg(
        F.count(F.when(F.col("kind") == "bundle", 1)).alias("n_bundles"), F.count(F.when(F.col("kind") == "plugin", 1)).alias("n_plugins"),
        F.count(F.when(F.col("score").isNull(), 1)).alias("n_pending"))
    scored = latest.select("score", "scanned_at").unionByName(
        plugins.where(F.col("installed") & F.col("score").isNotNull()).select("score", F.lit(None).cast("timestamp").alias("scanned_at")))
    tier = tier_of_level(level_of_score(F.col("score")))
    figures = scored.agg(
        F.count(F.lit(1)).alias("n_scanned"), *[F.count(F.when(tier == t, 1)).alias(f"n_{t.lower()}") for t in ("Severe", "MidHigh", "Safe")],
        F.max("scanned_at").alias("last_scan"))
    return state.withColumn("one", F.lit(1)).join(figures.withColumn("one", F.lit(1)), "one").drop("one")


def open_issues(latest: DataFrame, plugins: DataFrame) -> DataFrame:
    """How many scanned bundles and installed plugins are at a level above Low, in one row."""
    level = level_of_score(F.col("score"))
    risky = ~level.isin("Safe", "Low")
    counted = latest.select("score", F.lit("bundle").alias("kind")).unionByName(plugins.where("installed").select("score", F.lit("plugin").alias("kind")))
    issues = counted.where(F.col("score").isNotNull() & risky).agg(
        F.count(F.when(F.col("kind") == "bundle", 1)).alias("n_bundle_issues"), F.count(F.when(F.col("kind") == "plugin", 1)).alias("n_plugin_issues"))
    return issues.withColumn("n_issues", F.col("n_bundle_issues") + F.col("n_plugin_issues"))


def cache_statistics(repositories: DataFrame) -> DataFrame:
    return repositories.agg(
        F.count(F.lit(1)).alias("n_repositories"), F.count("cached_bytes").alias("n_cached"), F.sum("cached_bytes").alias("total_bytes"))


def package_bundles(tools: DataFrame) -> DataFrame:
    """Several tools of one package as one row: the one named like the package stands for it."""
    rows = with_manager(tools).withColumn("base", F.lower(F.element_at(F.split("package_name", "/"), -1)))
    rank = F.when(F.col("id") == F.col("base"), 0).when(F.startswith("id", F.col("base")), 1).otherwise(2)
    order = F.struct(rank, F.col("id"), F.col("ord"))
    return rows.groupBy("manager", "package_name").agg(
        F.min_by("id", order).alias("representative"), F.min_by("current_version", order).alias("current_version"), F.countDistinct("id").alias("n_tools"))


def package_siblings(tools: DataFrame) -> DataFrame:
    """The other tools of a package, a row each, beside the one that stands for it."""
    rows = with_manager(tools).select("manager", "package_name", "id").distinct()
    heads = package_bundles(tools).select("manager", "package_name", "representative")
    return rows.join(heads, ["manager", "package_name"]).where("id <> representative").select("manager", "package_name", "representative", "id")


def preferred_executables(tools: DataFrame) -> DataFrame:
    """One executable per tool id; launchers of one pip directory count as one, 'pip' before 'pip3' before the rest."""
    name = F.regexp_replace(F.element_at(F.split(P.slashes(F.col("detected_path")), "/"), -1), r"(?i)\.exe$", "")
    rows = with_manager(tools).withColumn("launcher", F.when((F.col("manager") == "pip") & name.rlike(r"^pip(?:3(?:\.[0-9]+)?)?$"), name))
    directory = P.parent_path(F.col("detected_path"))
    key = F.when(F.col("launcher").isNotNull(), F.concat(F.lit("pip:"), directory)).otherwise(F.col("id"))
    rank = F.when(F.col("launcher").isNull(), 10).when(F.col("launcher") == "pip", 0).when(F.col("launcher") == "pip3", 1).otherwise(2)
    return best_row(rows.select(key.alias("key"), rank.alias("rank"), "ord", "detected_path"), ["key"], F.struct("rank", "ord"), largest=False).select("key", "detected_path")


def merge_marketplace_reports(plugins: DataFrame, reports: DataFrame) -> DataFrame:
    """One report per marketplace: lowest score, any block, number of reports."""
    rows = plugins.select("marketplace", F.col("report_id").alias("bundle_id")).join(reports, "bundle_id")
    merged = rows.groupBy("marketplace").agg(
        F.least(F.min("score"), F.lit(100)).alias("score"), F.max("blocked").alias("blocked"), F.max("partial_scan").alias("partial_scan"),
        F.count(F.lit(1)).alias("n_reports"), F.sum("n_findings").alias("n_findings"))
    return merged.withColumn("level", level_of_score(F.col("score")))


def marketplace_issues(plugins: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of a marketplace's reports, their paths under the bundle's name; equal ones once."""
    members = plugins.select("marketplace", F.col("report_id").alias("bundle_id")).distinct()
    rows = members.join(findings, "bundle_id")
    return rows.select(
        "marketplace", F.concat_ws("/", "bundle_id", "rel_path").alias("path"), "line_no", "rule_id", "severity"
    ).distinct()


def marketplace_advice(plugins: DataFrame, advice: DataFrame) -> DataFrame:
    """Distinct advice of a marketplace's reports."""
    members = plugins.select("marketplace", F.col("report_id").alias("bundle_id")).distinct()
    return members.join(advice, "bundle_id").select("marketplace", "recommendation").distinct()


def canonical_directories(stored: DataFrame) -> DataFrame:
    """Directories by their last segment: number of distinct paths, tools, first description."""
    rows = stored.select("ord", "description", F.explode(split_list("paths")).alias("path"))
    rows = rows.withColumns({"canonical": F.element_at(F.split("path", "/"), -1), "tool": P.tool_of_path(F.col("path"))})
    return rows.groupBy("canonical").agg(
        F.countDistinct("path").alias("n_paths"), F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"),
        F.min_by("description", F.when(F.col("description").isNotNull(), F.col("ord"))).alias("description"))


def canonical_directory_paths(stored: DataFrame) -> DataFrame:
    """The paths behind each row of canonical_directories."""
    rows = stored.select(F.explode(split_list("paths")).alias("path")).distinct()
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("canonical"), "path")


# --- search and order


def search(items: DataFrame, query: str) -> DataFrame:
    """Rows whose name, description or source contains the text; name hits rank before the rest."""
    q = F.lit(query.strip().lower())

    def has(c: str) -> Column:
        return F.coalesce(F.contains(F.lower(c), q), F.lit(False))

    hit = items.where(has("name") | has("description") | has("marketplace"))
    return hit.withColumn("rank", F.when(has("name"), 0).otherwise(1)).orderBy("rank", "name", "id")


def facet(items: DataFrame, owner: str | None = None, tool: str | None = None, updates: DataFrame | None = None) -> DataFrame:
    rows = items
    if owner:
        rows = rows.where(owner_label(F.coalesce("repository_url", F.lit(""))) == owner)
    if tool:
        rows = rows.where(F.array_contains(split_list("tools"), tool))
    if updates is not None:
        rows = rows.join(updates, "id", "left_semi")
    return rows


def reports_of(latest: DataFrame, level: str | None = None, text: str | None = None, name: str = "group_key") -> DataFrame:
    """Latest results at a level, whose name holds the text in whatever case."""
    rows = latest.withColumn("level", level_of_score(F.col("score")))
    if level:
        rows = rows.where(F.col("level") == level)
    if text:
        rows = rows.where(F.contains(F.lower(name), F.lit(text.lower())))
    return rows


def tools_of(tools: DataFrame, manager: str | None = None, text: str | None = None) -> DataFrame:
    """Tools of one package manager, whose id holds the text in whatever case."""
    rows = with_manager(tools)
    if manager:
        rows = rows.where(F.col("manager") == manager)
    if text:
        rows = rows.where(F.contains(F.lower("id"), F.lit(text.lower())))
    return rows


def is_fresh(checked: Column, now: Column, ttl_seconds: int = 3600) -> Column:
    return F.coalesce(now - checked < ttl_seconds, F.lit(False))


def inventory_order(stored: DataFrame, updates: DataFrame, query: str) -> DataFrame:
    """Updates first, then name hits, newest install, name."""
    rows = stored.where("installed").join(updates.select("id").distinct().withColumn("has_update", F.lit(True)), "id", "left")
    return rows.withColumns({
        "has_update": F.coalesce("has_update", F.lit(False)), "name_hit": F.contains(F.lower("name"), F.lit(query.lower()))}).orderBy(
        F.col("has_update").desc(), F.col("name_hit").desc(), F.col("installed_at").desc_nulls_last(), "name", "id")


def tool_order(tools: DataFrame, query: str) -> DataFrame:
    return with_manager(tools).withColumn("id_hit", F.contains("id", F.lit(query))).orderBy(F.col("outdated").desc(), F.col("id_hit").desc(), "id", "detected_path")
