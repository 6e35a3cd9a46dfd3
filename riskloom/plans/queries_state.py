"""Queries over kept state: stored results that are brought up to date, and inventory tables in published versions."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import inventory as I
from riskloom.packs import files as pack_files
from riskloom.packs.policy import Policy
from riskloom.plans import oracle_checks, rescan
from riskloom.plans.oracle_core import inlist, with_ctes
from riskloom.plans.queries_inventory import CANON, ask
from riskloom.plans.registry import ORACLES, add
from riskloom.session import Steps
from riskloom.sources import derived as D
from riskloom.sources import reports as stored_reports
from riskloom.sources.inventory_tables import table
from riskloom.sources.snapshots import Snapshots


def earlier(files: DataFrame) -> DataFrame:
    """The corpus as it was: some bundles not there yet, some files with another text or name, some bundles since removed."""
    group = F.floor(F.col("doc_id") / 200)
    there = files.where(group % 5 != 3)
    older = F.when(F.col("doc_id") % 331 == 5, F.concat("content", F.lit("\nsudo rm old\n"))).otherwise(F.col("content"))
    renamed = F.when(F.col("doc_id") % 331 == 17, F.concat(F.lit("scripts/"), F.col("rel_path"))).otherwise(F.col("rel_path"))
    gone = files.where("doc_id % 101 = 0").withColumn("bundle_id", F.concat(F.lit("gone-"), "bundle_id"))
    return D.in_scope(D.with_file_columns(there.withColumns({"content": older, "rel_path": renamed}).unionByName(gone).select("doc_id", "bundle_id", "rel_path", "content")))


POLICY_TEXT = json.dumps({
    "policy_name": "stricter", "policy_version": "2", "disabled_rules": ["SUDO", "CHMOD_777"], "score_kinds": ["Security"],
    "file_limits": {"max_files": 2000},
})
DISABLED = ("SUDO", "CHMOD_777")


def policy_from_file(spark: SparkSession, steps: Steps) -> Policy:
    """POLICY_TEXT by way of a file in the shared folder."""
    path = f"{steps.folder}/policy"
    spark.createDataFrame([(POLICY_TEXT,)], "value string").coalesce(1).write.text(path)
    return pack_files.read_policy(spark, path)


HEAD = ["bundle_id", "score", "level", "blocked", "partial_scan", "n_findings", "n_security", "n_auditability", "n_structure"]


def heads(parts: DataFrame) -> DataFrame:
    return parts.where("part = 'report'").select("bundle_id", F.from_json("body", stored_reports.HEAD).alias("b")).select("bundle_id", "b.*").select(*HEAD)


def after_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier corpus' results, brought up to the present one: reports as stored then, and why a bundle was scanned again."""
    files, path = D.files(spark, sf_dir), f"{Steps(spark, 'rescan-query').folder}/results"
    rescan.rescan(earlier(files), path)
    due = rescan.rescan(files, path)
    return heads(rescan.stored(spark, path)).join(due, "bundle_id", "left")


_due = """
SELECT bundle_id, CASE WHEN bool_and(is_new) THEN 'new' WHEN bool_or(is_new OR doc_id % 331 IN (5, 17)) THEN 'content' END AS reason
FROM (SELECT bundle_id, doc_id, (doc_id // 200) % 5 = 3 AS is_new FROM files) GROUP BY 1"""


def rescan_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bundle that was due, and why."""
    files = D.files(spark, sf_dir)
    return rescan.plan(rescan.scan_keys(files), rescan.scan_keys(earlier(files)))


add("rescan_plan", rescan_plan, with_ctes(("files",), f"""
SELECT bundle_id, reason FROM ({_due}) WHERE reason IS NOT NULL
UNION ALL SELECT DISTINCT 'gone-' || bundle_id, 'removed' FROM files WHERE doc_id % 101 = 0"""))
add("rescan_after_content", after_content, with_ctes(("reports", "files"), f"""
SELECT {', '.join('r.' + c for c in HEAD)}, d.reason FROM reports r JOIN ({_due}) d USING (bundle_id)"""))


def after_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored under the default policy, then brought up to a policy from a file: every bundle is due, and only once."""
    steps = Steps(spark, "policy-query")
    files, path = D.files(spark, sf_dir), f"{steps.folder}/results"
    rescan.rescan(files, path)
    policy = policy_from_file(spark, steps)
    due = rescan.rescan(files, path, policy)
    again = rescan.rescan(files, path, policy).withColumn("again", F.lit(True))
    return heads(rescan.stored(spark, path)).join(due, "bundle_id", "left").join(again.select("bundle_id", "again"), "bundle_id", "left")


_left = f"(SELECT * FROM weighted WHERE rule_id NOT IN {inlist(DISABLED)})"
add("rescan_after_policy", after_policy, with_ctes(("weighted", "files", "classed"), f"""
SELECT s.*, partial_scan, 'rules' AS reason, CAST(NULL AS BOOLEAN) AS again FROM ({oracle_checks.scores_sql(("Security",), _left)}) s
JOIN (SELECT bundle_id, bool_or(class = 'binary') AS partial_scan FROM classed GROUP BY 1) USING (bundle_id)"""))


# --- inventory tables in published versions


def snapshots(spark: SparkSession, tables: dict[str, DataFrame]) -> Snapshots:
    """Tables as a first commit in a folder of their own."""
    shots = Snapshots(spark, f"{Steps(spark, 'inventory').folder}/tables")
    shots.commit(f"load-{uuid.uuid4().hex}", lambda _: tables)
    return shots


def published_refresh(s, d):
    shots = snapshots(s, {"bundles": table(s, d, "stored"), "tools": table(s, d, "tools")})
    shots.commit("refresh", lambda t: {"bundles": I.apply_refresh(t.read("bundles"), I.merge_scanned(table(s, d, "fresh"), t.read("bundles")))})
    return shots.read("bundles")


def published_tools(s, d):
    shots = snapshots(s, {"bundles": table(s, d, "stored"), "tools": table(s, d, "tools")})
    update = lambda t: {"tools": I.upsert_tools(t.read("tools"), table(s, d, "new_tools"))}
    for _ in range(2):  # the second is the same commit again, and changes nothing
        shots.commit("tools-1", update)
    return shots.read("tools")


def published_deletion(s, d):
    shots = snapshots(s, {"bundles": table(s, d, "stored")})
    shots.commit("delete", lambda t: {"bundles": I.delete_repository(t.read("bundles"), table(s, d, "featured"))})
    return shots.read("bundles")


def canonical(s, d) -> Snapshots:
    shots = snapshots(s, {"repositories": table(s, d, "repositories"), "bundles": table(s, d, "linked_bundles"), "plugins": table(s, d, "linked_plugins")})
    shots.commit("canonical", lambda t: I.canonical_addresses(t.read("repositories"), t.read("bundles"), t.read("plugins")))
    return shots


add("published_refresh", published_refresh, ORACLES["apply_refresh"])
add("published_tools", published_tools, ORACLES["upsert_tools"])
add("published_deletion", published_deletion, ORACLES["delete_repository"])
add("canonical_repository_rows", lambda s, d: canonical(s, d).read("repositories"), ORACLES["canonical_repositories"])
_moved = f"coalesce((SELECT any_value({CANON}) FROM repositories WHERE url = t.repository_url), t.repository_url) AS repository_url"
add("canonical_bundle_addresses", lambda s, d: canonical(s, d).read("bundles"), ask(["linked_bundles", "repositories"], f"SELECT id, {_moved}, installed FROM linked_bundles t"))
add("canonical_plugin_addresses", lambda s, d: canonical(s, d).read("plugins"), ask(["linked_plugins", "repositories"], f"SELECT id, {_moved}, name FROM linked_plugins t"))
