"""Structure checks over manifests and file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import paths as P
from riskloom.operators.references import references, without_partner
from riskloom.packs.policy import DEFAULT_POLICY, Policy
from riskloom.session import cut_lineage

MIN_DESCRIPTION, MAX_DESCRIPTION, MAX_COMPATIBILITY = 10, 1024, 500


def is_valid_name(name: Column) -> Column:
    """2-64 lower-case letters, digits and single inner hyphens."""
    return F.length(name).between(2, 64) & name.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$")


def _explode_rules(rows: DataFrame, keys: list, tests) -> DataFrame:
    hits = F.array(*[
        F.when(test, F.struct(F.lit(rule).alias("rule_id"), F.lit(level).alias("severity"))) for rule, level, test in tests
    ])
    return rows.select(*keys, F.explode_outer(F.filter(hits, lambda h: h.isNotNull())).alias("h")).where(
        F.col("h").isNotNull()
    ).select(*keys, "h.*")


def missing_main_file(files: DataFrame) -> DataFrame:
    has_main = files.groupBy("bundle_id").agg(F.max("is_main").alias("has_main"))
    return has_main.where(~F.col("has_main")).select(
        "bundle_id", F.lit(None).cast("string").alias("rel_path"),
        F.lit("STRUCTURE_MISSING_SKILL_MD").alias("rule_id"), F.lit("High").alias("severity"),
    )


def manifest_findings(bundles: DataFrame) -> DataFrame:
    has = F.col("has_manifest")
    named = has & (F.col("name") != "")
    size = F.octet_length("description")
    compatibility = F.aggregate(
        F.map_values("compatibility"), F.lit(0), lambda total, v: total + F.octet_length(v)
    )
    return _explode_rules(
        bundles, ["bundle_id", "rel_path"],
        (
            ("FRONTMATTER_PARSE_ERROR", "Medium", ~has),
            ("STRUCTURE_INVALID_NAME", "Medium", named & ~is_valid_name(F.col("name"))),
            ("STRUCTURE_NAME_DIR_MISMATCH", "Medium", named & (F.col("name") != F.col("bundle_id"))),
            ("STRUCTURE_INVALID_DESCRIPTION", "Medium", has & ~size.between(MIN_DESCRIPTION, MAX_DESCRIPTION)),
            ("MANIFEST_MISSING_LICENSE", "Low", has & (F.trim(F.coalesce("license", F.lit(""))) == "")),
            ("STRUCTURE_COMPATIBILITY_TOO_LONG", "Low", has & (compatibility > MAX_COMPATIBILITY)),
        ),
    )


def disallowed_segment(path: Column, policy: Policy) -> Column:
    parts = P.segments(path)
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.try_element_at(F.filter(parents, lambda s: (s != ".") & ~s.isin(*policy.allowed_subdirs)), F.lit(1))


def file_findings(files: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    ext, hidden, path = F.col("ext"), F.col("is_hidden"), F.col("rel_path")
    # Tables of texts hold valid UTF-8 only; files from storage say whether theirs is.
    no_utf8 = ~F.col("is_utf8") & ~F.col("is_binary") & (F.col("file_type") != "asset") if "is_utf8" in files.columns else F.lit(False)
    return _explode_rules(
        files, ["bundle_id", "rel_path"],
        (
            ("STRUCTURE_HIDDEN_FILE", "Medium", hidden),
            ("HIDDEN_EXECUTABLE_SCRIPT", "High", hidden & ext.isin("py", "sh", "bash", "js", "ts")),
            ("HIDDEN_DATA_FILE", "Medium", hidden & ext.isin("db", "sqlite", "sqlite3", "env", "json")),
            ("PYCACHE_FILES_DETECTED", "Low", F.contains(P.slashes(path), F.lit("__pycache__/"))),
            ("STRUCTURE_DISALLOWED_SUBDIR", "Medium", disallowed_segment(path, policy).isNotNull()),
            ("STRUCTURE_DISALLOWED_EXTENSION", "Medium",
             (ext != "") & ~F.concat(F.lit("."), ext).isin(*policy.allowed_extensions)),
            ("STRUCTURE_BINARY_CONTENT", "Low", F.col("is_binary")),
            ("STRUCTURE_NON_UTF8", "Low", no_utf8),
        ),
    )


def invalid_utf8(blobs: DataFrame) -> DataFrame:
    """Text files whose bytes are not valid UTF-8."""
    is_asset = P.file_class(F.col("ext")).isin("asset", "binary")
    return blobs.where(~is_asset & ~F.is_valid_utf8(F.col("bytes").cast("string"))).select(
        "bundle_id", "rel_path", F.lit("STRUCTURE_NON_UTF8").alias("rule_id"), F.lit("Low").alias("severity")
    )


def main_references(files: DataFrame) -> DataFrame:
    return references(files.where("is_main")).select("bundle_id", "reference")


def orphan_scripts(files: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Scripts of a bundle with a main file that the main text does not refer to."""
    scripts = files.where(F.col("file_type") == "script").select("bundle_id", "rel_path")
    scripts = scripts.join(files.where("is_main").select("bundle_id").distinct(), "bundle_id", "left_semi")
    refs = main_references(files) if refs is None else refs
    return without_partner(scripts, "rel_path", refs, "reference").select(
        "bundle_id", "rel_path", F.lit("STRUCTURE_ORPHAN_SCRIPT").alias("rule_id"), F.lit("Low").alias("severity")
    )


def missing_references(files: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """References of the main text for which the bundle has no file."""
    refs = main_references(files) if refs is None else refs
    wanted = refs.select("bundle_id", F.col("reference").alias("rel_path")).distinct()
    present = files.select("bundle_id", F.col("rel_path").alias("file"))
    return without_partner(wanted, "rel_path", present, "file").select(
        "bundle_id", "rel_path", F.lit("STRUCTURE_MISSING_REFERENCE").alias("rule_id"), F.lit("Medium").alias("severity")
    )


def structure_findings(files: DataFrame, bundles: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """All structure checks; a bundle without a main file gets that finding only.

    The file list and the main texts' references are written once: they feed six branches
    that would otherwise read the text each time.
    """
    shown = [c for c in files.columns if c in ("bundle_id", "rel_path", "ext", "file_type", "is_hidden", "is_binary", "is_main", "is_utf8")]
    listing = cut_lineage(files.select(*shown))
    refs = cut_lineage(main_references(files))
    missing = missing_main_file(listing)
    rest = (
        manifest_findings(bundles)
        .unionByName(file_findings(listing, policy))
        .unionByName(orphan_scripts(listing, refs))
        .unionByName(missing_references(listing, refs))
        .join(missing.select("bundle_id"), "bundle_id", "left_anti")
    )
    return missing.unionByName(rest).withColumn("category", F.lit("PolicyViolation"))
