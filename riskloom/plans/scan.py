"""The whole scan: one pass over the text, everything after it on findings only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as T
from riskloom.operators import chains, consistency, content_checks, coverage, findings, manifest, rule_scan, structure, taint
from riskloom.packs.policy import DEFAULT_POLICY, Policy
from riskloom.session import cut_lineage

KEYS = ["bundle_id", "rel_path", "ext", "is_main", "is_doc_path"]


def _shaped(hits: Column, analyzer: str | None, has_grade: bool = True) -> Column:
    def one(h: Column) -> Column:
        def text(name: str) -> Column:
            return (h[name] if has_grade else F.lit(None).cast("string")).alias(name)

        return F.struct(
            h["rule_id"].alias("rule_id"), text("category"), text("severity"),
            h["line_no"].cast("int").alias("line_no"), h["snippet"].alias("snippet"),
            F.lit(analyzer).cast("string").alias("analyzer"),
        )

    return F.coalesce(F.transform(hits, one), F.array())


def capability_hits() -> Column:
    """Capabilities of a script, carried along as marker rows."""
    names = consistency.capability_names()
    none = F.lit(None)
    is_script = (F.col("file_type") == "script") & ~F.col("is_binary")
    return F.when(
        is_script,
        F.transform(names, lambda n: F.struct(n.alias("rule_id"), none.cast("int").alias("line_no"), none.cast("string").alias("snippet"))),
    )


FACTS = [*KEYS, "file_type", "is_binary", "is_symlink", "size_bytes", "has_manifest", "block"]


def _with_bytes(files: DataFrame) -> DataFrame:
    """Files as stored: their bytes (of the text, where a table holds no other) and whether they are links."""
    have = set(files.columns)
    return files.withColumns({
        "bytes": F.col("bytes") if "bytes" in have else F.encode("content", "UTF-8"),
        "is_symlink": F.coalesce("is_symlink", F.lit(False)) if "is_symlink" in have else F.lit(False),
    })


def file_hits() -> Column:
    """Content that is of another type than the extension says, and links, which are not followed."""
    none = F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("int").alias("line_no")
    severity = content_checks.mismatch_severity(F.col("ext"), F.col("detected"))
    found = F.array(
        F.when(F.col("is_symlink"), F.struct(F.lit("SYMLINK").alias("rule_id"), F.lit("SensitiveFileAccess").alias("category"), F.lit("Critical").alias("severity"), *none)),
        F.when((F.col("ext") != "") & severity.isNotNull(), F.struct(F.lit("FILE_MAGIC_MISMATCH").alias("rule_id"), F.lit("Obfuscation").alias("category"), severity.alias("severity"), *none)),
    )
    return F.filter(found, lambda h: h.isNotNull())


def scan_facts(files: DataFrame, policy: Policy = DEFAULT_POLICY, passed: tuple[str, ...] = ()) -> DataFrame:
    """One row per file with everything later steps need, and no text; `passed` columns come along.

    All row-wise detectors run in consecutive projections over one read of the files.
    """
    main = F.col("is_main")
    whole = content_checks.with_content_type(rule_scan.prepare(_with_bytes(files))).select(
        *KEYS, *passed, "file_type", "is_binary", "is_symlink", "size_bytes", "content", "lines", "folded",
        F.when(main, manifest.has_block(F.col("content"))).alias("has_manifest"),
        F.when(main, manifest.block_of(F.col("content"))).alias("block"),
        F.concat(
            _shaped(rule_scan.line_rule_hits(policy), None, has_grade=False),
            _shaped(rule_scan.content_rule_hits(policy), None, has_grade=False),
            _shaped(content_checks.unicode_hits(), "unicode"),
            _shaped(content_checks.asset_hits(), "assets"),
            _shaped(file_hits(), "files"),
            _shaped(capability_hits(), "capability", has_grade=False),
        ).alias("text_hits"),
    )
    is_target = main | ((F.col("file_type") == "script") & ~F.col("is_binary") & ~F.col("is_doc_path"))
    bodies = whole.withColumn("content", F.when(is_target, chains.instruction_text()).otherwise(F.lit("")))
    # A script's lines and folded text are those of the file, if it has no other breaks.
    same = is_target & ~main & ~F.contains("content", F.lit("\r"))
    bodies = bodies.withColumns({
        "lines": F.when(same, F.col("lines")).otherwise(T.physical_lines(F.col("content"))),
        "folded": F.when(same, T.unix_breaks(F.col("folded"))).otherwise(T.folded(F.col("content"))),
    })
    return chains.with_positions(bodies, tuple(chains.RULES)).select(
        *FACTS, *passed,
        F.concat(
            F.col("text_hits"),
            _shaped(F.concat(*[chains.chain_hit(r, policy) for r in chains.RULES]), "chains"),
            _shaped(taint.taint_hits(policy), "taint"),
        ).alias("hits"),
    )


def scan_hits(files: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return rule_scan.explode_hits(scan_facts(files, policy), KEYS, "hits")


def findings_of(facts: DataFrame, policy: Policy = DEFAULT_POLICY, strict: DataFrame | None = None) -> DataFrame:
    """Findings of every bundle, graded, kept by kind and deduplicated."""
    hits = rule_scan.explode_hits(facts, KEYS, "hits")
    pack = hits.where(F.col("analyzer").isNull()).drop("category", "severity", "analyzer")
    graded = rule_scan.grade_hits(rule_scan.drop_suppressed_rules(pack, policy), policy)
    flows = taint.first_per_bundle(hits.where(F.col("analyzer") == "taint"))
    others = hits.where(F.col("analyzer").isin("unicode", "assets", "files", "chains"))
    capabilities = hits.where(F.col("analyzer") == "capability").select(
        "bundle_id", "rel_path", F.col("rule_id").alias("capability")
    )
    manifests = manifest.parse_blocks(facts.where("is_main"))
    declared = (
        consistency.undeclared_capabilities(capabilities, manifests)
        .unionByName(consistency.manifest_contradictions(capabilities, manifests), allowMissingColumns=True)
        .unionByName(consistency.description_findings(manifests), allowMissingColumns=True)
        .withColumn("analyzer", F.lit("consistency"))
    )
    read = coverage.coverage_findings(facts, policy).withColumn("analyzer", F.lit("analyzability"))
    union = findings.from_rule_hits(graded)
    for part in (others, flows, declared, read):
        union = union.unionByName(findings.align(part))
    if strict is not None:
        union = union.unionByName(findings.align(strict.withColumn("analyzer", F.lit("strict_structure"))))
    # Masked at the end: what is hidden still tells findings apart.
    return findings.masked(findings.deduplicate(findings.with_kind(union, policy)), policy)


def partial_bundles(facts: DataFrame) -> DataFrame:
    """Every bundle, and whether the scan could not look into all of its files: opaque binaries and links."""
    opaque = (F.col("is_binary") & (coverage.readable_class() != "ignored")) | F.col("is_symlink")
    return facts.groupBy("bundle_id").agg(F.max(opaque).alias("partial_scan"))


def bundle_findings(files: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Findings of every bundle.

    The facts are kept as a table: they are small next to the text, and the branches of
    findings_of would otherwise each read the text again.
    """
    facts = cut_lineage(scan_facts(files, policy), "facts")
    strict = structure.structure_findings(files, manifest.bundles(files), policy) if policy.strict_structure else None
    return findings_of(facts, policy, strict)


def bundle_reports(files: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Score, level, block state and counts of every bundle, also of those without findings."""
    facts = cut_lineage(scan_facts(files, policy))
    strict = structure.structure_findings(files, manifest.bundles(files), policy) if policy.strict_structure else None
    found = cut_lineage(findings_of(facts, policy, strict))
    return findings.scores(found, policy.score_kinds, partial_bundles(facts))
