"""Scan of files too long for a row: line rules and taint, in segments of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import findings as FN
from riskloom.operators import rule_scan, segments
from riskloom.packs.policy import DEFAULT_POLICY, Policy
from riskloom.plans import scan
from riskloom.session import Steps
from riskloom.sources import corpus, long_files


def line_findings(lines: DataFrame, steps: Steps, policy: Policy = DEFAULT_POLICY, length: int = segments.SEGMENT) -> DataFrame:
    """Graded findings of line rules, and taint flows, of files given as lines (with file_type and is_binary)."""
    hits = segments.rule_hits(lines, steps, policy, length)
    graded = FN.from_rule_hits(rule_scan.grade_hits(rule_scan.drop_suppressed_rules(hits, policy), policy).withColumn("line_no", F.col("line_no").cast("int")))
    is_script = (F.col("file_type") == "script") & ~F.col("is_binary") & ~F.col("is_doc_path")
    flows = segments.taint_hits(lines.where(F.col("is_main") | is_script), steps, policy, length).withColumn("analyzer", F.lit("taint"))
    return graded.unionByName(FN.align(flows))


def folder_findings(spark: SparkSession, root: str, policy: Policy = DEFAULT_POLICY, whole: int = corpus.WHOLE, length: int = segments.SEGMENT) -> DataFrame:
    """Findings of a folder with files of any size: short ones scanned whole, long ones by segments.

    Rules for whole texts, chains and character checks don't reach into long files; each is named by a finding that says
    so, as is each that has no lines at all. That is one finding, and no failure of the job.
    """
    steps = Steps(spark, "long-files")
    lines, unreadable = long_files.numbered_lines(spark, root, steps, policy, whole)
    lines = steps.keep(lines, "lines")
    found = line_findings(lines, steps, policy, length)

    def named(files: DataFrame, rule: str, severity: str) -> DataFrame:
        return FN.align(files.select("bundle_id", "rel_path", F.lit(rule).alias("rule_id"), F.lit("Obfuscation").alias("category"), F.lit(severity).alias("severity"),
                                     F.lit("analyzability").alias("analyzer")))

    by_line = named(lines.where("line_no = 1"), "FILE_SCANNED_BY_LINE", "Info")
    opaque = named(unreadable, "UNREADABLE_LONG_FILE", "Medium")
    long = found.unionByName(by_line).unionByName(opaque)
    long = FN.masked(FN.deduplicate(FN.with_kind(long, policy)), policy)
    return scan.bundle_findings(corpus.scan_folder(spark, root, policy, whole), policy).unionByName(long.select(*[c for c in long.columns]), allowMissingColumns=True)
