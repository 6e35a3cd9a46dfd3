"""Stored reports: JSON text out, and back in with the fallbacks older rows need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.findings import effective_weight, level_of_score

ISSUE = "struct<severity:string, description:string, file_path:string, line_number:int>"
REPORT = f"struct<bundle_id:string, score:int, level:string, blocked:boolean, issues:array<{ISSUE}>>"
LEGACY_SEVERITY = {"Critical": "Critical", "High": "High", "Error": "High", "Medium": "Medium", "Warning": "Medium", "Low": "Low", "Info": "Info"}


REPORT_FIELDS = ("bundle_id", "score", "level", "blocked", "partial_scan", "n_findings", "n_security", "n_auditability", "n_structure")
HEAD = "score int, level string, blocked boolean, partial_scan boolean, n_findings bigint, n_security bigint, n_auditability bigint, n_structure bigint"
STORED_ISSUE = "severity string, category string, rule_id string, description string, file_path string, line_number int, code_snippet string, finding_kind string, effective_weight int"


def report_json(reports: DataFrame) -> DataFrame:
    """One JSON text per bundle: score, level, block and partial state, counts by kind. Issues are rows of their own."""
    return reports.select("bundle_id", F.to_json(F.struct(*REPORT_FIELDS)).alias("report"))


def report_parts(reports: DataFrame, findings: DataFrame, advice: DataFrame) -> DataFrame:
    """A whole report as rows (bundle_id, part, body): its head, each issue and each line of advice as JSON.

    A bundle may have any number of issues, so they are not gathered into one text.
    """
    issue = F.struct(
        "severity", "category", "rule_id", "description", F.col("rel_path").alias("file_path"), F.col("line_no").alias("line_number"),
        F.col("snippet").alias("code_snippet"), F.col("kind").alias("finding_kind"), effective_weight().alias("effective_weight"),
    )
    return (
        report_json(reports).select("bundle_id", F.lit("report").alias("part"), F.col("report").alias("body"))
        .unionByName(findings.select("bundle_id", F.lit("issue").alias("part"), F.to_json(issue).alias("body")))
        .unionByName(advice.select("bundle_id", F.lit("advice").alias("part"), F.to_json(F.struct(F.col("recommendation").alias("text"))).alias("body")))
    )


def read_parts(parts: DataFrame) -> DataFrame:
    """Parts back to one row per issue under its report's head; reports without issues keep one row."""
    def of(part: str, schema: str) -> DataFrame:
        return parts.where(F.col("part") == part).select("bundle_id", F.from_json("body", schema).alias("b")).select("bundle_id", "b.*")

    return of("report", HEAD).join(of("issue", STORED_ISSUE), "bundle_id", "left")


def read_advice(parts: DataFrame) -> DataFrame:
    return parts.where("part = 'advice'").select("bundle_id", F.get_json_object("body", "$.text").alias("recommendation"))


def write_reports(reports: DataFrame, path: str, run_date: str) -> None:
    """Append one run, partitioned by its date."""
    reports.withColumn("run_date", F.lit(run_date)).write.mode("append").partitionBy("run_date").parquet(path)


def legacy_issue(text: Column) -> Column:
    """'[file] Severity: text' as a struct; unknown severities become Info and keep the whole text."""
    raw = F.trim(text)
    has_file = raw.rlike(r"(?s)^\[[^\]]*\]")
    file_path = F.when(has_file, F.regexp_extract(raw, r"^\[([^\]]*)\]", 1))
    rest = F.when(has_file, F.trim(F.regexp_replace(raw, r"^\[[^\]]*\]", ""))).otherwise(raw)
    label = F.when(F.contains(rest, F.lit(": ")), F.split(rest, ": ", 2)[0])
    severity = F.lit(None).cast("string")
    for old, new in LEGACY_SEVERITY.items():
        severity = F.when(label == old, F.lit(new)).otherwise(severity)
    return F.when(
        raw != "",
        F.struct(
            F.coalesce(severity, F.lit("Info")).alias("severity"),
            F.when(severity.isNotNull(), F.split(rest, ": ", 2)[1]).otherwise(rest).alias("description"),
            file_path.alias("file_path"), F.lit(None).cast("int").alias("line_number"),
        ),
    )


def read_stored(rows: DataFrame) -> DataFrame:
    """Columns id, report, issues, score, level (texts) to one row per issue with score and level.

    The report wins; without one, issues are read as objects, else as legacy lines, and
    the level follows from the score.
    """
    parsed = rows.withColumns({
        "r": F.from_json("report", REPORT),
        "objects": F.from_json("issues", f"array<{ISSUE}>"),
        "lines": F.from_json("issues", "array<string>"),
    })
    legacy = F.filter(F.transform("lines", legacy_issue), lambda i: i.isNotNull())
    are_objects = F.exists("objects", lambda o: o["severity"].isNotNull())
    issues = F.coalesce(F.col("r.issues"), F.when(are_objects, F.col("objects")), legacy, F.array().cast(f"array<{ISSUE}>"))
    score = F.coalesce("r.score", "score")
    known = F.when(F.col("level").isin("Safe", "Low", "Medium", "High", "Critical"), F.col("level"))
    level = F.when(score.isNotNull(), F.coalesce("r.level", known, level_of_score(score)))
    return parsed.select("id", score.alias("score"), level.alias("level"), F.explode_outer(issues).alias("i")).select(
        "id", "score", "level", "i.severity", "i.description", "i.file_path")
