"""Findings after detection: kinds, deduplication, co-occurrence, scores and reports.

All shuffles here carry findings, never file text. Keys are either one line of one
file or pre-aggregated with partial aggregation, so a bundle that holds most of the
findings does not land in one task.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.text import mask_matches
from riskloom.packs.loader import rules_of
from riskloom.packs.policy import DEFAULT_POLICY, Policy
from riskloom.session import cut_lineage

# Ranks, bands, weights and prefix lists.
SEVERITY_RANK = {"Critical": 5, "High": 4, "Medium": 3, "Low": 2, "Info": 1}
DEFAULT_WEIGHT = {"Critical": 100, "High": 50, "Medium": 25, "Low": 10, "Info": 2}
CONFIDENCE_FACTOR = {"High": 1.0, "Medium": 0.65, "Low": 0.35}
LEVEL_BANDS = ((90, "Safe"), (70, "Low"), (50, "Medium"), (30, "High"))
LEVEL_RANK = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3, "Safe": 4}
TIER = {"Critical": "Severe", "High": "MidHigh", "Medium": "MidHigh", "Low": "Safe", "Safe": "Safe"}
BLOCKED_CEILING = 29
DISPLAY_CATEGORY = {
    "Destructive": "FileSystem", "RemoteExec": "ProcessExecution", "CmdInjection": "DangerousFunction",
    "Network": "Network", "PrivilegeEscalation": "Other", "Secrets": "DataExfiltration", "Persistence": "Other",
    "SensitiveFileAccess": "FileSystem", "PromptInjection": "Other", "SocialEngineering": "Other",
    "PolicyViolation": "Other", "Obfuscation": "ObfuscatedCode",
}
SECURITY_PREFIXES = (
    "CURL_PIPE_SH", "REVERSE_SHELL", "COMMAND_INJECTION", "CMD_INJECTION", "SQL_INJECTION", "PROMPT_INJECTION",
    "PI_", "SECRET_", "API_KEY", "PRIVATE_KEY", "DATA_EXFIL", "PIPELINE_", "TAINT_", "CONTENT_POISON_",
    "RAG_POISON_", "PICKLE_LOAD", "SUBPROCESS_CALL", "TOOL_ABUSE_", "RESOURCE_ABUSE_", "PATH_TRAVERSAL_",
    "GLOB_HIDDEN_FILE_TARGETING", "EVAL_", "EXEC_", "IEX_", "HOMOGLYPH_ATTACK", "FILE_MAGIC_MISMATCH",
    "OFFICE_VBA_MACRO", "OFFICE_EMBEDDED_OLE", "ALLOWED_TOOLS_READ_VIOLATION", "ALLOWED_TOOLS_WRITE_VIOLATION",
    "ALLOWED_TOOLS_BASH_VIOLATION", "ALLOWED_TOOLS_GREP_VIOLATION", "ALLOWED_TOOLS_GLOB_VIOLATION",
    "ALLOWED_TOOLS_NETWORK_USAGE",
)
AUDITABILITY_PREFIXES = ("UNANALYZABLE_BINARY", "OVERSIZED_FILE", "LOW_ANALYZABILITY", "BYTECODE_", "PDF_", "OFFICE_")
STRUCTURE_PREFIXES = (
    "STRUCTURE_DISALLOWED_SUBDIR", "STRUCTURE_DISALLOWED_EXTENSION", "STRUCTURE_NAME_DIR_MISMATCH",
    "STRUCTURE_MISSING_SKILL_MD", "STRUCTURE_INVALID_NAME", "STRUCTURE_INVALID_DESCRIPTION",
    "STRUCTURE_HIDDEN_FILE", "STRUCTURE_BINARY_CONTENT", "STRUCTURE_NON_UTF8",
    "STRUCTURE_COMPATIBILITY_TOO_LONG", "STRUCTURE_MISSING_REFERENCE", "STRUCTURE_ORPHAN_SCRIPT",
    "MANIFEST_MISSING_LICENSE", "FRONTMATTER_PARSE_ERROR", "HIDDEN_EXECUTABLE_SCRIPT", "HIDDEN_DATA_FILE",
    "PYCACHE_FILES_DETECTED", "TRIGGER_DESCRIPTION_TOO_SHORT", "TRIGGER_KEYWORD_BAITING",
    "TRIGGER_VAGUE_DESCRIPTION", "SOCIAL_ENG_MISLEADING_DESC", "TRIGGER_OVERLY_GENERIC",
)
STRUCTURE_CATEGORIES = ("SocialEngineering", "PolicyViolation")
ANALYZER_KIND = {"strict_structure": "Structure", "analyzability": "Auditability", "chains": "Security"}
ADVICE = {
    "Destructive": "Remove or guard destructive commands.",
    "RemoteExec": "Do not run downloaded code without verification.",
    "CmdInjection": "Avoid dynamic command execution.",
    "Network": "Review outgoing network traffic.",
    "Secrets": "Remove hard-coded credentials.",
    "Persistence": "Remove autostart and persistence changes.",
    "PrivilegeEscalation": "Avoid elevated privileges.",
    "SensitiveFileAccess": "Do not read sensitive files.",
}

FINDING_COLUMNS = (
    "bundle_id", "rel_path", "line_no", "rule_id", "category", "severity", "confidence", "weight",
    "hard_trigger", "snippet", "analyzer", "cwe_id", "description",
)


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())]), key)


def severity_rank(col: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_RANK, col), F.lit(0))


def level_of_score(score: Column) -> Column:
    level = F.lit("Critical")
    for low, name in reversed(LEVEL_BANDS):
        level = F.when(score >= low, F.lit(name)).otherwise(level)
    return level


def tier_of_level(level: Column) -> Column:
    return F.coalesce(lookup(TIER, level), F.lit("Safe"))


def finding_kind(rule_id: Column, category: Column, analyzer: Column) -> Column:
    upper = F.upper(rule_id)

    def starts(prefixes) -> Column:
        return upper.rlike("^(?:" + "|".join(prefixes) + ")")

    return (
        F.when(starts(SECURITY_PREFIXES), "Security")
        .when(starts(AUDITABILITY_PREFIXES), "Auditability")
        .when(starts(STRUCTURE_PREFIXES), "Structure")
        .when(category == "Obfuscation", "Auditability")
        .when(category.isin(*STRUCTURE_CATEGORIES), "Structure")
        .when(category.isNotNull(), "Security")
        .otherwise(F.coalesce(lookup(ANALYZER_KIND, analyzer), F.lit("Security")))
    )


def finding_id(rule_id: Column, path: Column, line_no: Column, salt: Column | None = None) -> Column:
    tail = F.concat(F.coalesce(line_no.cast("string"), F.lit("")), salt if salt is not None else F.lit(""))
    return F.substring(F.sha2(F.concat_ws("|", rule_id, F.coalesce(path, F.lit("")), tail), 256), 1, 16)


def with_kind(findings: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Attach the kind; structure findings stay only in strict mode."""
    graded = findings.withColumn("kind", finding_kind(F.col("rule_id"), F.col("category"), F.col("analyzer")))
    return graded if policy.strict_structure else graded.where(F.col("kind") != "Structure")


def from_rule_hits(graded: DataFrame) -> DataFrame:
    return graded.withColumn("analyzer", F.lit(None).cast("string")).select(*FINDING_COLUMNS)


def align(findings: DataFrame) -> DataFrame:
    """Give an analyzer's rows the shared columns, filling what it does not set."""
    types = {"line_no": "int", "weight": "int", "hard_trigger": "boolean"}
    have = set(findings.columns)
    return findings.select(
        *[
            (F.col(c) if c in have else F.lit(None)).cast(types.get(c, "string")).alias(c)
            for c in FINDING_COLUMNS
        ]
    )


def location_window() -> Window:
    return Window.partitionBy("bundle_id", F.coalesce("rel_path", F.lit("")), F.coalesce("line_no", F.lit(0)))


def deduplicate(findings: DataFrame) -> DataFrame:
    """Keep one row per rule, place and snippet: the most severe one.

    Aggregated, not ranked, so equal rows collapse before the shuffle.
    """
    snippet = F.sha2(F.coalesce("snippet", F.lit("")), 256)  # of the whole text, however long
    rest = [c for c in findings.columns if c not in ("bundle_id", "rel_path", "rule_id")]
    keyed = findings.withColumns({"_line": F.col("line_no"), "_snippet": snippet})
    order = F.struct(
        severity_rank(F.col("severity")), F.coalesce("hard_trigger", F.lit(False)),
        F.coalesce("weight", F.lit(-1)), F.coalesce("snippet", F.lit("")),
    )
    best = keyed.groupBy("bundle_id", "rel_path", "rule_id", "_line", "_snippet").agg(
        F.max_by(F.struct(*rest), order).alias("best")
    )
    return best.select("bundle_id", "rel_path", "rule_id", "best.*").select(*findings.columns)


def secret_patterns(policy: Policy = DEFAULT_POLICY) -> tuple[str, ...]:
    """Patterns of all rules that look for secrets, the disabled ones too."""
    return tuple(p for r in rules_of(policy) if r.category == "Secrets" for p in r.patterns)


def masked(findings: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Secrets leave no analysis in the clear: what a rule for secrets matches is hidden in every finding's snippet."""
    patterns = secret_patterns(policy)
    return findings.withColumn("snippet", mask_matches(F.col("snippet"), patterns)) if patterns else findings


def with_cooccurring_rules(findings: DataFrame) -> DataFrame:
    """Other rules reported at the same line of the same file."""
    here = F.collect_list("rule_id").over(location_window())
    return findings.withColumn(
        "same_line_rules", F.array_sort(F.filter(here, lambda r: r != F.col("rule_id")))
    )


def effective_weight() -> Column:
    """Rule weight scaled by confidence (hard triggers unscaled); severity default without a rule weight."""
    factor = F.coalesce(lookup(CONFIDENCE_FACTOR, F.col("confidence")), F.lit(1.0))
    base = F.coalesce(F.col("weight"), lookup(DEFAULT_WEIGHT, F.col("severity")))
    unscaled = F.col("weight").isNotNull() & F.coalesce(F.col("hard_trigger"), F.lit(False))
    return F.round(F.when(unscaled, base.cast("double")).otherwise(base * factor)).cast("int")


def blocks() -> Column:
    """Analyzer findings block when critical or hard; rule hits only when hard."""
    hard = F.coalesce(F.col("hard_trigger"), F.lit(False))
    return hard | (F.col("analyzer").isNotNull() & (F.col("severity") == "Critical"))


def rule_deductions(findings: DataFrame, score_kinds: tuple[str, ...] | None) -> DataFrame:
    """Per bundle and rule: highest weight and number of distinct files."""
    scored = findings.withColumn("eff", effective_weight()).where(F.col("eff") > 0)
    if score_kinds:
        scored = scored.where(F.col("kind").isin(*score_kinds))
    per_file = scored.groupBy("bundle_id", "rule_id", F.coalesce("rel_path", F.lit("")).alias("file")).agg(
        F.max("eff").alias("w")
    )
    return per_file.groupBy("bundle_id", "rule_id").agg(
        F.max("w").alias("weight"), F.count(F.lit(1)).alias("n_files")
    )


def scores(findings: DataFrame, score_kinds: tuple[str, ...] | None = DEFAULT_POLICY.score_kinds,
           bundles: DataFrame | None = None) -> DataFrame:
    """100 less w·(1−0.5ⁿ)/0.5 per rule, floor 0; a blocked bundle gets at most 29."""
    deduction = F.col("weight") * (1 - F.pow(F.lit(0.5), F.col("n_files"))) / 0.5
    lost = rule_deductions(findings, score_kinds).groupBy("bundle_id").agg(F.sum(deduction).alias("lost"))
    counts = findings.groupBy("bundle_id").agg(
        F.max(blocks()).alias("blocked"),
        F.count(F.lit(1)).alias("n_findings"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k.lower()}") for k in ("Security", "Auditability", "Structure")],
    )
    base = counts
    extra = []
    if bundles is not None:
        extra = [c for c in bundles.columns if c == "partial_scan"]
        base = bundles.groupBy("bundle_id").agg(F.count(F.lit(1)), *[F.max(c).alias(c) for c in extra]).join(counts, "bundle_id", "left")
    joined = base.join(lost, "bundle_id", "left")
    raw = F.round(F.greatest(100 - F.coalesce("lost", F.lit(0.0)), F.lit(0.0))).cast("int")
    blocked = F.coalesce("blocked", F.lit(False))
    score = F.when(blocked, F.least(raw, F.lit(BLOCKED_CEILING))).otherwise(raw)
    numbers = ["n_findings", "n_security", "n_auditability", "n_structure"]
    return joined.select(
        "bundle_id", score.alias("score"), level_of_score(score).alias("level"), blocked.alias("blocked"),
        *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in numbers], *extra,
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("bundle_id").agg(
        *[F.count(F.when(F.col("severity") == s, 1)).alias(f"n_{s.lower()}") for s in SEVERITY_RANK]
    )


def hard_messages(findings: DataFrame) -> DataFrame:
    """Distinct block messages; equal ones collapse before the list is built."""
    text = F.concat_ws(": ", F.col("rule_id"), F.col("description"))
    return findings.where(blocks()).select("bundle_id", text.alias("message")).distinct()


def recommendations(findings: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per bundle and line of advice, chosen by block state, score band and categories."""
    categories = findings.where(F.col("analyzer").isNull()).groupBy("bundle_id").agg(
        F.collect_set("category").alias("categories")  # at most the twelve categories
    )
    rows = scored.select("bundle_id", "score", "blocked").join(categories, "bundle_id", "left")
    have = F.coalesce("categories", F.array().cast("array<string>"))
    advice = F.array(
        F.when(F.col("score") < 50, "Severe risk: do not use without review.")
        .when(F.col("score") < 70, "Medium risk: review before use."),
        *[F.when(F.array_contains(have, c), F.lit(text)) for c, text in ADVICE.items()],
    )
    given = F.filter(advice, lambda a: a.isNotNull())
    lines = (
        F.when(F.col("blocked"), F.array(F.lit("Blocked: hard triggers found.")))
        .when(F.size(given) == 0, F.array(F.lit("No issues found.")))
        .otherwise(given)
    )
    # A blocked bundle's advice goes on with what blocks it, a row each.
    triggers = hard_messages(findings).select("bundle_id", F.concat(F.lit("Hard trigger: "), "message").alias("recommendation"))
    return rows.select("bundle_id", F.explode(lines).alias("recommendation")).unionByName(triggers)


def install_gate(scored: DataFrame, allow_partial: bool = False) -> DataFrame:
    """May the bundle be installed, and if not, why."""
    reason = F.when(F.col("blocked"), "hard_trigger").when(F.col("partial_scan") & F.lit(not allow_partial), "partial_scan")
    return scored.select("bundle_id", reason.isNull().alias("installable"), reason.alias("reason"))


def top_issues(findings: DataFrame, n: int = 3) -> DataFrame:
    """The n most severe distinct issues of each bundle.

    A first cut per (bundle, hash of the issue) keeps any one task's share of a hot
    bundle small; n candidates per slice are enough for an exact overall top n.
    """
    text = F.concat_ws(": ", F.col("rule_id"), F.col("description"))
    order = F.struct(F.coalesce("line_no", F.lit(-1)), severity_rank(F.col("severity")))
    distinct = findings.groupBy("bundle_id", "rel_path", text.alias("issue")).agg(
        F.max_by("severity", order).alias("severity")
    )
    rank = [severity_rank(F.col("severity")).desc(), F.coalesce("rel_path", F.lit("")), F.col("issue")]
    sliced = distinct.withColumn("_slice", F.abs(F.xxhash64("rel_path", "issue")) % 64)
    per_slice = Window.partitionBy("bundle_id", "_slice").orderBy(*rank)
    overall = Window.partitionBy("bundle_id").orderBy(*rank)
    return (
        sliced.withColumn("_r", F.row_number().over(per_slice)).where(F.col("_r") <= n)
        .withColumn("position", F.row_number().over(overall)).where(F.col("position") <= n)
        .select("bundle_id", "position", "rel_path", "issue", "severity")
    )


def by_signature(findings: DataFrame) -> DataFrame:
    """Equal severity, file and rule text: one row with its number of places and first line."""
    return findings.groupBy("bundle_id", "severity", "rel_path", "rule_id", "description").agg(
        F.count(F.lit(1)).alias("n_places"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")
    )


def signature_members(findings: DataFrame) -> DataFrame:
    """The findings behind each row of by_signature, a row each, under the signature's id."""
    signature = F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("bundle_id", "severity", "rel_path", "rule_id", "description")]), 256), 1, 32)
    return findings.select(signature.alias("signature"), "bundle_id", "rel_path", "rule_id", "line_no")


def in_file_order(findings: DataFrame) -> DataFrame:
    """A sort reads its rows twice, first to find the ranges, so they are kept as a table; as in in_severity_order."""
    return cut_lineage(findings, "unordered").orderBy(
        "bundle_id", F.coalesce("rel_path", F.lit("")), F.coalesce("line_no", F.lit(0)),
        severity_rank(F.col("severity")).desc(), "rule_id",
    )


def in_severity_order(findings: DataFrame) -> DataFrame:
    return cut_lineage(findings, "unordered").orderBy(
        severity_rank(F.col("severity")).desc(), F.coalesce("rel_path", F.lit("")),
        F.col("line_no").asc_nulls_last(), "bundle_id", "rule_id",
    )


CROSS_RULES = (
    "CROSS_SKILL_DATA_RELAY", "CROSS_SKILL_SHARED_URL", "CROSS_SKILL_COMPLEMENTARY_TRIGGERS",
    "CROSS_SKILL_SHARED_PATTERN",
)


def add_corpus_findings(findings: DataFrame, cross: DataFrame, bundles: DataFrame) -> DataFrame:
    """Count every corpus-wide finding type against every scanned bundle.

    Corpus findings carry no file, so per bundle and rule only one counts for the score:
    each bundle gets one row per finding type that occurs (four at most), by equi-join.
    """
    types = cross.groupBy("rule_id").agg(
        F.first("category").alias("category"), F.first("severity").alias("severity"),
        F.first("confidence").alias("confidence"), F.first("analyzer").alias("analyzer"),
    )
    wanted = bundles.select("bundle_id", F.explode(F.array(*[F.lit(r) for r in CROSS_RULES])).alias("rule_id"))
    # Four rows at most, one for each of CROSS_RULES.
    rows = align(wanted.join(F.broadcast(types), "rule_id")).withColumn("kind", F.lit("Security"))
    return findings.unionByName(rows)
