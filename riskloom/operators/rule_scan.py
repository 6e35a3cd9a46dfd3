"""Rule packs as column expressions over one file row.

Every rule becomes: applies to the file type, a literal occurs in the folded text,
then the regular expression on the lines that hold the literal. Nothing shuffles,
and a file without any candidate literal costs only substring tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import sqltext as S
from riskloom.functions import text as T
from riskloom.functions.paths import is_markdown
from riskloom.functions.urls import EXEC_CONTEXT, targets_known_installer
from riskloom.packs.loader import java_regex, rules_of
from riskloom.packs.model import Rule
from riskloom.packs.policy import DEFAULT_POLICY, Policy

INSTALLER_RULES = ("CURL_PIPE_SH", "WGET_PIPE_SH", "POWERSHELL_PIPE_IEX", "POWERSHELL_IEX_DOWNLOAD")
INSTALLER_WEIGHT = 15
PACKAGE_INSTALL = "TOOL_ABUSE_SYSTEM_PACKAGE_INSTALL"

# Fixed values used by the context tests below.
SOURCE_EXTS = ("py", "js", "mjs", "cjs", "ts", "tsx", "jsx")
INSTALL_COMMAND = (
    r"(?i)(?:\b(?:apt-get|apt|yum|dnf|brew)\s+install\b|\bpip\s+install\b|\bnpm\s+install\s+-g\b)"
)
DISPLAY_STATEMENT = (
    r"^(?:return\b|raise\b|yield\b|print\s*\(|sys\.(?:stdout|stderr)\.write\s*\("
    r"|(?:logger|logging|log|_log)\.(?:debug|info|warning|warn|error|critical|exception)\s*\()"
)
SENSITIVE_TARGETS = (
    "/etc/", "/var/", "/usr/", "/bin/", "/sbin/", "/root/", "~/.ssh", "~/.aws", "~/.config", "~/.kube",
    "~/.docker", ".ssh/", ".aws/", ".kube/", ".docker/", ".npmrc", ".netrc", ".env", "id_rsa", "id_ed25519",
    "authorized_keys", "private_key", "secret", "token", "password",
)
LOOP_EXIT = r"^(?:break$|break |return$|return |raise$|raise |sys\.exit\(|exit\()"
CONCEALMENT_EXCEPTIONS = (
    "do not tell the user to run", "do not tell the user to use", "do not tell the user to execute",
)
CONTEXTUAL_RULES = (
    PACKAGE_INSTALL, "SVG_EMBEDDED_SCRIPT", "PDF_EMBEDDED_JAVASCRIPT", "DATA_EXFIL_JS_FS_ACCESS",
    "RESOURCE_ABUSE_INFINITE_LOOP", "SUBPROCESS_CALL", "PROMPT_INJECTION_CONCEALMENT",
)
HIT = "struct<rule_id: string, line_no: int, snippet: string>"
HIT_ARRAY = f"array<{HIT}>"
SHELL_TRUE_LINES = 6
EXEC_LOOKBACK = 4
HEAD_LOOKBACK = 8


def prepare(files: DataFrame) -> DataFrame:
    """Attach the text forms the scan reads: lines, logical lines and folded texts.

    Each step is its own projection so that no form is computed twice.
    """
    rows = (
        files.withColumn("lines", T.physical_lines(F.col("content")))
        .withColumn("marked", T.mark_continuations(F.col("content"), F.col("ext")))
        .withColumn("items", T.logical_lines(F.col("marked")))
        .withColumns({"folded": T.folded(F.col("content")), "marks": F.expr(S.marks_column("content"))})
        .withColumn(
            "folded_logical",
            F.when(
                F.contains(F.col("content"), F.lit("+")) | F.contains(F.col("marked"), F.lit(T.JOIN_MARK)),
                F.array_join(F.transform(F.col("items"), lambda x: x["folded"]), "\n"),
            ).otherwise(F.col("folded")),
        )
        .drop("marked")
    )
    return with_words(rows)


def with_words(rows: DataFrame) -> DataFrame:
    """Attach what literal tests read in place of folded_logical: its distinct words, and the longest one's bytes."""
    return (
        rows.withColumn("words", F.expr(S.word_list("folded_logical")))
        .withColumns({"logical_words": F.array_join("words", " "), "longest_word": F.expr(S.longest_word("words"))})
        .drop("words")
    )


def applies_sql(rule: Rule) -> str:
    """An empty list means every file; the main file meets every rule."""
    if not rule.file_types:
        return "true"
    exts = [t[1:] for t in rule.file_types if t.startswith(".")]
    return f"(is_main OR ext IN ({S.listed(exts)}))" if exts else "is_main"


def _quote_is_open(prefix: Column) -> Column:
    """The prefix ends inside a string literal: drop escapes and closed literals, look for a quote."""
    no_escapes = F.regexp_replace(prefix, r"\\.", "")
    rest = F.regexp_replace(no_escapes, r"""'[^']*'|"[^"]*\"""", "")
    return rest.rlike("['\"]")


def _display_hint(item: Column) -> Column:
    """The install command only occurs in text that is shown, logged or raised."""
    lines, no = F.col("lines"), item["line_no"]
    line = F.try_element_at(lines, no)
    before = F.split(line, java_regex(INSTALL_COMMAND), 2)[0]
    start = F.greatest(no - HEAD_LOOKBACK, F.lit(1))
    window = F.transform(F.slice(lines, start, no - start + 1), lambda s: F.trim(s))
    statements = F.filter(window, lambda s: (s != "") & ~s.rlike(r"""^[rRbBfFuU]{0,2}["']"""))
    head = F.try_element_at(statements, F.lit(-1))
    exec_start = F.greatest(no - EXEC_LOOKBACK, F.lit(1))
    near = F.array_join(F.slice(lines, exec_start, no - exec_start + 1), "\n")
    return F.coalesce(
        F.col("ext").isin(*SOURCE_EXTS)
        & T.matches(line, INSTALL_COMMAND)
        & _quote_is_open(before)
        & T.matches(head, DISPLAY_STATEMENT)
        & ~T.matches(near, EXEC_CONTEXT),
        F.lit(False),
    )


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, java_regex(r"^\s+"), ""))


def loop_verdict(item: Column) -> Column:
    """What comes first below a loop head: exit (a statement that leaves it) or out (a dedent); null if neither does."""
    lines, no = F.col("lines"), item["line_no"]
    own = indent(F.try_element_at(lines, no))
    below = F.filter(F.slice(lines, no + 1, F.size(lines)), lambda s: F.trim(s) != "")
    verdicts = F.transform(
        below,
        lambda s: F.when(indent(s) <= own, F.lit("out")).when(F.trim(s).rlike(LOOP_EXIT), F.lit("exit")),
    )
    return F.try_element_at(F.filter(verdicts, lambda v: v.isNotNull()), F.lit(1))


def _loop_exits(item: Column) -> Column:
    """Below the loop head, an exit statement comes before the first dedent."""
    return F.coalesce(loop_verdict(item) == "exit", F.lit(False))


def suppression_reason(rule: Rule, item: Column) -> Column:
    """Why a hit of the contextual rule is not reported; null when it is."""
    path = F.col("rel_path")
    raw = F.try_element_at(F.col("lines"), item["line_no"])
    if rule.rule_id == PACKAGE_INSTALL:
        return (
            F.when(is_markdown(path) & ~F.col("is_main"), F.lit("documentation"))
            .when(~is_markdown(path) & _display_hint(item), F.lit("display_text"))
        )
    if rule.rule_id in ("SVG_EMBEDDED_SCRIPT", "PDF_EMBEDDED_JAVASCRIPT"):
        return F.when(is_markdown(path), F.lit("markdown"))
    if rule.rule_id == "DATA_EXFIL_JS_FS_ACCESS":
        harmless = ~T.contains_any(F.lower(raw), SENSITIVE_TARGETS)
        return F.when(F.coalesce(harmless, F.lit(True)), F.lit("no_sensitive_target"))
    if rule.rule_id == "RESOURCE_ABUSE_INFINITE_LOOP":
        return F.when(_loop_exits(item), F.lit("loop_exits"))
    if rule.rule_id == "SUBPROCESS_CALL":
        window = F.array_join(F.slice(F.col("lines"), item["line_no"], SHELL_TRUE_LINES), "\n")
        return F.when(~T.matches(F.lower(window), r"shell\s*=\s*true"), F.lit("no_shell"))
    return F.when(T.contains_any(F.lower(raw), CONCEALMENT_EXCEPTIONS), F.lit("instruction_to_user"))


def matching_items_sql(rule: Rule) -> str:
    hit = S.guarded("x.text", "x.folded", rule.line_patterns)
    return f"filter(items, x -> {hit} AND NOT {S.any_rlike('x.text', rule.excludes)})"


def _line_guard_sql(rule: Rule) -> str:
    possible = S.any_possible("folded_logical", rule.line_patterns, "logical_words", "longest_word", "marks")
    return f"{S.has_marks(rule.line_patterns)} AND {applies_sql(rule)} AND {possible}"


def _is_contextual(rule: Rule) -> bool:
    return rule.rule_id in CONTEXTUAL_RULES


def line_hits_sql(rule: Rule) -> str:
    """array<struct<rule_id, line_no, snippet>> of the rule's single-line patterns, as expression text."""
    hit = f"named_struct('rule_id', {S.quoted(rule.rule_id)}, 'line_no', x.line_no, 'snippet', x.text)"
    return f"CASE WHEN {_line_guard_sql(rule)} THEN transform({matching_items_sql(rule)}, x -> {hit}) END"


def contextual_hits(rule: Rule, suppressed: bool = False) -> Column:
    """The same for rules whose hits depend on neighbouring lines; or the withheld hits, with the reason."""
    found = F.filter(
        F.expr(matching_items_sql(rule)),
        lambda x: suppression_reason(rule, x).isNotNull() if suppressed else suppression_reason(rule, x).isNull(),
    )

    def hit(x: Column) -> Column:
        fields = [F.lit(rule.rule_id).alias("rule_id"), x["line_no"].alias("line_no"), x["text"].alias("snippet")]
        if suppressed:
            fields.append(suppression_reason(rule, x).alias("reason"))
        return F.struct(*fields)

    return F.when(F.expr(_line_guard_sql(rule)), F.transform(found, hit))


def content_hit_sql(rule: Rule) -> str:
    """First whole-text match of the patterns that span or name line breaks."""
    options = []
    for p in rule.content_patterns:
        regex = S.quoted(java_regex(p))
        found = f"regexp_extract(content, {regex}, 0)"
        before = f"split(content, {regex}, 2)[0]"
        line = f"length({before}) - length(replace({before}, '\\n', '')) + 1"
        hit = (
            f"named_struct('rule_id', {S.quoted(rule.rule_id)}, 'line_no', {line}, 'snippet', {found})"
        )
        test = f"{S.has_marks([p])} AND {S.guarded('content', 'folded', [p])} AND NOT {S.any_rlike(found, rule.excludes)}"
        options.append(f"CASE WHEN {test} THEN {hit} END")
    return f"CASE WHEN {applies_sql(rule)} THEN coalesce({', '.join(options)}) END"


def enabled_rules(policy: Policy) -> list[Rule]:
    return [r for r in rules_of(policy) if r.rule_id not in policy.disabled_rules]


def line_rule_hits(policy: Policy = DEFAULT_POLICY) -> Column:
    rules = [r for r in enabled_rules(policy) if r.line_patterns]
    none = F.expr(f"array(CAST(NULL AS {HIT_ARRAY}))")
    plain = ", ".join(line_hits_sql(r) for r in rules if not _is_contextual(r))
    context = [contextual_hits(r) for r in rules if _is_contextual(r)]
    parts = F.concat(none, *[F.expr(f"array({plain})")] * bool(plain), *[F.array(*context)] * bool(context))
    return F.flatten(F.filter(parts, lambda a: a.isNotNull()))


def content_rule_hits(policy: Policy = DEFAULT_POLICY) -> Column:
    hits = [f"CAST(NULL AS {HIT})", *[content_hit_sql(r) for r in enabled_rules(policy) if r.content_patterns]]
    return F.expr(f"filter(array({', '.join(hits)}), h -> h IS NOT NULL)")


def explode_hits(rows: DataFrame, keys: list[str], hits: str) -> DataFrame:
    """One row per hit.

    explode_outer plus a test on the result: a filter derived from plain explode
    would be pushed below and evaluate the whole rule set a second time.
    """
    return (
        rows.select(*keys, F.explode_outer(hits).alias("hit"))
        .where(F.col("hit.rule_id").isNotNull())
        .select(*keys, "hit.*")
    )


FILE_KEYS = ["bundle_id", "rel_path", "ext", "is_main", "is_doc_path"]


def scan_lines(files: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    rows = prepare(files).select(*FILE_KEYS, line_rule_hits(policy).alias("hits"))
    return explode_hits(rows, FILE_KEYS, "hits")


def scan_content(files: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    texts = files.withColumns({"folded": T.folded(F.col("content")), "marks": F.expr(S.marks_column("content"))})
    rows = texts.select(*FILE_KEYS, content_rule_hits(policy).alias("hits"))
    return explode_hits(rows, FILE_KEYS, "hits")


def scan_rules(files: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Both passes over one read of the text."""
    both = F.concat(line_rule_hits(policy), content_rule_hits(policy))
    return explode_hits(prepare(files).select(*FILE_KEYS, both.alias("hits")), FILE_KEYS, "hits")


def suppressed_hits(files: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Hits withheld by a context test, with the reason."""
    parts = F.array(*[contextual_hits(r, suppressed=True) for r in rules_of(policy) if _is_contextual(r)])
    rows = prepare(files).select(*FILE_KEYS, F.flatten(F.filter(parts, lambda a: a.isNotNull())).alias("hits"))
    return explode_hits(rows, FILE_KEYS, "hits")


def rules_table(spark, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """One row per enabled rule, overrides applied; its size is that of the packs."""
    severity = dict(policy.severity_overrides)
    hard = dict(policy.hard_trigger_overrides)
    rows = [
        (r.rule_id, r.category, severity.get(r.rule_id, r.severity), r.confidence, r.weight,
         hard.get(r.rule_id, r.hard_trigger), r.cwe_id, r.description)
        for r in enabled_rules(policy)
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, category string, severity string, confidence string, weight int, "
        "hard_trigger boolean, cwe_id string, description string",
    )


def _one_level_down(severity: Column) -> Column:
    return (
        F.when(severity == "Critical", "High").when(severity == "High", "Medium")
        .when(severity == "Medium", "Low").otherwise(severity)
    )


def _at_most_medium(severity: Column) -> Column:
    return F.when(severity.isin("Critical", "High"), "Medium").otherwise(severity)


def grade_hits(hits: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Attach rule data and apply the main-file, installer and documentation grading."""
    rules = F.broadcast(rules_table(hits.sparkSession, policy))
    sev, hard, weight = F.col("severity"), F.col("hard_trigger"), F.col("weight")
    notice = (F.col("rule_id") == PACKAGE_INSTALL) & F.col("is_main")
    installer = F.when(
        F.col("rule_id").isin(*INSTALLER_RULES),
        targets_known_installer(F.col("snippet"), policy) & ~T.matches(F.col("snippet"), EXEC_CONTEXT),
    ).otherwise(F.lit(False))
    graded = (
        hits.join(rules, "rule_id")
        .withColumn("is_notice", notice)
        .withColumn("is_installer", installer & ~notice)
        .withColumn("severity", F.when(F.col("is_notice"), "Info").when(F.col("is_installer"), _at_most_medium(sev)).otherwise(sev))
        .withColumn("hard_trigger", hard & ~F.col("is_notice") & ~F.col("is_installer"))
        .withColumn(
            "weight",
            F.when(F.col("is_notice"), F.lit(0))
            .when(F.col("is_installer"), F.least(weight, F.lit(INSTALLER_WEIGHT)))
            .otherwise(weight),
        )
    )
    in_docs = F.col("is_doc_path") & ~F.col("is_main")
    injection = F.col("rule_id").startswith("PROMPT_INJECTION_") & hard
    halved = F.greatest(F.floor(weight / 2).cast("int"), F.lit(1))
    return (
        graded.where(~(in_docs & F.col("rule_id").isin(*policy.skip_in_docs)))
        .withColumn("doc_injection", in_docs & injection)
        .withColumn("doc_generic", in_docs & ~hard)
        .withColumn(
            "severity",
            F.when(F.col("doc_injection"), F.when(sev == "Medium", "Low").otherwise(_at_most_medium(sev)))
            .when(F.col("doc_generic"), _one_level_down(sev))
            .otherwise(sev),
        )
        .withColumn("weight", F.when(F.col("doc_injection") | F.col("doc_generic"), halved).otherwise(weight))
        .withColumn("hard_trigger", hard & ~F.col("doc_injection"))
        .drop("is_notice", "is_installer", "doc_injection", "doc_generic")
    )


def drop_suppressed_rules(hits: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Drop a hit when a rule listed as its suppressor hit the same line.

    Keyed by (file, line), so no key grows with a bundle.
    """
    suppressors = {r.rule_id: r.suppressed_by for r in rules_of(policy) if r.suppressed_by}
    here = F.collect_set("rule_id").over(Window.partitionBy("bundle_id", "rel_path", "line_no"))
    if not suppressors:
        return hits
    lost = T.any_of([
        (F.col("rule_id") == rule) & F.arrays_overlap(F.col("rules_here"), F.array(*[F.lit(s) for s in by]))
        for rule, by in suppressors.items()
    ])
    return hits.withColumn("rules_here", here).where(~lost).drop("rules_here")
