"""What a manifest declares against what the bundle's scripts do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import sqltext as S
from riskloom.functions import text as T
from riskloom.packs.loader import java_regex

# Code patterns per capability, in order of the checks.
CAPABILITIES = {
    "READ": ("Medium", (r"""open\(.*['"]r""", r"\.read\(\)", r"\.read_text\(", r"\.read_bytes\(")),
    "WRITE": ("Medium", (r"""open\(.*['"]w""", r"\.write\(", r"\.writelines\(", r"\.write_text\(", r"\.write_bytes\(")),
    "BASH": ("High", (
        r"subprocess\.(run|call|Popen)", r"os\.system", r"shell\s*=\s*True", r"os\.popen", r"(?i)\bbash\b",
        r"(?i)\bsh\s+-c\b", r"(?i)\b(?:/bin/)?sh\b\s+", r"(?i)\bexec\s+", r"(?i)\b(?:pwsh|powershell)\b")),
    "GREP": ("Low", (r"re\.(search|findall|match|finditer|sub)\(", r"\bgrep\b")),
    "GLOB": ("Low", (r"glob\.glob", r"\.rglob\(", r"\.glob\(", r"fnmatch\.")),
}
NETWORK = (
    r"requests\.(get|post|put|delete)", r"urllib\.(request|error)",
    r"from\s+urllib\s+import\s+[^\n]*\b(request|error)\b", r"\burlopen\s*\(", r"httpx", r"aiohttp", r"socket\.connect",
)
SOCKET = r"socket\.(socket|connect|create_connection)\s*\("
HTTP_URL = r"""https?://[^\s"'`]+"""
SYNONYMS = {
    "shell": "bash", "terminal": "bash", "filewrite": "write", "filesystemwrite": "write",
    "fileread": "read", "filesystemread": "read",
}
GENERIC = (
    r"(?i)^help\s", r"(?i)^assistant$", r"(?i)^helper$", r"(?i)do\s+(anything|everything)",
    r"(?i)general\s+purpose", r"(?i)universal",
)
SIMPLE_FEATURE = r"(?i)calculator|format|template|style|lint|converter|parser"
VAGUE_WORDS = (
    "help helper assistant tool utility useful general simple basic easy quick fast good nice best great smart "
    "powerful automate manage handle process support"
).split()
TECH_WORDS = (
    "api http json yaml docker kubernetes aws azure gcp sql database regex parser compiler terraform ansible ci/cd "
    "git ssh ssl tls rest grpc websocket oauth jwt encryption hash token webhook microservice container linux python "
    "javascript typescript rust go react vue angular node express flask django"
).split()
MIN_WORDS = 5
VAGUE_SHARE = 0.4
BAIT_COMMAS = 7
SALTS = 16


def capability_names() -> Column:
    """Capabilities a text uses, as an array; reads `content` and its lower-case form `folded`."""
    local = "(contains(u, '127.0.0.1') OR contains(u, 'localhost'))"
    remote_url = f"exists(regexp_extract_all(content, {S.quoted(java_regex(HTTP_URL))}, 0), u -> NOT {local})"
    sockets = f"({S.guarded('content', 'folded', [SOCKET])} AND NOT {local.replace('(u,', '(content,')})"
    network = f"{S.guarded('content', 'folded', NETWORK)} AND ({remote_url} OR {sockets})"
    tests = {name: S.guarded("content", "folded", patterns) for name, (_, patterns) in CAPABILITIES.items()}
    tests["NETWORK"] = network
    used = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in tests.items())
    return F.expr(f"filter(array({used}), c -> c IS NOT NULL)")


def script_capabilities(files: DataFrame) -> DataFrame:
    """(bundle_id, rel_path, capability) for every capability a script uses; row-wise."""
    scripts = files.where((F.col("file_type") == "script") & ~F.col("is_binary")).withColumn("folded", T.folded(F.col("content")))
    rows = scripts.select("bundle_id", "rel_path", F.explode_outer(capability_names()).alias("capability"))
    return rows.where(F.col("capability").isNotNull())


def declared_tools(bundles: DataFrame) -> DataFrame:
    """(bundle_id, declared capabilities) of bundles that declare any tool."""
    def canonical(tool: Column) -> Column:
        name = F.regexp_replace(F.lower(tool), "[-_ ]", "")
        mapped = F.lit(None).cast("string")
        for synonym, capability in SYNONYMS.items():
            mapped = F.when(name == synonym, F.lit(capability)).otherwise(mapped)
        return F.upper(F.coalesce(mapped, name))

    return bundles.where(F.size("allowed_tools") > 0).select(
        "bundle_id", F.transform("allowed_tools", canonical).alias("declared")
    )


def undeclared_capabilities(capabilities: DataFrame, bundles: DataFrame) -> DataFrame:
    """Uses without a declaration; network use is always reported.

    The manifest row is repeated per salt and the uses are salted by path, so one
    bundle with very many scripts is joined in several tasks.
    """
    salted = capabilities.withColumn("salt", F.pmod(F.xxhash64("rel_path"), F.lit(SALTS)).cast("int"))
    declared = declared_tools(bundles).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(declared, ["bundle_id", "salt"])
    violation = (F.col("capability") == "NETWORK") | ~F.array_contains("declared", F.col("capability"))
    severity = F.when(F.col("capability") == "NETWORK", "Medium")
    for name, (level, _) in CAPABILITIES.items():
        severity = severity.when(F.col("capability") == name, level)
    is_network = F.col("capability") == "NETWORK"
    return joined.where(violation).select(
        "bundle_id", "rel_path",
        F.when(is_network, "ALLOWED_TOOLS_NETWORK_USAGE")
        .otherwise(F.concat(F.lit("ALLOWED_TOOLS_"), "capability", F.lit("_VIOLATION"))).alias("rule_id"),
        F.when(is_network, "Network").otherwise("PolicyViolation").alias("category"),
        severity.alias("severity"),
    )


def network_bundles(capabilities: DataFrame) -> DataFrame:
    return capabilities.where(F.col("capability") == "NETWORK").select("bundle_id").distinct()


def manifest_contradictions(capabilities: DataFrame, bundles: DataFrame) -> DataFrame:
    """Network use that the compatibility note or the description does not lead one to expect."""
    described = bundles.where("has_manifest").join(network_bundles(capabilities), "bundle_id", "left_semi")

    def names_network(s: Column) -> Column:
        return F.lower(s).rlike("network|internet")

    declared = F.exists(F.map_keys("compatibility"), names_network) | F.exists(F.map_values("compatibility"), names_network)
    rules = F.array(
        F.when((F.size("compatibility") > 0) & ~declared, F.struct(
            F.lit("TOOL_ABUSE_UNDECLARED_NETWORK").alias("rule_id"), F.lit("PolicyViolation").alias("category"))),
        F.when(F.col("description").rlike(SIMPLE_FEATURE), F.struct(
            F.lit("SOCIAL_ENG_MISLEADING_DESC").alias("rule_id"), F.lit("SocialEngineering").alias("category"))),
    )
    rows = described.select("bundle_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r"))
    return rows.select("bundle_id", "r.*", F.lit("Medium").alias("severity"))


def description_metrics(bundles: DataFrame) -> DataFrame:
    text = F.lower("description")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rows = bundles.where(F.coalesce(F.length("description"), F.lit(0)) > 0)
    return rows.select(
        "bundle_id", "description",
        F.size(words).alias("n_words"),
        F.size(F.filter(words, lambda w: w.isin(*VAGUE_WORDS))).alias("n_vague"),
        F.size(F.filter(words, lambda w: w.isin(*TECH_WORDS))).alias("n_tech"),
        F.regexp_count("description", F.lit(",")).alias("n_commas"),
        T.matches_any(F.col("description"), GENERIC).alias("is_generic"),
        text.rlike(r"example|such as|including|e\.g\.").alias("is_example_list"),
    )


def description_findings(bundles: DataFrame) -> DataFrame:
    m = description_metrics(bundles)
    vague = (F.col("n_words") > 0) & (F.col("n_vague") / F.col("n_words") > VAGUE_SHARE) & (F.col("n_tech") < 2)
    tests = (
        ("TRIGGER_OVERLY_GENERIC", "Medium", F.col("is_generic")),
        ("TRIGGER_DESCRIPTION_TOO_SHORT", "Low", F.col("n_words") < MIN_WORDS),
        ("TRIGGER_VAGUE_DESCRIPTION", "Low", vague),
        ("TRIGGER_KEYWORD_BAITING", "Medium", (F.col("n_commas") >= BAIT_COMMAS) & ~F.col("is_example_list")),
    )
    hits = F.array(*[
        F.when(test, F.struct(F.lit(rule).alias("rule_id"), F.lit(level).alias("severity"))) for rule, level, test in tests
    ])
    rows = m.select("bundle_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return rows.select("bundle_id", "h.rule_id", F.lit("SocialEngineering").alias("category"), "h.severity")
