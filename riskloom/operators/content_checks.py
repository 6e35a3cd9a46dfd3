"""Unicode, asset-file and byte-signature checks; one file row in, findings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as T
from riskloom.functions.paths import is_asset_path, is_office_part
from riskloom.operators.findings import lookup
from riskloom.operators.rule_scan import explode_hits
from riskloom.packs.loader import literal_need

# Characters that look like Latin letters, and their twins, in the same order.
_FULL_WIDTH = "".join(chr(c) for c in range(0xFF21, 0xFF3B))
LOOKALIKES = (
    "\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0458\u04bb\u0410\u0412\u0415\u041a\u041c\u041d\u041e\u0420"
    "\u0421\u0422\u0423\u0425\u0406\u0408\u04ae\u03b1\u03b5\u03b9\u03ba\u03bd\u03bf\u03c1\u03c3\u03c4\u03c5\u03c7"
    "\u0391\u0392\u0395\u0396\u0397\u0399\u039a\u039c\u039d\u039f\u03a1\u03a4\u03a5\u03a7\u0251\u0261\u028c\u029c"
    "\u2100\u2101\u2102\u210a\u210b\u210d\u2110\u2112\u2113\u2115\u2119\u211a\u211b\u211d\u2124\u2128" + _FULL_WIDTH
)
TWINS = (
    "aeopcyxijhABEKMHOPCTyXIJYaeikvopotuxABEZHIKMNOPTYXagvHaaCgHHILlNPQRRZZ" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)
LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
ZERO_WIDTH = {
    "\u200b": "ZERO WIDTH SPACE", "\u200c": "ZERO WIDTH NON-JOINER", "\u200d": "ZERO WIDTH JOINER",
    "\ufeff": "BOM/ZERO WIDTH NO-BREAK SPACE", "\u2060": "WORD JOINER", "\u00ad": "SOFT HYPHEN",
    "\u2028": "UNKNOWN", "\u2029": "UNKNOWN", "\u2064": "UNKNOWN", "\u2062": "UNKNOWN", "\u2061": "UNKNOWN",
    "\u2063": "UNKNOWN", "\ufe0e": "UNKNOWN", "\ufe0f": "UNKNOWN",
}
ZW = "".join(ZERO_WIDTH)
MIN_LOOKALIKES = 3
LOOKALIKE_SHARE = 0.3
ZERO_WIDTH_PER_1000 = 5
C0 = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
DEL = r"\x7F"
C1 = r"[\x{80}-\x{9F}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{80}-\x{9F}]"
CONTROL_PLACE = r"[\x00-\x08\x0B\x0E-\x1F\x7F\x{80}-\x{9F}]"

# Superset of all characters looked for here; a plain union of ranges is fast to search.
UNUSUAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{AD}\x{251}-\x{10FFFF}]"

PI_STRONG = (r"(?i)ignore\s+(?:all\s+)?previous\s+instructions?", r"(?i)disregard\s+(?:all\s+)?prior")
PI_ROLE = r"(?i)you\s+are\s+now\s+"
FREE_DOMAIN_URL = r"(?i)https?://[^\s]+\.(?:tk|ml|ga|cf|gq)/"

KEYS = ["bundle_id", "rel_path"]


def _occurrences(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def lookalike_stats(files: DataFrame) -> DataFrame:
    """Files with look-alike letters in mostly Latin text, with the first ten of them."""
    text = F.col("content")
    counted = files.where(text.rlike(UNUSUAL)).select(
        *KEYS, "content", _occurrences(text, LOOKALIKES).alias("n_suspect"), _occurrences(text, LATIN).alias("n_latin")
    ).withColumn("share", F.col("n_suspect") / F.greatest(F.col("n_latin") + F.col("n_suspect"), F.lit(1)))
    flagged = counted.where(
        (F.col("n_suspect") >= MIN_LOOKALIKES) & (F.col("n_latin") > 0) & (F.col("share") < LOOKALIKE_SHARE)
    )
    first = F.slice(F.regexp_extract_all("content", F.lit(f"[{LOOKALIKES}]"), 0), 1, 10)
    twins = dict(zip(LOOKALIKES, TWINS))
    shown = F.transform(
        first,
        lambda c: F.concat(
            F.lit("'"), c, F.lit("' (U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"), F.lit(") -> '"), lookup(twins, c), F.lit("'")
        ),
    )
    return flagged.select(*KEYS, "n_suspect", "n_latin", F.array_join(shown, ", ").alias("characters"), "content")


def zero_width_stats(files: DataFrame) -> DataFrame:
    text = F.col("content")
    threshold = F.greatest(F.floor(F.length(text) / 1000), F.lit(1)) * ZERO_WIDTH_PER_1000
    return (
        files.where(text.rlike(UNUSUAL)).select(*KEYS, "content", _occurrences(text, ZW).alias("n_zero_width"), threshold.cast("int").alias("threshold"))
        .where(F.col("n_zero_width") > F.col("threshold"))
    )


def zero_width_breakdown(files: DataFrame) -> DataFrame:
    """One row per flagged file and character; counted inside the row, no exchange."""
    per_char = F.array(*[
        F.struct(F.lit(f"U+{ord(c):04X}").alias("code"), F.lit(name).alias("name"),
                 _occurrences(F.col("content"), c).alias("n"))
        for c, name in ZERO_WIDTH.items()
    ])
    rows = zero_width_stats(files).select(*KEYS, F.explode(per_char).alias("c"))
    return rows.select(*KEYS, "c.*").where(F.col("n") > 0)


def control_stats(files: DataFrame) -> DataFrame:
    def count(pattern: str) -> Column:
        return F.regexp_count("content", F.lit(pattern))

    return files.where(F.col("content").rlike(UNUSUAL) & F.col("content").rlike(CONTROL)).select(
        *KEYS, count(C0).alias("n_c0"), count(DEL).alias("n_del"), count(C1).alias("n_c1"), "content"
    )


def first_place(content: Column, pattern: str) -> Column:
    """struct<line_no, snippet> of the first line that holds the pattern."""
    lines = T.physical_lines(content)
    found = F.filter(
        F.transform(lines, lambda s, i: F.struct((i + 1).alias("line_no"), s.alias("snippet"), s.rlike(pattern).alias("hit"))),
        lambda p: p["hit"],
    )
    return F.try_element_at(found, F.lit(1))


def _finding(rule_id: str, category: str, severity, line_no: Column, snippet: Column, detail: Column) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(category).alias("category"), severity.alias("severity"),
        line_no.cast("int").alias("line_no"), snippet.alias("snippet"), detail.alias("description"),
    )


def unicode_hits() -> Column:
    """array of findings for look-alike, zero-width and control characters."""
    text = F.col("content")
    # Most files end here, after one pass and before anything is counted.
    unusual = text.rlike(UNUSUAL)
    suspects, latin = _occurrences(text, LOOKALIKES), _occurrences(text, LATIN)
    zero_width = _occurrences(text, ZW)
    threshold = F.greatest(F.floor(F.length(text) / 1000), F.lit(1)) * ZERO_WIDTH_PER_1000

    def at(pattern: str, rule: str, severity: str, detail: Column) -> Column:
        return F.transform(
            F.array(first_place(text, pattern)),
            lambda p: _finding(rule, "Obfuscation", severity, p["line_no"], p["snippet"], detail),
        )

    lookalike = F.when(
        (suspects >= MIN_LOOKALIKES) & (latin > 0) & (suspects / (latin + suspects) < LOOKALIKE_SHARE),
        at(f"[{LOOKALIKES}]", "HOMOGLYPH_ATTACK", "High", F.concat(suspects.cast("string"), F.lit(" look-alike characters"))),
    )
    hidden = F.when(
        zero_width > threshold,
        at(f"[{ZW}]", "UNICODE_STEGANOGRAPHY", "Medium", F.concat(zero_width.cast("string"), F.lit(" zero-width characters"))),
    )
    control = F.when(
        text.rlike(CONTROL),
        at(CONTROL_PLACE, "UNICODE_INVISIBLE_CHARS", "Medium",
           F.concat(F.regexp_count(text, F.lit(CONTROL)).cast("string"), F.lit(" control characters"))),
    )
    parts = F.flatten(F.filter(F.array(lookalike, hidden, control), lambda a: a.isNotNull()))
    return F.when(~is_office_part(F.col("rel_path")) & unusual, parts)


def scan_unicode(files: DataFrame) -> DataFrame:
    return explode_hits(files.select(*KEYS, unicode_hits().alias("hits")), KEYS, "hits")


def asset_hits() -> Column:
    """Instruction overrides and free-domain links in asset files, line by line."""
    def test(line: Column, pattern: str) -> Column:
        return T.holds(F.lower(line), literal_need(pattern)) & T.matches(line, pattern)

    def of_line(s: Column, i: Column) -> Column:
        no = i + 1
        injection = F.when(
            T.any_of([test(s, p) for p in PI_STRONG]),
            _finding("ASSET_PROMPT_INJECTION", "PromptInjection", "High", no, s, F.lit("instruction override in asset file")),
        ).when(
            test(s, PI_ROLE),
            _finding("ASSET_PROMPT_INJECTION", "PromptInjection", "Medium", no, s, F.lit("role change in asset file")),
        )
        link = F.when(
            test(s, FREE_DOMAIN_URL),
            _finding("ASSET_SUSPICIOUS_URL", "SocialEngineering", "Medium", no, s, F.lit("free-domain link in asset file")),
        )
        return F.array(injection, link)

    folded = T.folded(F.col("content"))
    possible = T.any_of([T.holds(folded, literal_need(p)) for p in (*PI_STRONG, PI_ROLE, FREE_DOMAIN_URL)])
    hits = F.filter(F.flatten(F.transform(T.physical_lines(F.col("content")), of_line)), lambda h: h.isNotNull())
    return F.when(is_asset_path(F.col("rel_path")) & possible, hits)


def scan_assets(files: DataFrame) -> DataFrame:
    return explode_hits(files.select(*KEYS, asset_hits().alias("hits")), KEYS, "hits")


# Signatures (hex) in the order they are tried.
SIGNATURES = (
    ("pe", r"^4D5A"), ("elf", r"^7F454C46"), ("mach-o", r"^(?:FEEDFA..|CFFAEDFE)"), ("zip", r"^504B0304"),
    ("pdf", r"^25504446"), ("office", r"^D0CF11E0A1B11AE1"), ("gzip", r"^1F8B"), ("png", r"^89504E470D0A1A0A"),
    ("jpeg", r"^FFD8FF"), ("gif", r"^47494638(?:37|39)61"), ("tar", r"^(?:..){257}7573746172.."),
)
FOREIGN = ("pe", "elf", "mach-o", "zip", "pdf", "office", "gzip", "tar")
IMAGES = ("png", "jpeg", "gif")
TEXT_EXTS = (
    "py pyw pyi js jsx ts tsx mjs cjs sh bash zsh fish ps1 psm1 psd1 bat cmd rb pl lua r rs go java kt kts swift "
    "dart ex exs clj cljs hs elm v zig md json yaml yml toml cfg ini conf xml txt csv"
).split()
PHP_EXTS = ("php", "phtml")
IMAGE_EXTS = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "ico", "tiff", "avif")
EXPECTED = {
    "Python source": "py pyw pyi", "JavaScript source": "js jsx mjs cjs", "TypeScript source": "ts tsx",
    "Shell script": "sh bash zsh fish", "PowerShell script": "ps1 psm1 psd1", "Windows batch script": "bat cmd",
    "Markdown document": "md", "JSON data": "json", "YAML data": "yaml yml", "TOML data": "toml",
    "Configuration file": "cfg ini conf", "XML document": "xml", "Text file": "txt csv", "PNG image": "png",
    "JPEG image": "jpg jpeg", "GIF image": "gif", "WebP image": "webp", "Bitmap image": "bmp", "Icon file": "ico",
    "TIFF image": "tiff", "AVIF image": "avif",
}
SAMPLE_BYTES = 512


def with_content_type(blobs: DataFrame) -> DataFrame:
    """Add `detected`: the type by the leading bytes, signatures first, then text forms."""
    head = F.substring("bytes", 1, SAMPLE_BYTES)
    # As hex, only where a signature may stand: the leading bytes, and where a tar names itself.
    sampled = blobs.withColumns({
        "_code": F.hex(F.substring("bytes", 1, 8)), "_tar": F.hex(F.substring("bytes", 258, 6)), "_head": F.decode(head, "ISO-8859-1"),
    })
    text = F.lower("_head")
    size = F.length("_head")
    non_ascii = F.octet_length("_head") - size  # characters of ISO-8859-1 beyond ASCII take two bytes, all others one
    first_line = F.split("_head", "\n", 2)[0]
    svg_at = F.instr(text, "<svg")
    signature = F.lit(None).cast("string")
    for name, pattern in reversed(SIGNATURES):
        at = F.col("_tar" if name == "tar" else "_code")
        signature = F.when(at.rlike(pattern.replace("(?:..){257}", "")), name).otherwise(signature)
    form = (
        F.when((svg_at > 0) & F.substr(text, svg_at + 4, F.lit(1)).isin("", " ", "\t", "\n", "\r", ">", "/"), "svg")
        .when(text.rlike(r"^\s*(?:<!doctype html|<html)"), "html")
        .when(~F.startswith("_head", F.lit("#!")), "text")
        .when(F.contains(first_line, F.lit("python")), "python-script")
        .when(F.contains(first_line, F.lit("node")), "javascript").otherwise("shell-script")
    )
    is_text = (size > 0) & ~F.contains("_head", F.lit("\u0000")) & (non_ascii / size < 0.30)
    return (
        sampled.withColumn("_signature", signature)
        .withColumn("detected", F.coalesce("_signature", F.when(is_text, form), F.lit("unknown")))
        .drop("_code", "_tar", "_head", "_signature")
    )


def mismatch_severity(ext: Column, detected: Column) -> Column:
    return (
        F.when(ext.isin(*TEXT_EXTS) & detected.isin(*FOREIGN, *IMAGES), "Critical")
        .when(ext.isin(*TEXT_EXTS) & detected.isin("html", "svg"), "High")
        .when(ext.isin(*PHP_EXTS) & detected.isin(*FOREIGN, *IMAGES), "Critical")
        .when(
            ext.isin(*IMAGE_EXTS)
            & detected.isin(*FOREIGN, "shell-script", "python-script", "javascript", "html", "svg"), "High",
        )
    )


def expected_label(ext: Column) -> Column:
    table = {e: label for label, exts in EXPECTED.items() for e in exts.split()}
    return F.coalesce(lookup(table, ext), F.concat(ext, F.lit(" file")))


def type_mismatches(blobs: DataFrame) -> DataFrame:
    typed = with_content_type(blobs.where(F.col("ext") != "")).select(*KEYS, "ext", "detected")
    graded = F.struct(
        "ext", "detected", expected_label(F.col("ext")).alias("expected"),
        mismatch_severity(F.col("ext"), F.col("detected")).alias("severity"),
    )
    # As in explode_hits: a test on the exploded value stays above the detection.
    rows = typed.select(*KEYS, F.explode_outer(F.array(graded)).alias("m"))
    return rows.where(F.col("m.severity").isNotNull()).select(*KEYS, "m.*")
