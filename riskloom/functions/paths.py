"""Path and file-class columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.sqltext import listed
from riskloom.functions.text import any_of, matches
from riskloom.packs.policy import Policy

# File class by extension.
FILE_CLASSES = {
    "markdown": "md markdown mdx",
    "script": "sh bash zsh fish ps1 bat cmd py pyw rb pl php js mjs cjs jsx ts mts cts tsx lua r rs go java "
              "kt kts swift dart ex exs clj cljs hs elm v zig",
    "config": "json json5 jsonc yaml yml toml ini cfg conf env properties xml xsd xsl xslt gitignore "
              "gitattributes editorconfig prettierrc eslintrc stylelintrc dockerignore npmrc nvmrc",
    "asset": "png jpg jpeg gif webp avif bmp ico icns tif tiff heic heif svg ttf otf woff woff2 eot mp3 mp4 "
             "wav ogg webm flac aac pdf doc docx xls xlsx ppt pptx zip gz tar rar 7z bz2 xz pyc pyo class o so "
             "dll dylib exe msi dmg",
    "binary": "bin dat db sqlite sqlite3 wasm jar war ear",
}
CLASS_OF_EXT = {ext: name for name, exts in FILE_CLASSES.items() for ext in exts.split()}

# Families of paths and the tool or package manager they belong to.
HOME = r"(?:^~|^[A-Za-z]:/Users/[^/]+|^/Users/[^/]+|^/home/[^/]+|^/root)"
TOOL_DIRS = (
    ("agents", r"/\.agents/skills(?:/|$)"),
    ("claude-code", r"/\.claude/skills(?:/|$)"),
    ("codex", r"/\.codex/skills(?:/|$)"),
    ("antigravity", r"/\.gemini/antigravity/skills(?:/|$)"),
    ("opencode", r"/\.config/opencode/skills(?:/|$)"),
)
MANAGER_DIRS = (
    ("pnpm", ("/appdata/local/pnpm/bin/", "/appdata/local/pnpm/", "/appdata/roaming/pnpm/", "/library/pnpm/bin/",
              "/.local/share/pnpm/bin/", "/.pnpm-global/bin/")),
    ("npm", ("/appdata/roaming/npm/", "/.npm-global/bin/", "/npm/bin/")),
    ("brew", ("/opt/homebrew/", "/usr/local/cellar/", "/homebrew/cellar/")),
    ("scoop", ("/scoop/shims/", "/scoop/apps/")),
    ("choco", ("/chocolatey/bin/", "/choco/bin/")),
)
ASSET_DIRS = r"(?:assets|templates|references|data)/"
OFFICE_PARTS = (">word/", ">xl/", ">ppt/", ">[content_types].xml", ">_rels/")


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def segments(path: Column) -> Column:
    return F.split(slashes(path), "/")


def file_name(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; '' for none and for dot files."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def file_class(ext: Column) -> Column:
    table = F.expr(f"map({listed(chain.from_iterable(CLASS_OF_EXT.items()))})")
    return F.coalesce(F.element_at(table, ext), F.lit("unknown"))


def is_hidden(path: Column) -> Column:
    return F.exists(segments(path), lambda s: s.startswith("."))


def is_main_file(path: Column) -> Column:
    return F.lower(file_name(path)) == "skill.md"


def is_readme(path: Column) -> Column:
    name = F.lower(file_name(path))
    return (name == "readme.md") | (name.startswith("readme.") & name.endswith(".md"))


def is_markdown(path: Column) -> Column:
    return extension(path).isin("md", "markdown", "mdx") | is_main_file(path)


def is_doc_path(path: Column, policy: Policy) -> Column:
    parts = segments(F.lower(path))
    indicators = list(policy.doc_path_indicators)
    return F.exists(
        parts,
        lambda s: ((F.size(parts) >= 2) & s.isin(indicators)) | s.rlike("^(?:" + "|".join(indicators) + ")-"),
    )


def in_skipped_dir(path: Column, policy: Policy, keep_bytecode_dirs: bool = False) -> Column:
    names = [d for d in policy.skip_dirs if not (keep_bytecode_dirs and d == "__pycache__")]
    parts = segments(path)
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(parents, F.array(*[F.lit(n) for n in names]))


def is_asset_path(path: Column) -> Column:
    return matches(F.lower(slashes(path)), ASSET_DIRS)


def is_office_part(path: Column) -> Column:
    lower = F.lower(slashes(path))
    return any_of([F.contains(lower, F.lit(p)) for p in OFFICE_PARTS])


def parent_path(path: Column) -> Column:
    """Directory of a path; '.' at the root of the tree."""
    head = F.regexp_extract(slashes(path), r"^(.*)/[^/]*$", 1)
    return F.when(head == "", F.lit(".")).otherwise(head)


def clean_windows_path(path: Column) -> Column:
    p = slashes(path)
    return (
        F.when(p.startswith("//?/UNC/"), F.concat(F.lit("//"), F.substr(p, F.lit(len("//?/UNC/") + 1))))
        .when(p.rlike(r"^//\?/[A-Za-z]:/"), F.substr(p, F.lit(5)))
        .otherwise(p)
    )


def tool_of_path(path: Column) -> Column:
    p = clean_windows_path(path)
    found = F.lit(None).cast("string")
    for tool, tail in reversed(TOOL_DIRS):
        found = F.when(p.rlike(HOME + tail), F.lit(tool)).otherwise(found)
    return found


def manager_of_path(path: Column) -> Column:
    s = F.lower(slashes(path))

    def has(part: str) -> Column:
        return F.contains(s, F.lit(part))

    tests = {name: any_of([has(p) for p in parts]) for name, parts in MANAGER_DIRS}
    tests["npm"] = tests["npm"] | (has("/node_modules/.bin/") & ~has("/local/"))
    pip = (has("/scripts/") & (has("python") | has("/py"))) | has("/site-packages/")
    found = F.when(tests["pnpm"], F.lit("pnpm"))
    for name in ("npm", "brew", "scoop", "choco"):
        found = found.when(tests[name], F.lit(name))
    return found.when(pip, F.lit("pip")).otherwise(F.lit("unknown"))
