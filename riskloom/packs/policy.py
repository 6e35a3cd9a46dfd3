"""Scan policy: limits, path classes and overrides used by the operators.

Fixed values: the defaults decide which files are in scope and how hits are graded.
"""

from __future__ import annotations

from dataclasses import dataclass

from riskloom.packs.model import Rule

SKIP_DIRS = (
    ".git", "node_modules", "target", "dist", "build", "__pycache__",
    ".venv", "venv", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox",
)
HOUSEKEEPING_FILES = (".ds_store", "thumbs.db", "desktop.ini")
INERT_EXTENSIONS = (
    "ttf", "otf", "woff", "woff2", "eot", "png", "jpg", "jpeg", "gif", "webp", "avif", "bmp",
    "ico", "icns", "tif", "tiff", "heic", "heif", "pyc", "pyo", "db", "sqlite", "sqlite3",
)
DOC_PATH_INDICATORS = (
    "doc", "docs", "references", "examples", "tutorials", "guides",
    "test", "tests", "fixtures", "samples", "demo", "skills",
)
SKIP_IN_DOCS = ("CURL_POST", "PY_EVAL", "TOOL_ABUSE_SYSTEM_PACKAGE_INSTALL")
KNOWN_INSTALLER_DOMAINS = (
    "sh.rustup.rs", "astral.sh", "bun.sh", "get.pnpm.io", "nodejs.org", "pip.pypa.io", "brew.sh",
    "curl.se", "git-scm.com", "go.dev", "rustup.rs", "install.python-poetry.org", "rye.astral.sh",
    "mise.jdx.dev",
)
ALLOWED_EXTENSIONS = (
    ".md", ".py", ".sh", ".json", ".yaml", ".yml", ".txt", ".js", ".ts", ".html", ".css", ".svg",
    ".xml", ".xsd", ".toml", ".cfg", ".ini", ".env", ".gitignore", ".gitattributes", ".editorconfig",
    ".prettierrc", ".eslintrc",
)
ALLOWED_SUBDIRS = ("scripts", "references", "assets", "templates", "data", "config", "src", "lib")


@dataclass(frozen=True)
class Policy:
    name: str = "default"
    version: str = "1.0"
    #: Rules in place of the built-in packs; none means those.
    rules: tuple[Rule, ...] = ()
    disabled_rules: tuple[str, ...] = ()
    severity_overrides: tuple[tuple[str, str], ...] = ()
    hard_trigger_overrides: tuple[tuple[str, bool], ...] = (
        ("COMMAND_INJECTION_JS_FUNCTION_CONSTRUCTOR", False),
        ("SVG_EMBEDDED_SCRIPT", False),
        ("PDF_EMBEDDED_JAVASCRIPT", False),
    )
    score_kinds: tuple[str, ...] = ("Security", "Auditability")
    strict_structure: bool = False
    max_files: int = 2000
    max_depth: int = 20
    max_scan_bytes: int = 2 * 1024 * 1024
    skip_dirs: tuple[str, ...] = SKIP_DIRS
    housekeeping_files: tuple[str, ...] = HOUSEKEEPING_FILES
    inert_extensions: tuple[str, ...] = INERT_EXTENSIONS
    doc_path_indicators: tuple[str, ...] = DOC_PATH_INDICATORS
    skip_in_docs: tuple[str, ...] = SKIP_IN_DOCS
    known_installer_domains: tuple[str, ...] = KNOWN_INSTALLER_DOMAINS
    allowed_extensions: tuple[str, ...] = ALLOWED_EXTENSIONS
    allowed_subdirs: tuple[str, ...] = ALLOWED_SUBDIRS


DEFAULT_POLICY = Policy()
