"""Second rule pack: injection, exfiltration, obfuscation and resource abuse.

Fixed values, as in the core pack.
"""

from riskloom.packs.model import Rule

SH = (".sh", ".bash")
CODE = (".py", ".sh", ".md", ".js", ".ts")

RULES = (
    Rule("PATH_TRAVERSAL_OPEN", "CmdInjection", "Critical", 90, "High", "CWE-22",
         (r"os\.path\.join\s*\([^)]+,\s*\w+\s*\).*\n.*open\s*\(",
          r"""path\s*=\s*f["'][^"']*\{[^}]+\}[^"']*["']\s*\n.*open\s*\(path""",
          r"""open\s*\(\s*f["']/[^"']*\{[^}]+\}""",
          r"return\s+open\s*\(\s*path\s*\)"),
         (r"""\.json["']""", r"""\.yaml["']""", r"""\.yml["']""", r"""\.txt["']""", r"test_", r"_test\."),
         (".py",), True),
    Rule("SQL_INJECTION_STRING_FORMAT", "CmdInjection", "Critical", 90, "High", "CWE-89",
         (r"""f["']SELECT.*WHERE.*\{[^}]+\}""",
          r"""f["'].*LIKE.*\{[^}]+\}""",
          r"""["']SELECT.*FROM.*["']\s*\+\s*\w+"""),
         (r"%s", r"\?", r"LIMIT\s+\{", r"^\s*#", r"example"), (".py",), True),
    Rule("COMMAND_INJECTION_USER_INPUT", "CmdInjection", "High", 70, "High", "CWE-78",
         (r"""eval\s+["']?\$[0-9@*]""", r"""eval\s+["']?\$\{[0-9@*]"""),
         (r"example", r"test", r"#.*eval"), SH),
    Rule("COMMAND_INJECTION_JS_FUNCTION_CONSTRUCTOR", "CmdInjection", "Critical", 85, "High", "CWE-94",
         (r"new\s+Function\s*\(",
          r"""(?:^|[^.])Function\s*\(\s*['"]""",
          r"""\bsetTimeout\s*\(\s*['"]""",
          r"""\bsetInterval\s*\(\s*['"]"""),
         (r"(?i)never\s+use\s+Function",), (".js", ".ts", ".mjs", ".cjs"), True),
    Rule("SVG_EMBEDDED_SCRIPT", "CmdInjection", "Critical", 85, "High", "CWE-79",
         (r"<script[^>]*>[^<]*</script>",
          r"""\bon\w+\s*=\s*["'][^"']*["']""",
          r"javascript\s*:"),
         file_types=(".svg",), hard_trigger=True),
    Rule("PDF_EMBEDDED_JAVASCRIPT", "CmdInjection", "Critical", 85, "High", "CWE-79",
         (r"/JS\s*\(", r"/JavaScript\s", r"/OpenAction\s", r"/AA\s*<<", r"/Launch\s"),
         file_types=(".pdf",), hard_trigger=True),
    Rule("GLOB_HIDDEN_FILE_TARGETING", "SensitiveFileAccess", "Medium", 25, "Medium", "CWE-200",
         (r"glob\s*\([^)]*\.\*",
          r"""find\s+[^|]*\s+-name\s+["']?\.\*""",
          r"for\s+\w+\s+in\s+\.\*\s*;"),
         file_types=SH + (".py", ".md")),
    Rule("FIND_EXEC_PATTERN", "CmdInjection", "High", 65, "High", "CWE-78",
         (r"find\s+[^|;]*-exec\s+(?:bash|sh|zsh|python[23]?|perl|ruby|node|curl|wget|rm|chmod|chown|eval)",
          r"find\s+[^|;]*\|\s*xargs\s+(?:bash|sh|zsh|eval|exec)"),
         file_types=SH + (".md",)),
    Rule("SECRET_STRIPE_KEY", "Secrets", "Critical", 90, "High", "CWE-798",
         (r"(?:sk|pk)_(?:live|test)_[A-Za-z0-9]{24,}",
          r"""(?:sk|pk)_(?:live|test)_["']\s*\+\s*["'][A-Za-z0-9]{24,}"""),
         file_types=CODE, hard_trigger=True),
    Rule("SECRET_GOOGLE_API", "Secrets", "Critical", 90, "High", "CWE-798",
         (r"AIza[A-Za-z0-9_-]{35}",), file_types=CODE, hard_trigger=True),
    Rule("DATA_EXFIL_SOCKET_CONNECT", "Network", "Critical", 80, "High", "CWE-200",
         (r"socket\.socket\s*\([^)]*\)\.connect", r"socket\.create_connection"),
         (r"localhost", r"127\.0\.0\.1", r"0\.0\.0\.0", r"::1"), (".py",), True),
    Rule("DATA_EXFIL_JS_NETWORK", "Network", "Medium", 30, "Medium", "CWE-200",
         (r"\bfetch\s*\(", r"\baxios\.(?:get|post|put|delete|patch|request)\s*\("),
         (r"(?i)example", r"(?i)mock", r"(?i)test", r"(?i)developers\.openai\.com"), (".js", ".ts")),
    Rule("DATA_EXFIL_JS_FS_ACCESS", "SensitiveFileAccess", "High", 55, "High", "CWE-200",
         (r"fs\.(?:readFile|readFileSync|createReadStream)\s*\(",
          r"fs\.(?:writeFile|writeFileSync|createWriteStream)\s*\("),
         (r"(?i)example", r"(?i)mock"), (".js", ".ts")),
    Rule("DATA_EXFIL_BASE64_AND_NETWORK", "Network", "High", 60, "High", "CWE-200",
         (r"base64\.(?:b64encode|encodebytes)[^\n]{0,160}(?:requests\.|urllib\.request|httpx\.|socket\.)",
          r"(?:requests\.|urllib\.request|httpx\.|socket\.)[^\n]{0,160}base64\.(?:b64encode|encodebytes)"),
         file_types=(".py",)),
    Rule("OBFUSCATION_HEX_BLOB", "Obfuscation", "Medium", 35, "Medium", "CWE-656",
         (r"(?:0x[0-9a-fA-F]{2}\s*){32,}",)),
    Rule("OBFUSCATION_XOR_ENCODING", "Obfuscation", "Medium", 35, "Medium", "CWE-656",
         (r"chr\s*\(\s*ord\s*\([^)]+\)\s*\^",), file_types=(".py",)),
    Rule("RESOURCE_ABUSE_INFINITE_LOOP", "Obfuscation", "Medium", 20, "Medium", "CWE-400",
         (r"while\s+True\s*:", r"while\s+1\s*:"), file_types=(".py",)),
    Rule("RESOURCE_ABUSE_FORK_BOMB", "Destructive", "High", 75, "High", "CWE-400",
         (r":\(\)\s*\{\s*:\|\:&\s*\}\s*;\s*:",), file_types=SH, hard_trigger=True),
    Rule("SOCIAL_ENG_ANTHROPIC_IMPERSONATION", "SocialEngineering", "Medium", 40, "Medium", "CWE-451",
         (r"(?i)official\s+anthropic", r"(?i)anthropic\s+official", r"(?i)created\s+by\s+anthropic\s+team"),
         file_types=(".md",)),
    Rule("TOOL_ABUSE_SYSTEM_PACKAGE_INSTALL", "PolicyViolation", "High", 60, "High", "CWE-494",
         (r"(?i)\b(?:apt-get|apt|yum|dnf|brew)\s+install\b",
          r"(?i)\bpip\s+install\b",
          r"(?i)\bnpm\s+install\s+-g\b"),
         (r"(?i)\buv\s+pip\s+install\b", r"(?i)`[^`]*pip\s+install[^`]*`", r"(?i)install it with"),
         SH + (".py", ".md")),
    Rule("TOOL_ABUSE_UNTRUSTED_PACKAGE_SOURCE", "PolicyViolation", "High", 65, "High", "CWE-494",
         (r"pip\s+install\s+git\+https?://", r"pip\s+install\s+.*--index-url\s+https?://"),
         file_types=(".sh", ".py")),
    Rule("HIDDEN_FILE_WITH_CODE", "PolicyViolation", "High", 70, "High", "CWE-494",
         (r"os\.system\s*\(", r"subprocess\.(?:run|call|Popen)"), file_types=(".py", ".sh")),
    Rule("RESOURCE_ABUSE_LARGE_ALLOCATION", "PolicyViolation", "High", 60, "Medium", "CWE-400",
         (r"\[\s*0\s*\]\s*\*\s*10\s*\*\*\s*[6-9]",
          r"malloc\s*\(\s*[\d_]{7,}",
          r"bytearray\s*\(\s*[\d_]{7,}",
          r"calloc\s*\(\s*[\d_]{7,}"),
         (r"example", r"test"), (".py", ".js", ".ts", ".sh")),
    Rule("TOOL_ABUSE_SYSTEM_MODIFICATION", "PolicyViolation", "Critical", 85, "High", "CWE-276",
         (r"chmod\s+[0-7]*[2-7][0-7]*\s+/etc",
          r"chmod\s+[0-7]*[2-7][0-7]*\s+/usr",
          r"chmod\s+[0-7]*[2-7][0-7]*\s+/var",
          r"chown\s+\w+\s+/(?:etc|usr|var)",
          r"install\s+-m\s+[0-7]*[2-7][0-7]*\s+.*\s/(?:etc|usr)"),
         (r"example", r"test"), SH + (".py", ".md"), True),
    Rule("OBFUSCATION_BASE64_LARGE", "Obfuscation", "Medium", 35, "Medium", "CWE-656",
         (r"[A-Za-z0-9+/]{200,}={0,2}",), (r"example", r"test", r"mock")),
    Rule("SOCIAL_ENG_VAGUE_DESCRIPTION", "SocialEngineering", "Low", 15, "Low", "CWE-451",
         (r"(?i)\b(?:tool|utility|helper|assistant|service|agent)\b.*\b(?:tool|utility|helper|assistant|service|agent)\b",),
         (r"example",), (".md",)),
)
