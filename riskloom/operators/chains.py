"""Multi-step attack chains inside one file.

Each pattern yields the sorted line numbers it matches; a chain is a condition on
the distances between such numbers. All of it happens in the file's own row, so
there is no exchange and no window over exploded lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as T
from riskloom.functions.urls import EXEC_CONTEXT, targets_known_installer
from riskloom.operators.rule_scan import explode_hits
from riskloom.packs.loader import literal_need
from riskloom.packs.policy import DEFAULT_POLICY, Policy

# What counts as a download, an execution, a sensitive read and so on.
FETCH = r"(?i)\b(?:curl|wget|iwr|Invoke-WebRequest)\b"
PIPE_EXEC = r"(?i)\|\s*(?:bash|sh|zsh|ksh|dash|python[23]?|ruby|perl|node|pwsh|powershell|IEX)\b"
EXEC_COMMAND = r"(?i)\b(?:bash|sh|zsh|ksh|dash|python[23]?|ruby|perl|node|pwsh)\s+[^\s;|&]+"
EXEC_BARE = r"(?i)(?:^|[;&|]\s*)(?:\./|[a-zA-Z]:\\|~/|[^\s;|&]*\.(?:sh|bash|py|rb|pl|js|ts|ps1|bat|cmd))\b"
CHMOD_X = r"(?i)\bchmod\s+[+\-]x\b"
FETCH_URL = r"(?i)\b(?:curl|wget)\s+[^\n]*https?://"
FETCH_TO_FILE = r"(?i)\b(?:curl\s+-[oO]|wget\s+(?:-[oO]\s+|[^\s]*-[oO]))\s+\S+"
SENSITIVE_READ = (
    r"(?i)\b(?:cat|less|more|head|tail|type)\s+"
    r"(?:~?/\.ssh/(?:id_(?:rsa|dsa|ecdsa|ed25519)|known_hosts|authorized_keys|config)"
    r"|/etc/(?:passwd|shadow|sudoers)|~?/\.aws/(?:credentials|config)"
    r"|~?/\.gnupg/(?:.*\.gpg|private-keys-v1\.d)|~?/\.kube/config|~?/\.docker/config\.json"
    r"|~?/\.npmrc|~?/\.env(?:\.local|\.production|\.development)?|~?/\.netrc|\*\.pem|\*\.key|\.env(?:\.\w+)?)"
)
SENSITIVE_PATH = (
    r"(?i)(?:\.ssh/id_(?:rsa|dsa|ecdsa|ed25519)|/etc/(?:passwd|shadow)|\.aws/credentials|\.env(?:\.\w+)?|\.pem|\.key)"
)
SECRET_FILES = (
    r"(?:~?/\.ssh/id_(?:rsa|dsa|ecdsa|ed25519)|/etc/(?:passwd|shadow)|~?/\.aws/credentials|~?/\.env(?:\.\w+)?|\.env(?:\.\w+)?)"
)
READ_ENCODE_SEND = r"(?i)\b(?:cat|less|more|head|tail|type)\s+" + SECRET_FILES + r"[^|]*\|\s*base64\b[^\|]*\|\s*(?:curl|wget)\b"
READ_SEND = r"(?i)\b(?:cat|less|more|head|tail|type)\s+" + SECRET_FILES + r"[^|]*\|\s*(?:curl|wget)\b"
FIND_KEY_SEND = r"(?i)\bfind\b[^\n]*(?:\.key|\.pem|id_rsa|\.env)[^\n]*(?:curl|wget)\b"
BASE64 = r"(?i)\bbase64(?:\s+-[dwa]|(?:\s+--(?:decode|wrap|ignore-garbage)))?"
BASE64_DECODE = r"(?i)\bbase64\s+(?:-d|--decode)\b"
NET_SEND = (
    r"(?i)\b(?:curl\s+(?:-[X]\s*POST|--data|-d\b|--data-raw|--data-binary|--data-urlencode)|wget\s+--post-file"
    r"|curl\s+-F\b|curl\s+--form\b|Invoke-RestMethod\s+.*-Method\s+POST|iwr\s+.*-Method\s+POST)"
)
NET_OUT = r"(?i)\b(?:curl|wget)\b[^\n]*https?://[^\s]+"
FIND_EXEC = r"(?i)\bfind\b[^\n]*-exec\b"
FIND_XARGS = r"(?i)\bfind\b[^\n]*\|\s*xargs\s+(?:sh|bash|zsh)\b"
ENV_PRINT = r"(?i)\b(?:env|printenv)\b"
ENV_SECRET = r"(?i)\b(?:env|printenv)\s+(?:\w*(?:SECRET|TOKEN|KEY|PASSWORD|CRED|AUTH|API)\w*)"
ENV_SEND = r"(?i)\b(?:env|printenv)\b[^\n]*\|\s*(?:curl|wget)\b"
DOC_CONVERT = r"(?i)\b(?:pandoc|pdftotext|libreoffice|textutil)\b"
READ_CONVERTED = r"(?i)\b(?:cat|head|tail|less|more)\b.*\.(?:md|txt|html)"

# How many lines further down a later step may stand.
FETCH_EXEC_SPAN = 19
CHMOD_SPAN = 19
CHMOD_EXEC_SPAN = 9
EXFIL_SPAN = 29
FIND_SEND_SPAN = 14
ENV_SEND_SPAN = 14
DECODE_EXEC_SPAN = 14

RULES = {
    "PIPELINE_FETCH_EXECUTE": ("RemoteExec", "High"),
    "PIPELINE_DOWNLOAD_CHMOD_EXEC": ("RemoteExec", "High"),
    "PIPELINE_SENSITIVE_EXFIL": ("Network", "High"),
    "PIPELINE_FIND_EXEC": ("RemoteExec", "Medium"),
    "PIPELINE_ENV_HARVEST": ("Network", "Medium"),
    "PIPELINE_BASE64_EXEC": ("RemoteExec", "Medium"),
    "COMPOUND_LAUNDERING_CHAIN": ("CmdInjection", "High"),
}


def instruction_text() -> Column:
    """The text a chain is looked for in: scripts whole, main files without their front matter.

    Front matter is blanked line by line, so line numbers stay those of the file.
    """
    front = F.regexp_extract("content", r"(?s)^\s*---.*?\n---", 0)
    body = F.concat(F.regexp_replace(front, r"[^\n]", ""), F.substr("content", F.length(front) + 1))
    return T.unix_breaks(F.when(F.col("is_main"), body).otherwise(F.col("content")))


def targets(files: DataFrame) -> DataFrame:
    """Main-file bodies and text scripts outside documentation paths."""
    is_script = (F.col("file_type") == "script") & ~F.col("is_binary") & ~F.col("is_doc_path")
    return (
        files.where(F.col("is_main") | is_script)
        .withColumn("content", instruction_text())
        .withColumn("lines", T.physical_lines(F.col("content")))
        .withColumn("folded", T.folded(F.col("content")))
    )


def _has(*literals: str) -> Column:
    return T.contains_any(F.col("folded"), literals)


FETCHERS = ("curl", "wget", "iwr", "invoke-webrequest")
SENDERS = ("curl", "wget", "iwr", "invoke-restmethod")

def _match(s: Column, f: Column, *patterns: str) -> Column:
    """The line s, folded f, matches one of the patterns; each is tried only on a line that holds what its match cannot lack."""
    needs = [literal_need(p) for p in patterns]
    return T.any_of([(T.holds(f, n) & T.matches(s, p)) if n else T.matches(s, p) for n, p in zip(needs, patterns)])


def _named(s: Column, f: Column, name: str) -> Column:
    """The line holds the name in whatever ASCII case: first looked for in the folded line, which holds it then as well."""
    return F.contains(f, F.lit(name)) & F.contains(F.lower(s), F.lit(name))


# Line numbers each step matches: literals the text must hold, then the test of one line and the same line folded.
POSITIONS = {
    "p_fetch_pipe": (FETCHERS, lambda s, f: _match(s, f, FETCH) & T.matches(s, PIPE_EXEC)),
    "p_fetch_file": (FETCHERS, lambda s, f: _match(s, f, FETCH) & T.matches(s, FETCH_TO_FILE)),
    "p_fetch": (FETCHERS, lambda s, f: _match(s, f, FETCH) & T.matches_any(s, (FETCH_TO_FILE, FETCH_URL))),
    "p_run": (FETCHERS, lambda s, f: _match(s, f, EXEC_COMMAND, PIPE_EXEC, EXEC_BARE)),
    "p_chmod": (("chmod",), lambda s, f: _match(s, f, CHMOD_X)),
    "p_read": (SENDERS, lambda s, f: _match(s, f, SENSITIVE_READ)),
    "p_send": (SENDERS, lambda s, f: _match(s, f, NET_SEND, NET_OUT)),
    "p_encode": (("base64",), lambda s, f: _match(s, f, BASE64)),
    "p_find": (("find",), lambda s, f: _named(s, f, "find") & T.matches(s, SENSITIVE_PATH)),
    "p_upload": (("curl",), lambda s, f: _named(s, f, "curl") & T.matches_any(s, (NET_SEND, NET_OUT))),
    "p_env": (("env",), lambda s, f: _match(s, f, ENV_PRINT, ENV_SECRET)),
    "p_secret_env": (("env",), lambda s, f: _match(s, f, ENV_SECRET)),
    "p_decode": (("base64",), lambda s, f: _match(s, f, BASE64_DECODE)),
    "p_decode_pipe": (("base64",), lambda s, f: _match(s, f, BASE64_DECODE) & T.matches(s, PIPE_EXEC)),
    "p_command": (("base64",), lambda s, f: _match(s, f, EXEC_COMMAND)),
    "p_pandoc": (("pandoc",), lambda s, f: _named(s, f, "pandoc")),
    "p_pdftotext": (("pdftotext",), lambda s, f: _named(s, f, "pdftotext")),
}
POSITIONS_OF = {
    "PIPELINE_FETCH_EXECUTE": ("p_fetch_pipe", "p_fetch_file", "p_run"),
    "PIPELINE_DOWNLOAD_CHMOD_EXEC": ("p_fetch", "p_chmod", "p_run"),
    "PIPELINE_SENSITIVE_EXFIL": ("p_read", "p_send", "p_encode", "p_find", "p_upload"),
    "PIPELINE_FIND_EXEC": (),
    "PIPELINE_ENV_HARVEST": ("p_env", "p_secret_env", "p_send"),
    "PIPELINE_BASE64_EXEC": ("p_decode", "p_decode_pipe", "p_command"),
    "COMPOUND_LAUNDERING_CHAIN": ("p_pandoc", "p_pdftotext"),
}


#: Costly steps that chains read only beside others: one of these sets of steps must have been found, else the step has no lines.
ANCHORS = {"p_run": (("p_fetch_file",), ("p_fetch", "p_chmod")), "p_command": (("p_decode",),)}


def with_positions(rows: DataFrame, rule_ids) -> DataFrame:
    """Two projections hold all position lists, so later steps never test a line again; the second one those of ANCHORS."""
    names = sorted({n for r in rule_ids for n in POSITIONS_OF[r]})
    empty = F.array().cast("array<int>")

    def positions(name: str) -> Column:
        literals, test = POSITIONS[name]
        beside = [T.all_of([F.size(n) > 0 for n in found]) for found in ANCHORS.get(name, ()) if set(found) <= set(names)]
        at = F.transform(F.col("lines"), lambda s, i: F.when(test(s, F.get("folded_lines", i)), i + 1))
        numbers = F.filter(at, lambda i: i.isNotNull())
        return F.when(T.all_of([_has(*literals), *[T.any_of(beside)] * bool(beside)]), numbers).otherwise(empty)

    # Folding moves no line break, so the folded text's lines are the folded lines.
    rows = rows.withColumn("folded_lines", F.when(_has(*sorted({w for n in names for w in POSITIONS[n][0]})), F.split("folded", "\n")))
    for step in ([n for n in names if n not in ANCHORS], [n for n in names if n in ANCHORS]):
        rows = rows.withColumns({n: positions(n) for n in step}) if step else rows
    return rows


def _found(*names: str) -> Column:
    """All these steps occur. Also keeps the lists apart from the lambdas that read them."""
    return T.all_of([F.size(n) > 0 for n in names])


def _within(positions: Column, later: Column, span: int) -> Column:
    """Those positions that one of the later ones follows by at most span lines.

    By set operations over line numbers, so a generated script of very many lines costs no more than its lines.
    """
    reached = F.flatten(F.transform(later, lambda p: F.sequence(p - span, p - 1)))
    return F.array_intersect(positions, reached)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once and not anew in each lambda of the body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _place(variant: str, line: Column, end: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.when(
        line.isNotNull(),
        F.struct(
            F.lit(variant).alias("variant"), line.cast("int").alias("line_no"),
            (end.cast("int") if end is not None else none).alias("end_line"),
        ),
    )


def fetch_execute() -> Column:
    same, saved, runs = F.col("p_fetch_pipe"), F.col("p_fetch_file"), F.col("p_run")
    later = _let(
        F.array_min(_within(saved, runs, FETCH_EXEC_SPAN)),
        lambda i: _place("save_then_run", i, T.first_between(runs, i + 1, i + FETCH_EXEC_SPAN)),
    )
    return (
        F.when(_found("p_fetch_pipe"), _place("same_line", same[0], same[0]))
        .when(_found("p_fetch_file", "p_run"), later)
    )


def download_chmod_exec() -> Column:
    fetched, chmods, runs = F.col("p_fetch"), F.col("p_chmod"), F.col("p_run")

    def place(armed: Column) -> Column:
        start = F.array_min(_within(fetched, armed, CHMOD_SPAN))
        return _let(start, lambda i: _let(
            T.first_between(armed, i + 1, i + CHMOD_SPAN),
            lambda c: _place("chmod", i, T.first_between(runs, c + 1, c + CHMOD_EXEC_SPAN)),
        ))

    return F.when(_found("p_fetch", "p_chmod", "p_run"), _let(_within(chmods, runs, CHMOD_EXEC_SPAN), place))


def _content_place(variant: str, pattern: str) -> Column:
    need = literal_need(pattern)
    possible = T.holds(F.col("folded"), need) if need else F.lit(True)
    line = F.when(possible & T.matches(F.col("content"), pattern), T.line_of_first(F.col("content"), pattern))
    return _place(variant, line)


def sensitive_exfil() -> Column:
    reads, sends, encodes = F.col("p_read"), F.col("p_send"), F.col("p_encode")
    finds, uploads = F.col("p_find"), F.col("p_upload")

    def sent(variant: str, also_encoded: bool) -> Column:
        def place(i: Column) -> Column:
            line = F.when(T.any_between(encodes, i + 1, i + EXFIL_SPAN), i) if also_encoded else i
            return _place(variant, line, T.last_between(sends, i + 1, i + EXFIL_SPAN))

        return _let(F.array_min(_within(reads, sends, EXFIL_SPAN)), place)

    uploaded = _let(
        F.array_min(_within(finds, uploads, FIND_SEND_SPAN)),
        lambda i: _place("find_send_later", i, T.first_between(uploads, i + 1, i + FIND_SEND_SPAN)),
    )
    return F.when(
        _has(*SENDERS),
        F.coalesce(
            _content_place("read_encode_send", READ_ENCODE_SEND),
            _content_place("read_send", READ_SEND),
            _content_place("find_send", FIND_KEY_SEND),
            F.when(_found("p_read", "p_send", "p_encode"), sent("encode_later", True)),
            F.when(_found("p_read", "p_send"), sent("send_later", False)),
            F.when(_found("p_find", "p_upload"), uploaded),
        ),
    )


def find_exec() -> Column:
    return F.when(
        _has("find"), F.coalesce(_content_place("exec", FIND_EXEC), _content_place("xargs", FIND_XARGS))
    )


def env_harvest() -> Column:
    prints, secrets, sends = F.col("p_env"), F.col("p_secret_env"), F.col("p_send")
    starts = F.concat(_within(prints, sends, ENV_SEND_SPAN), F.array_intersect(prints, secrets))

    def place(i: Column) -> Column:
        return _let(
            T.first_between(sends, i + 1, i + ENV_SEND_SPAN),
            lambda sent: F.coalesce(_place("send_later", F.when(sent.isNotNull(), i), sent), _place("secret_only", i)),
        )

    later = _let(F.array_min(starts), place)
    possible = _found("p_env") & (_found("p_send") | _found("p_secret_env"))
    return F.when(_has("env"), F.coalesce(_content_place("same_line", ENV_SEND), F.when(possible, later)))


def base64_exec() -> Column:
    decodes, piped, runs = F.col("p_decode"), F.col("p_decode_pipe"), F.col("p_command")
    starts = F.concat(F.array_intersect(decodes, piped), _within(decodes, runs, DECODE_EXEC_SPAN))
    found = _let(F.array_min(starts), lambda i: F.coalesce(
        _place("same_line", F.when(F.array_contains(piped, i), i), i),
        _place("run_later", i, T.first_between(runs, i + 1, i + DECODE_EXEC_SPAN)),
    ))
    return F.when(_found("p_decode") & (_found("p_decode_pipe") | _found("p_command")), found)


def laundering() -> Column:
    """Conversion and read may stand anywhere in the text; the line is the converter's, if it is a known one."""
    named = F.coalesce(F.get("p_pandoc", F.lit(0)), F.get("p_pdftotext", F.lit(0)))
    both = T.matches(F.col("content"), DOC_CONVERT) & T.matches(F.col("content"), READ_CONVERTED)
    none = F.lit(None).cast("int")
    return F.when(
        _has("pandoc", "pdftotext", "libreoffice", "textutil") & both,
        F.struct(F.lit("convert_read").alias("variant"), named.cast("int").alias("line_no"), none.alias("end_line")),
    )


DETECTORS = {
    "PIPELINE_FETCH_EXECUTE": fetch_execute,
    "PIPELINE_DOWNLOAD_CHMOD_EXEC": download_chmod_exec,
    "PIPELINE_SENSITIVE_EXFIL": sensitive_exfil,
    "PIPELINE_FIND_EXEC": find_exec,
    "PIPELINE_ENV_HARVEST": env_harvest,
    "PIPELINE_BASE64_EXEC": base64_exec,
    "COMPOUND_LAUNDERING_CHAIN": laundering,
}
INSTALLER_RULES = ("PIPELINE_FETCH_EXECUTE", "PIPELINE_DOWNLOAD_CHMOD_EXEC")


def installer_downgrade(download: Column, execution: Column, policy: Policy) -> Column:
    """Allow-listed host on the download line itself, and neither line is run by code."""
    return F.coalesce(
        targets_known_installer(download, policy)
        & ~T.matches(download, EXEC_CONTEXT)
        & ~T.matches(F.coalesce(execution, F.lit("")), EXEC_CONTEXT),
        F.lit(False),
    )


def chain_hit(rule_id: str, policy: Policy = DEFAULT_POLICY) -> Column:
    category, severity = RULES[rule_id]
    place = DETECTORS[rule_id]()

    def graded(p: Column) -> Column:
        level = F.lit(severity)
        if rule_id in INSTALLER_RULES:
            # Line lookups stay inside the chosen branch: they run for files with a hit only.
            download = T.line_text(F.col("lines"), p["line_no"])
            execution = T.line_text(F.col("lines"), p["end_line"])
            level = F.when(installer_downgrade(download, execution, policy), "Medium").otherwise(severity)
        return F.struct(
            F.lit(rule_id).alias("rule_id"), F.lit(category).alias("category"), level.alias("severity"),
            p["variant"].alias("variant"), p["line_no"].alias("line_no"), p["end_line"].alias("end_line"),
            T.line_text(F.col("lines"), p["line_no"]).alias("snippet"),
        )

    # A one-element array lets the place be computed once and used many times.
    return F.transform(F.filter(F.array(place), lambda p: p.isNotNull()), graded)


KEYS = ["bundle_id", "rel_path", "ext", "is_main"]


def scan_chains(files: DataFrame, rule_ids=tuple(RULES), policy: Policy = DEFAULT_POLICY) -> DataFrame:
    hits = F.concat(*[chain_hit(r, policy) for r in rule_ids])
    rows = with_positions(targets(files), rule_ids)
    return explode_hits(rows.select(*KEYS, hits.alias("hits")), KEYS, "hits")
