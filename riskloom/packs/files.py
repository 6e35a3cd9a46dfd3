"""Rule packs and scan policies from files, and what a scan's results depend on.

A file is JSON, or YAML where PyYAML is installed, below any path that Spark reads. It is checked whole before a job
starts: every fault is one PackError that names the file, the place in it and what is wrong. What a policy file leaves
out has the default; a pack's fields have the defaults of PACK_DEFAULTS.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from typing import Any

from pyspark.sql import SparkSession

from riskloom.packs.loader import PackError, builtin_rules, load_packs, rules_of
from riskloom.packs.model import Rule
from riskloom.packs.policy import DEFAULT_POLICY, Policy

# Names of fields and what they may hold.
SEVERITIES = ("Critical", "High", "Medium", "Low", "Info")
CONFIDENCES = ("High", "Medium", "Low")
CATEGORIES = (
    "Destructive", "RemoteExec", "CmdInjection", "Network", "PrivilegeEscalation", "Secrets", "Persistence",
    "SensitiveFileAccess", "PromptInjection", "SocialEngineering", "PolicyViolation", "Obfuscation",
)
KINDS = ("Security", "Auditability", "Structure")
PACK_DEFAULTS = {
    "weight": 0, "confidence": "Medium", "hard_trigger": False, "exclude_patterns": [], "file_types": [], "suppress_if_matched": [],
    "remediation": "", "cwe_id": None, "metadata": None,
}
PACK_REQUIRED = ("id", "category", "severity", "patterns", "description")
#: Place in a policy file, kind, field of Policy (none: known, and without effect on a scan).
POLICY_FIELDS = {
    "policy_name": (str, "name"), "policy_version": (str, "version"), "preset_base": (str, None),
    "disabled_rules": (list, "disabled_rules"), "score_kinds": (list, "score_kinds"), "strict_structure_enabled": (bool, "strict_structure"),
    "file_limits.max_files": (int, "max_files"), "file_limits.max_depth": (int, "max_depth"),
    "file_limits.max_scan_file_size_bytes": (int, "max_scan_bytes"),
    "file_classification.inert_extensions": (list, "inert_extensions"),
    "rule_scoping.doc_path_indicators": (list, "doc_path_indicators"), "rule_scoping.skip_in_docs": (list, "skip_in_docs"),
    "pipeline.known_installer_domains": (list, "known_installer_domains"), "credentials.known_test_values": (list, None),
    "finding_output.dedupe": (bool, None),
    "strict_structure.allowed_extensions": (list, "allowed_extensions"), "strict_structure.allowed_subdirs": (list, "allowed_subdirs"),
    "trigger.min_description_length": (int, None), "trigger.keyword_baiting_threshold": (int, None),
}
OVERRIDES = {"severity_overrides": ("severity", str), "hard_trigger_overrides": ("hard_trigger", bool)}


def parse(text: str, name: str) -> Any:
    """The data of a file's text."""
    try:
        return json.loads(text)
    except json.JSONDecodeError as err:
        if name.endswith(".json"):
            raise PackError(f"{name}: line {err.lineno}: {err.msg}") from err
    try:
        import yaml
    except ImportError as err:
        raise PackError(f"{name}: not JSON, and PyYAML is not installed") from err
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as err:
        raise PackError(f"{name}: {' '.join(str(err).split())}") from err


def read_text(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def _is_a(value: Any, kind: type) -> bool:
    return isinstance(value, kind) and (kind is bool or not isinstance(value, bool))


def _strings(value: Any, place: str) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
        raise PackError(f"{place}: a list of texts is due")
    return tuple(value)


def _one_of(value: Any, allowed: tuple[str, ...], place: str) -> str:
    if value not in allowed:
        raise PackError(f"{place}: {value!r} is none of {', '.join(allowed)}")
    return value


def _mapping(value: Any, place: str) -> dict:
    if not isinstance(value, dict) or not all(isinstance(k, str) for k in value):
        raise PackError(f"{place}: a map is due")
    return value


def _no_others(fields, allowed, place: str) -> None:
    if unknown := sorted(set(fields) - set(allowed)):
        raise PackError(f"{place}: unknown fields: {', '.join(unknown)}")


def rule_of(data: Any, place: str) -> Rule:
    data = _mapping(data, place)
    place = f"{place} ({data['id']})" if isinstance(data.get("id"), str) else place
    _no_others(data, (*PACK_REQUIRED, *PACK_DEFAULTS), place)
    if missing := [f for f in PACK_REQUIRED if f not in data]:
        raise PackError(f"{place}: missing: {', '.join(missing)}")
    have = PACK_DEFAULTS | data
    for field, kind in (("id", str), ("description", str), ("weight", int), ("hard_trigger", bool)):
        if not _is_a(have[field], kind):
            raise PackError(f"{place}: {field}: {kind.__name__} is due")
    if have["cwe_id"] is not None and not isinstance(have["cwe_id"], str):
        raise PackError(f"{place}: cwe_id: str is due")
    return Rule(
        have["id"], _one_of(have["category"], CATEGORIES, f"{place}: category"), _one_of(have["severity"], SEVERITIES, f"{place}: severity"),
        have["weight"], _one_of(have["confidence"], CONFIDENCES, f"{place}: confidence"), have["cwe_id"],
        _strings(have["patterns"], f"{place}: patterns"), _strings(have["exclude_patterns"], f"{place}: exclude_patterns"),
        _strings(have["file_types"], f"{place}: file_types"), have["hard_trigger"], _strings(have["suppress_if_matched"], f"{place}: suppress_if_matched"),
    )


def pack_of(text: str, name: str) -> tuple[Rule, ...]:
    """Rules of one pack's text: `rules`, and `version` or `name` if it likes."""
    data = _mapping(parse(text, name), name)
    _no_others(data, ("rules", "version", "name", "description", "metadata"), name)
    if not isinstance(data.get("rules"), list):
        raise PackError(f"{name}: rules: a list is due")
    rules = tuple(rule_of(r, f"{name}: rule {i + 1}") for i, r in enumerate(data["rules"]))
    try:
        return load_packs(rules)
    except PackError as err:
        raise PackError(f"{name}: {err}") from err


def read_packs(spark: SparkSession, paths: list[str], builtin: bool = True) -> tuple[Rule, ...]:
    """Rules of the built-in packs, unless these are left out, and of the files; no id may occur twice."""
    return load_packs(*[builtin_rules()] * builtin, *[pack_of(read_text(spark, p), p) for p in paths])


def policy_of(text: str, name: str, rules: tuple[Rule, ...] = ()) -> Policy:
    """A policy file's text over the defaults; ids it names must be those of a rule."""
    data = parse(text, name)
    data = _mapping({} if data is None else data, name)
    flat: dict[str, Any] = {}
    sections = {f.split(".")[0] for f in POLICY_FIELDS if "." in f}
    for field, value in data.items():
        if field in sections:
            flat |= {f"{field}.{k}": v for k, v in _mapping(value, f"{name}: {field}").items()}
        else:
            flat[field] = value
    _no_others(flat, (*POLICY_FIELDS, *OVERRIDES), name)
    have: dict[str, Any] = {"rules": rules}
    ids = {r.rule_id for r in rules or builtin_rules()}

    def known(rule_id: Any, place: str) -> str:
        if rule_id not in ids:
            raise PackError(f"{place}: no rule {rule_id!r}")
        return rule_id

    for field, (kind, own) in POLICY_FIELDS.items():
        if field not in flat or (field == "preset_base" and flat[field] is None):
            continue
        value, place = flat[field], f"{name}: {field}"
        if kind is list:
            value = _strings(value, place)
        elif not _is_a(value, kind):
            raise PackError(f"{place}: {kind.__name__} is due")
        if kind is int and value < 0:
            raise PackError(f"{place}: {value} is below 0")
        if field == "score_kinds":
            value = tuple(_one_of(v, KINDS, place) for v in value)
        if field == "disabled_rules":
            value = tuple(known(v, place) for v in value)
        if field == "file_classification.inert_extensions":
            value = tuple(v.lower().removeprefix(".") for v in value)
        if own:
            have[own] = value
    for field, (what, kind) in OVERRIDES.items():
        if field not in flat:
            continue
        if not isinstance(flat[field], list):
            raise PackError(f"{name}: {field}: a list is due")
        pairs = []
        for i, entry in enumerate(flat[field]):
            place = f"{name}: {field} {i + 1}"
            _no_others(_mapping(entry, place), ("rule_id", what, "reason"), place)
            if not _is_a(entry.get(what), kind):
                raise PackError(f"{place}: {what}: {kind.__name__} is due")
            pairs.append((known(entry.get("rule_id"), place), _one_of(entry[what], SEVERITIES, place) if kind is str else entry[what]))
        if len({p[0] for p in pairs}) < len(pairs):
            raise PackError(f"{name}: {field}: a rule is named twice")
        have[field] = tuple(pairs)
    return dataclasses.replace(DEFAULT_POLICY, **have)


def read_policy(spark: SparkSession, path: str, packs: list[str] = (), builtin: bool = True) -> Policy:
    """A policy with the rules of the built-in packs and of the given files."""
    rules = read_packs(spark, list(packs), builtin) if packs or not builtin else ()
    return policy_of(read_text(spark, path), path, rules)


def _stable(value: Any) -> Any:
    """Lists in which order means nothing, sorted; rules as their fields."""
    if isinstance(value, tuple):
        return sorted((_stable(v) for v in value), key=lambda v: json.dumps(v, sort_keys=True))
    return value


def fingerprint(policy: Policy = DEFAULT_POLICY) -> str:
    """16 hex digits for all that a scan's results depend on beside the files: the policy and every rule.

    The same for equal contents, in whatever order a file lists them and in any process; rules that a policy names but
    that are the built-in ones give what no rules give.
    """
    fields = {f.name: _stable(getattr(policy, f.name)) for f in dataclasses.fields(policy) if f.name != "rules"}
    rules = sorted(({f.name: getattr(r, f.name) for f in dataclasses.fields(r)} for r in rules_of(policy)), key=lambda r: r["rule_id"])
    for rule in rules:  # the first pattern that matches names a whole-text hit, so the order of patterns stays
        rule |= {f: sorted(rule[f]) for f in ("excludes", "file_types", "suppressed_by")}
    return hashlib.sha256(json.dumps([fields, rules], sort_keys=True).encode()).hexdigest()[:16]
