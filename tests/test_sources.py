"""Files from storage, encodings, catalogues, stored reports and versions."""

from pyspark.sql import functions as F

from riskloom.functions import versions as V
from riskloom.functions.urls import canonical_repository_url
from riskloom.operators import inventory as I
from riskloom.sources import catalogue, corpus, reports


def test_scan_folder(spark, tmp_path):
    root = tmp_path / "root"
    for path, data in {
        "one/SKILL.md": b"---\nname: one\n---\nsudo ls\n", "one/node_modules/x.js": b"1", "one/a.txt": "héllo".encode("utf-16"),
        "one/.DS_Store": b"x", "two/b.sh": b"\x00\x01\x02", "two/c.py": "é".encode(),
    }.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    rows = {(r.bundle_id, r.rel_path): r for r in corpus.scan_folder(spark, str(root)).collect()}
    assert set(rows) == {("one", "SKILL.md"), ("one", "a.txt"), ("two", "b.sh"), ("two", "c.py")}
    assert rows["one", "a.txt"].content == "héllo"
    assert rows["two", "b.sh"].is_binary and rows["two", "b.sh"].size_bytes == 3
    assert rows["one", "SKILL.md"].is_main


def test_scan_folder_opens_files_in_scope_only(spark, tmp_path):
    """A root with a name that is a pattern and comes twice, files out of scope, links of types to a full report."""
    from riskloom.packs.policy import Policy
    from riskloom.plans import scan

    root = tmp_path / "a+b" / "a+b"
    for path, data in {
        "a+b/SKILL.md": b"---\nname: x\n---\n", "a+b/.git/big.bin": b"x", "two/x.py": b"MZ\x90\x00\x03", "two/SKILL.md": b"caf\xe9\n", "top.md": b"no bundle",
    }.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    (root / "a+b" / ".git" / "big.bin").chmod(0)
    files = corpus.scan_folder(spark, str(root))
    assert {(r.bundle_id, r.rel_path) for r in files.select("bundle_id", "rel_path").collect()} == {("a+b", "SKILL.md"), ("two", "x.py"), ("two", "SKILL.md")}
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Filter") < plan.index("Scan binaryFile")
    found = {(r.bundle_id, r.rule_id) for r in scan.bundle_findings(files, Policy(strict_structure=True)).collect()}
    assert {("two", "FILE_MAGIC_MISMATCH"), ("two", "STRUCTURE_NON_UTF8")} <= found
    report = {r.bundle_id: r for r in scan.bundle_reports(files).collect()}
    assert report["two"].blocked and report["two"].partial_scan and not report["a+b"].blocked and not report["a+b"].partial_scan


def test_links_block_a_bundle(spark, files_of):
    from riskloom.plans import scan

    files = files_of({("a", "x.py"): "x = 1", ("b", "x.py"): "x = 1"}).withColumn("is_symlink", F.col("bundle_id") == "b")
    report = {r.bundle_id: r for r in scan.bundle_reports(files).collect()}
    assert report["b"].blocked and report["b"].partial_scan and report["b"].score <= 29 and not report["a"].blocked
    secret = files_of({("c", "x.py"): "password = 'hunter2222222'"})
    assert "hunter2222222" not in str(scan.bundle_findings(secret).collect())


def test_catalogue_file(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text("""{"categories": [{"id": "k", "name": {"en": "K", "zh": "z"}, "marketplaces": [
      {"name": "m", "repository_url": "u", "plugins": [{"name": "p", "version": "1", "description": {"en": "d", "zh": "e"}}]}]}]}""")
    rows = catalogue.plugin_rows(catalogue.read_catalogue(spark, str(path)), "en-US").collect()
    assert [(r.category, r.category_name, r.plugin, r.description) for r in rows] == [("k", "K", "p", "d")]


def test_reports_by_run_date(spark, tmp_path):
    df = spark.createDataFrame([("b", 10, "Critical", True, False, 3, 2, 1, 0)], "bundle_id string, score int, level string, blocked boolean, "
                               "partial_scan boolean, n_findings bigint, n_security bigint, n_auditability bigint, n_structure bigint")
    for day in ("2024-01-01", "2024-01-02"):
        reports.write_reports(df, str(tmp_path / "r"), day)
    back = spark.read.parquet(str(tmp_path / "r"))
    assert back.count() == 2 and back.where("run_date = '2024-01-02'").count() == 1
    assert reports.report_json(df).first().report == '{"bundle_id":"b","score":10,"level":"Critical","blocked":true,"partial_scan":false,"n_findings":3,"n_security":2,"n_auditability":1,"n_structure":0}'


def test_versions(spark):
    cases = [
        ("1.2.0", "1.10.0", True), ("v1.0", "1.0.0", False), ("1.0.0-beta.2", "1.0.0-beta.11", True), ("1.0.0", "1.0.0-rc", False),
        ("1.0.0-rc", "1.0.0", True), ("1.0.0-alpha", "1.0.0-1", False), ("nightly", "2.0", False), ("1.0+b1", "1.0+b2", False),
        (None, "1.0", False), ("1_2", "1.3", True), ("1.0.0-beta", "1.0.0-beta.1", True),
    ]
    df = spark.createDataFrame(cases, "c string, l string, want boolean").withColumn("got", V.is_outdated(F.col("c"), F.col("l")))
    assert [(r.c, r.l) for r in df.collect() if r.got != r.want] == []


def test_commit_ids(spark):
    cases = [("abcdef0", "abcdef0123", True), ("abcdef", "abcdef0123", False), ("abc", "abc", True), ("", "abc", False), (None, "abc", False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean").withColumn("got", V.same_commit(F.col("a"), F.col("b")))
    assert [(r.a, r.b) for r in df.collect() if r.got != r.want] == []


def test_repository_addresses(spark):
    cases = [
        ("https://github.com/a/b", "https://github.com/a/b"), (" http://WWW.github.com/a/b.git ", "https://github.com/a/b"),
        ("github.com/a/b/tree/main", "https://github.com/a/b"), ("https://github.com/a/b/issues", None), ("https://gitlab.com/a/b", None),
        ("https://github.com/-a/b", None), ("https://github.com/a", None), ("https://github.com/a/..", None),
    ]
    df = spark.createDataFrame(cases, "u string, want string").withColumn("got", canonical_repository_url(F.col("u")))
    assert [r.u for r in df.collect() if r.got != r.want] == []


def test_update_status(spark):
    commits = spark.createDataFrame(
        [("r", "p", 1, "aaaaaaa1"), ("r", "p", 3, "bbbbbbb1"), ("r", "q", 2, "ccccccc1"), ("r", "q", 4, "ddddddd1")],
        "repo string, path string, seq bigint, sha string")
    installs = spark.createDataFrame(
        [("same", "r", "p", "bbbbbbb"), ("old", "r", "p", "aaaaaaa1"), ("between", "r", "p", "ccccccc1"), ("after", "r", "p", "ddddddd1"),
         ("none", "r", "p", None), ("nopath", "r", "x", "aaaaaaa1"), ("short", "r", "p", "bbbbbb")],
        "id string, repo string, path string, installed_sha string")
    got = {r.id: r.status for r in I.update_status(installs, commits).collect()}
    assert got == {
        "same": "UpToDate", "old": "UpdateAvailable", "between": "UpdateAvailable", "after": "UpToDate",
        "none": "Unknown", "nopath": "Unknown", "short": "UpdateAvailable",
    }


def test_whole_files_decide_what_they_are(spark):
    """Nothing is decided on a prefix: a NUL far into a file, UTF-16 without a mark, bytes that are no text."""
    from riskloom.sources import encoding

    rows = [
        ("late_nul", b"a" * 5000 + b"\x00" + b"b" * 10), ("plain", b"a" * 9000), ("invalid", b"ab\xff\xfec"), ("le", ("text " * 40).encode("utf-16-le")),
        ("lone", "ab".encode("utf-16") + b"\x00\xd8" + "c".encode("utf-16-le")), ("noise", b"\x01\x00\x02\x00\x03\x00" * 50), ("empty", b""),
        ("lone_be", b"\xfe\xff" + "a\U0001f600".encode("utf-16-be") + b"\xdc\x00" + "z".encode("utf-16-be") + b"\x00"),
    ]
    got = {r.name: r for r in encoding.with_text(spark.createDataFrame(rows, "name string, data binary"), "data").collect()}
    assert got["late_nul"].is_binary and got["late_nul"].text is None and got["noise"].is_binary
    assert got["plain"].text == "a" * 9000 and got["invalid"].text == "ab��c" and got["empty"].text == ""
    assert got["le"].kind == "le" and got["le"].text == "text " * 40
    assert got["lone"].text == "ab�c" and got["lone_be"].text == "a\U0001f600�z"


def test_large_bundles_are_counted_whole(files_of):
    from riskloom.operators import coverage

    rows = coverage.scannable_counts(files_of({("b", f"f{i}.py"): "x" for i in range(2001)} | {("c", "a/" * 30 + "f.py"): "x"})).collect()
    assert {r.bundle_id: (r.n_scannable, r.beyond_limit) for r in rows} == {"b": (2001, True), "c": (1, False)}


def test_bundle_checksums(spark):
    def sums(rows):
        return I.bundle_checksums(spark.createDataFrame(rows, "bundle_id string, rel_path string, content string")).first().checksum

    base = sums([("b", "x", "1"), ("b", "y", "2")])
    assert base == sums([("b", "y", "2"), ("b", "x", "1")])
    assert len({base, sums([("b", "x", "2"), ("b", "y", "1")]), sums([("b", "x", "1"), ("b", "y", "2"), ("b", "z", "3"), ("b", "w", "3")]), sums([("b", "x", "1"), ("b", "z", "2")])}) == 4
