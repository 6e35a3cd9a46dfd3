"""Streams of files: what a batch leaves behind, and batches that are run again."""

import os
import shutil

from pyspark.sql import functions as F

from riskloom.plans import queries_streaming
from riskloom.session import Steps
from riskloom.sources.derived import with_file_columns
from riskloom.streaming import live_scan as L

SCHEMA = "bundle_id string, rel_path string, content string, arrived_at timestamp"


def arrive(spark, folder, number, *texts):
    rows = [(f"b{number}", f"f{i}.sh", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "bundle_id string, rel_path string, content string").withColumn(
        "arrived_at", F.timestamp_seconds(F.lit(1704067200 + number))).coalesce(1).write.mode("append").parquet(str(folder))


def steps_of(spark):
    base = Steps(spark, "probe").folder.removeprefix("file://").rsplit("/", 1)[0]
    return {d for d in os.listdir(base) if d.startswith("live-")} if os.path.isdir(base) else set()


def run(spark, tmp_path):
    arrivals = with_file_columns(L.read_arrivals(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1))
    L.write_scan(arrivals, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return sorted((r.bundle_id, r.rel_path, r.rule_id) for r in spark.read.schema(L.SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).collect())


def test_batches_leave_their_findings_and_nothing_else(spark, tmp_path):
    before = steps_of(spark)
    for number in range(4):
        arrive(spark, tmp_path / "in", number, "sudo ls\n", "echo fine\n")
    found = run(spark, tmp_path)
    assert {b for b, _, _ in found} == {f"b{i}" for i in range(4)} and steps_of(spark) == before
    assert sorted(d for d in os.listdir(tmp_path / "out")) == [f"batch={i}" for i in range(4)]
    # The last batch's commit is lost: the stream runs it again and finds it done.
    for name in ("3", ".3.crc"):
        shutil.copy(tmp_path / "state" / "commits" / name, tmp_path / f"kept-{name}")
        os.unlink(tmp_path / "state" / "commits" / name)
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    assert run(spark, tmp_path) == found
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")} == times
    # A batch that died while it was written has left nothing that is read, and is done when it is run again.
    arrive(spark, tmp_path / "in", 9, "chmod 777 /x\n")
    (tmp_path / "out" / "_writing-4").mkdir()
    (tmp_path / "out" / "_writing-4" / "part-0.parquet").write_bytes(b"half")
    assert {b for b, _, _ in run(spark, tmp_path)} == {"b0", "b1", "b2", "b3", "b9"}
    assert steps_of(spark) == before


def test_documents_stream_from_a_file_and_from_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(i, "sudo ls\n" * i, "en", "web", 8 * i) for i in range(6)], queries_streaming.DOCUMENTS)
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    shutil.copy(next((tmp_path / "one").glob("*.parquet")), tmp_path / "file" / "documents.parquet")
    found = {name: sorted(map(str, queries_streaming.scan_stream(spark, str(tmp_path / name)).collect())) for name in ("folder", "file")}
    assert found["folder"] == found["file"] and len(found["file"]) > 0
    assert queries_streaming.without_redelivery(spark, str(tmp_path / "folder")).count() > 0
    assert sum(r.n for r in queries_streaming.hours(spark, str(tmp_path / "folder")).collect()) == len(found["file"])
