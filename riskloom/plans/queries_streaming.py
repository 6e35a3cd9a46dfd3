"""Streaming queries: the documents table arrives as a stream, results land in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.plans import oracle_chains, oracle_checks, oracle_rules  # noqa: F401 (fills the table list)
from riskloom.plans.oracle_core import with_ctes
from riskloom.plans.registry import add
from riskloom.session import Steps
from riskloom.sources import derived as D
from riskloom.streaming import live_scan as L

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
START = 1704067200  # 2024-01-01 00:00:00 UTC


def document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a stream, whether it is one file or a folder of files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    reader = spark.readStream.schema(DOCUMENTS)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(f"{sf_dir}/documents.parquet")
    return reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir)  # a stream reads folders only


def arrivals(spark: SparkSession, sf_dir: str, times: int = 1) -> DataFrame:
    """Files derived from streamed documents, one arriving per minute; optionally delivered again."""
    def once() -> DataFrame:
        docs = document_stream(spark, sf_dir).select("doc_id", "source", "text", F.timestamp_seconds(F.lit(START) + F.col("doc_id") * 60).alias("arrived_at"))
        return D.in_scope(D.with_file_columns(D.derive(docs)))

    stream = once()
    for _ in range(times - 1):
        stream = stream.unionByName(once())
    return stream


def scanned(spark: SparkSession, sf_dir: str, times: int = 1) -> str:
    """Run the scan over all that has arrived; the folder of its findings."""
    folder = Steps(spark, "live").folder
    L.write_scan(arrivals(spark, sf_dir, times), f"{folder}/findings", f"{folder}/scan-state").awaitTermination()
    return folder


COLUMNS = ["bundle_id", "rel_path", "line_no", "rule_id", "severity", "weight"]
_parts = ("graded", "chain_hits", "taint_hits", "unicode_hits", "asset_hits", "file_mismatches")
_every = "SELECT bundle_id, rel_path, line_no, rule_id, category, severity, weight, snippet FROM graded " + " ".join(
    f"UNION ALL SELECT bundle_id, rel_path, line_no, rule_id, category, severity, NULL, snippet FROM {t}" for t in _parts[1:5]
) + " UNION ALL SELECT bundle_id, rel_path, NULL, 'FILE_MAGIC_MISMATCH', 'Obfuscation', severity, NULL, NULL FROM file_mismatches"


def scan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(L.SCHEMA).option("recursiveFileLookup", True).parquet(f"{scanned(spark, sf_dir)}/findings").select(*COLUMNS)


def without_redelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scanned(spark, sf_dir, 2)
    once = L.drop_redelivered(L.read_findings(spark, f"{folder}/findings"))
    L.write_findings(once, f"{folder}/once", f"{folder}/once-state").awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{folder}/once").select(*COLUMNS)


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scanned(spark, sf_dir)
    L.write_counts(L.hourly_counts(L.read_findings(spark, f"{folder}/findings")), f"{folder}/hours", f"{folder}/hours-state").awaitTermination()
    return L.latest_counts(spark, f"{folder}/hours")


add("stream_scan", scan_stream, with_ctes(_parts, f"SELECT {', '.join(COLUMNS)} FROM ({_every})"))
add("stream_without_redelivery", without_redelivery, with_ctes(_parts, f"""
SELECT {', '.join(COLUMNS)} FROM ({_every}) QUALIFY row_number() OVER (PARTITION BY bundle_id, rel_path, rule_id, line_no, snippet ORDER BY severity) = 1"""))
add("stream_hourly_counts", hours, with_ctes((*_parts, "raw_files"), f"""
SELECT time_bucket(INTERVAL 1 HOUR, t) AS hour, category, count(*) AS n FROM ({_every})
JOIN (SELECT bundle_id, rel_path, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS t FROM raw_files) r USING (bundle_id, rel_path) GROUP BY ALL"""))
