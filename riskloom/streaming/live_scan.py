"""The whole scan over arriving files, and what is derived from its findings as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators import findings as FN
from riskloom.operators.rule_scan import drop_suppressed_rules, explode_hits, grade_hits
from riskloom.packs.policy import DEFAULT_POLICY, Policy
from riskloom.plans.scan import KEYS, scan_facts
from riskloom.session import Steps

COLUMNS = (*FN.FINDING_COLUMNS, "arrived_at", "finding_id")
SCHEMA = (
    "bundle_id string, rel_path string, line_no int, rule_id string, category string, severity string, confidence string, weight int, "
    "hard_trigger boolean, snippet string, analyzer string, cwe_id string, description string, arrived_at timestamp, finding_id string"
)


def read_arrivals(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scan_batch(files: DataFrame, policy: Policy = DEFAULT_POLICY, steps: Steps | None = None) -> DataFrame:
    """Findings of the files of one batch: rules with suppression and grading, chains, taint, characters, assets, types.

    Everything concerns single files, so nothing is held from batch to batch. Secrets are masked. The result reads a table
    of steps; whoever gives steps ends them once the result is written.
    """
    steps = steps or Steps(files.sparkSession, "live")
    facts = steps.keep(scan_facts(files, policy, passed=("arrived_at",)), "facts")
    hits = explode_hits(facts, [*KEYS, "arrived_at"], "hits")
    pack = hits.where(F.col("analyzer").isNull()).drop("category", "severity", "analyzer")
    graded = grade_hits(drop_suppressed_rules(pack, policy), policy).withColumn("analyzer", F.lit(None).cast("string"))
    others = hits.where(F.col("analyzer").isNotNull() & (F.col("analyzer") != "capability"))
    rows = graded.select(*FN.FINDING_COLUMNS, "arrived_at").unionByName(
        others.select("arrived_at", *[c for c in FN.FINDING_COLUMNS if c in others.columns]), allowMissingColumns=True
    )
    place = F.concat_ws("/", "bundle_id", "rel_path")
    # The id is built before the secret is hidden, so that two secrets on one line stay two findings.
    return FN.masked(rows.withColumn("finding_id", FN.finding_id(F.col("rule_id"), place, F.col("line_no"), F.coalesce("snippet", F.lit("")))), policy).select(*COLUMNS)


def batch_path(spark: SparkSession, path: str, number: int):
    return spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number}")


def write_scan(files: DataFrame, path: str, checkpoint: str, policy: Policy = DEFAULT_POLICY, every: str | None = None) -> StreamingQuery:
    """Scan a stream of files into a table, a folder a batch; `every` is the time between batches, None takes all there is and ends.

    A batch is written aside and takes its place by one rename, so a reader finds it whole or not at all. A batch that is
    there already is left alone: run again after a failure, it would find the same files. Its steps go when it is written.
    """
    spark = files.sparkSession
    fs = batch_path(spark, path, 0).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def one(batch: DataFrame, number: int) -> None:
        place = batch_path(spark, path, number)
        if fs.exists(place):
            return
        steps = Steps(spark, "live")
        try:
            aside = f"{path}/_writing-{number}"
            scan_batch(batch, policy, steps).write.mode("overwrite").parquet(aside)
            if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), place):
                raise RuntimeError(f"{place} cannot be put in place")
        finally:
            steps.end()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """The findings table as a stream."""
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(path)


def drop_redelivered(findings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """State holds ids only as long as the watermark allows."""
    return findings.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["finding_id"])


def hourly_counts(findings: DataFrame, delay: str = "1 hour") -> DataFrame:
    counts = findings.withWatermark("arrived_at", delay).groupBy(F.window("arrived_at", "1 hour"), "category").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("hour"), "category", "n")


def write_findings(findings: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        findings.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**trigger).start()
    )


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counts as they stand after each batch, those of open hours too; latest_counts reads them."""
    def one(batch: DataFrame, number: int) -> None:
        batch.withColumn("as_of", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        counts.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The last known count of each hour and category, open hours included."""
    rows = spark.read.schema("hour timestamp, category string, n bigint, as_of bigint").option("recursiveFileLookup", True).parquet(path)
    return rows.groupBy("hour", "category").agg(F.max_by("n", "as_of").alias("n"))
