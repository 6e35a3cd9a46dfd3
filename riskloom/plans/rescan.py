"""Incremental scan: only what changed is scanned, and its results replace the stored ones.

Stored results are the rows of sources.reports.report_parts and, for each bundle, one row of part `scan` with its key:
the checksum of its files and the fingerprint of policy and rules. They lie in SLOTS partitions by a hash of the bundle.
A rescan compares keys, scans the bundles that are due, and overwrites the partitions that hold any of them, each with
its other rows as they were. A key lies beside its results, so a job that dies leaves each partition either as it was or
done; the next rescan finds what is still due. Rescanning what is stored scans and writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import findings as FN
from riskloom.operators import manifest, structure
from riskloom.operators.inventory import bundle_checksums
from riskloom.packs.files import fingerprint
from riskloom.packs.policy import DEFAULT_POLICY, Policy
from riskloom.plans import scan
from riskloom.session import Steps
from riskloom.sources.reports import report_parts

SLOTS = 64
#: Files a slot's rows are dealt to while they are written, so that a large bundle's are not written by one task.
WRITERS = 8
#: Bundle ids that are broadcast at most, to leave the files they are looked up for where they lie.
BROADCAST = 200_000
STORED = "bundle_id string, part string, body string, slot int"
KEY = "checksum string, fingerprint string"


def scan_parts(files: DataFrame, steps: Steps, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Whole reports of the files' bundles, as parts."""
    facts = steps.keep(scan.scan_facts(files, policy), "facts")
    strict = structure.structure_findings(files, manifest.bundles(files), policy) if policy.strict_structure else None
    found = steps.keep(scan.findings_of(facts, policy, strict), "findings")
    scored = FN.scores(found, policy.score_kinds, scan.partial_bundles(facts))
    return report_parts(scored, found, FN.recommendations(found, scored))


def scan_keys(files: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """bundle_id, checksum, fingerprint: what the bundle's results depend on."""
    return bundle_checksums(files).withColumn("fingerprint", F.lit(fingerprint(policy)))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows below path; none if there is nothing yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Stored reports as parts, for sources.reports.read_parts and read_advice."""
    return stored(spark, path).where("bundle_id is not null and part <> 'scan'").select("bundle_id", "part", "body")


def read_keys(rows: DataFrame) -> DataFrame:
    return rows.where("part = 'scan'").select("bundle_id", F.from_json("body", KEY).alias("k")).select("bundle_id", "k.*")


def plan(keys: DataFrame, before: DataFrame) -> DataFrame:
    """bundle_id and why it is due: new, content, rules (also: policy) or removed. Bundles that are not due have no row."""
    old = before.select("bundle_id", F.struct("checksum", "fingerprint").alias("old"))
    both = keys.select("bundle_id", F.struct("checksum", "fingerprint").alias("now")).join(old, "bundle_id", "full")
    reason = (
        F.when(F.col("now").isNull(), "removed").when(F.col("old").isNull(), "new")
        .when(F.col("now.checksum") != F.col("old.checksum"), "content").when(F.col("now.fingerprint") != F.col("old.fingerprint"), "rules")
    )
    return both.select("bundle_id", reason.alias("reason")).where("reason is not null")


def slot_of(bundle: str = "bundle_id", slots: int = SLOTS):
    return F.pmod(F.xxhash64(bundle), F.lit(slots)).cast("int")


def rescan(files: DataFrame, path: str, policy: Policy = DEFAULT_POLICY, slots: int = SLOTS) -> DataFrame:
    """Bring the results below path up to the files and the policy; returns the plan that was carried out.

    files are all files there are now: stored bundles without one lose their results. Runs when called.
    """
    spark = files.sparkSession
    steps = Steps(spark, "rescan")
    before = stored(spark, path)
    keys = steps.keep(scan_keys(files, policy), "keys")
    due = steps.keep(plan(keys, read_keys(before)), "due")
    n_due = due.count()
    if not n_due:
        return due
    near = F.broadcast if n_due <= BROADCAST else lambda df: df
    again = near(due.where("reason <> 'removed'").select("bundle_id"))
    key = F.to_json(F.struct("checksum", "fingerprint"))
    fresh = scan_parts(files.join(again, "bundle_id", "left_semi"), steps, policy).unionByName(
        keys.join(again, "bundle_id", "left_semi").select("bundle_id", F.lit("scan").alias("part"), key.alias("body"))
    )
    touched = due.select(slot_of(slots=slots).alias("slot")).distinct()  # SLOTS rows at most
    others = before.where("bundle_id is not null").join(F.broadcast(touched), "slot", "left_semi").join(near(due), "bundle_id", "left_anti")
    # A row without a bundle in each partition that is written, so that one that has lost all its bundles is overwritten too.
    marks = touched.select(F.lit(None).cast("string").alias("bundle_id"), F.lit("slot").alias("part"), F.lit("").alias("body"), "slot")
    rows = fresh.withColumn("slot", slot_of(slots=slots)).unionByName(others.select("bundle_id", "part", "body", "slot")).unionByName(marks)
    # Kept before it is written: it reads the partitions that it replaces.
    merged = steps.keep(rows, "merged")
    merged.repartition("slot", F.pmod(F.xxhash64("bundle_id", "part", "body"), F.lit(WRITERS))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("slot").parquet(path)
    steps.drop("facts", "findings", "merged", "keys")
    return due
