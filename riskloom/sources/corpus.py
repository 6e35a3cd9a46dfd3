"""Bundle files straight from storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.packs.policy import DEFAULT_POLICY, Policy
from riskloom.sources.derived import in_scope, with_file_columns
from riskloom.sources.encoding import with_text


#: Bytes of the longest file that is read as one row; longer ones are read in splits, by sources.long_files.
WHOLE = 256 * 1024 * 1024


def with_place(rows: DataFrame, root: str, path: str = "path") -> DataFrame:
    """bundle_id (the first path part below root) and rel_path of files of the given path; those straight in root go."""
    spark = rows.sparkSession
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    # The path after scheme and host, less the root by its length: no pattern that a folder's name could upset.
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    relative = F.substr(plain, F.lit(len(base) + 2))
    at = F.instr(relative, "/")
    return rows.withColumns({"bundle_id": F.substr(relative, F.lit(1), at - 1), "rel_path": F.substr(relative, at + 1)}).where("bundle_id <> ''")


def scan_folder(spark: SparkSession, root: str, policy: Policy = DEFAULT_POLICY, whole: int = WHOLE) -> DataFrame:
    """Files below root, the first path part being the bundle; decoded, in scope, with file columns and bytes.

    Paths are listed and put in scope first; only files in scope are opened (the filters on `path` and `length` reach the
    listing of files, and `content` is read for what is left). Files of up to `whole` bytes are read, each as a row; longer
    ones are left to long_files. A size limit of the policy is reported by the coverage checks, not applied here.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= whole)
    rows = in_scope(with_place(raw, root), policy).select(
        "bundle_id", "rel_path", F.col("length").alias("n_bytes"), F.col("content").alias("bytes")
    )
    decoded = with_text(rows, "bytes").withColumn("holds_nul", F.col("is_binary"))
    texts = decoded.select(
        "bundle_id", "rel_path", "n_bytes", "holds_nul", "bytes", F.coalesce("text", F.lit("")).alias("content"))
    files = with_file_columns(texts, policy).withColumns({
        "is_binary": F.col("is_binary") | F.col("holds_nul"), "size_bytes": F.col("n_bytes"),
        "is_utf8": F.is_valid_utf8(F.col("bytes").cast("string"))})
    return files.drop("holds_nul", "n_bytes")
