"""How much of a bundle a scan can read: limits, binaries, links and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import paths as P
from riskloom.packs.policy import DEFAULT_POLICY, Policy

# File classes for the readable share.
TEXT_ASSETS = ("svg", "html", "htm", "css", "xml", "xsd", "xsl", "xslt")
INERT_ASSETS = (
    "ttf otf woff woff2 eot png jpg jpeg gif webp avif bmp ico icns tif tiff heic heif pyc pyo db sqlite sqlite3 mp3 "
    "mp4 wav ogg webm flac aac pdf doc docx xls xlsx ppt pptx zip gz tar rar 7z bz2 xz class o so dll dylib exe msi "
    "dmg bin dat wasm jar war ear"
).split()
ANCILLARY_STEMS = ("license", "licence", "copying", "notice", "readme", "changelog", "changes")
ANCILLARY_EXTS = ("txt", "text", "rst")
LOW_SHARE = 70.0
SLICES = 64


def readable_class() -> Column:
    """'readable', 'ignored', 'binary' or 'other' for a file row."""
    stem = F.split(F.lower(P.file_name(F.col("rel_path"))), r"\.", 2)[0]
    readable = F.col("file_type").isin("markdown", "script", "config") | (
        (F.col("file_type") == "asset") & F.col("ext").isin(*TEXT_ASSETS)
    )
    ancillary = ~F.col("is_binary") & (stem.isin(*ANCILLARY_STEMS) | F.col("ext").isin(*ANCILLARY_EXTS))
    return (
        F.when(readable, "readable")
        .when(F.col("ext").isin(*INERT_ASSETS) | ancillary, "ignored")
        .when(F.col("is_binary"), "binary").otherwise("other")
    )


def readable_share(files: DataFrame) -> DataFrame:
    """Per bundle: bytes counted, bytes readable, share in percent, number of opaque binaries."""
    rows = files.select("bundle_id", "size_bytes", readable_class().alias("class"))
    counted = F.when(F.col("class") != "ignored", F.col("size_bytes")).otherwise(0)
    sums = rows.groupBy("bundle_id").agg(
        F.sum(counted).cast("bigint").alias("total_bytes"),
        F.sum(F.when(F.col("class") == "readable", F.col("size_bytes")).otherwise(0)).cast("bigint").alias("readable_bytes"),
        F.count(F.when(F.col("class") == "binary", 1)).alias("n_opaque"),
    )
    share = F.when(F.col("total_bytes") > 0, F.col("readable_bytes") / F.col("total_bytes") * 100).otherwise(100.0)
    return sums.withColumn("share", F.round(share, 4))


def coverage_findings(files: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Opaque binaries, oversized files, too many files, low readable share."""
    rows = files.select("bundle_id", "rel_path", "size_bytes", readable_class().alias("class"))
    per_file = F.array(
        F.when(F.col("class") == "binary", F.struct(F.lit("UNANALYZABLE_BINARY").alias("rule_id"), F.lit("Medium").alias("severity"))),
        F.when(F.col("size_bytes") > policy.max_scan_bytes, F.struct(F.lit("OVERSIZED_FILE").alias("rule_id"), F.lit("Info").alias("severity"))),
    )
    file_rows = rows.select("bundle_id", "rel_path", F.explode(F.filter(per_file, lambda r: r.isNotNull())).alias("r"))
    share = readable_share(files).where((F.col("share") < LOW_SHARE) & (F.col("n_opaque") > 0))
    counts = files.groupBy("bundle_id").count().where(F.col("count") > policy.max_files)
    none = F.lit(None).cast("string").alias("rel_path")
    return (
        file_rows.select("bundle_id", "rel_path", "r.rule_id", "r.severity")
        .unionByName(share.select("bundle_id", none, F.lit("LOW_ANALYZABILITY").alias("rule_id"), F.lit("Low").alias("severity")))
        .unionByName(counts.select("bundle_id", none, F.lit("EXCESSIVE_FILE_COUNT").alias("rule_id"), F.lit("Info").alias("severity")))
        .withColumn("category", F.lit("PolicyViolation"))
    )


def file_type_breakdown(files: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Bundles over the file limit with the number of files per type (six at most)."""
    per_type = files.groupBy("bundle_id", "file_type").count()
    return per_type.groupBy("bundle_id").agg(
        F.sum("count").cast("bigint").alias("n_files"),
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(": ", "file_type", F.col("count").cast("string")))), ", ").alias("breakdown"),
    ).where(F.col("n_files") > policy.max_files)


def beyond_file_limit(files: DataFrame, limit: int) -> DataFrame:
    """Files past the first `limit` paths of their bundle: what a capped scan would leave out.

    The cut path per bundle comes from small candidate sets: the first `limit` paths of
    each of 64 hash slices. Only bundles over the limit take part.
    """
    paths = files.select("bundle_id", "rel_path")
    over = paths.groupBy("bundle_id").count().where(F.col("count") > limit).select("bundle_id")
    sliced = paths.join(over, "bundle_id", "left_semi").withColumn("slice", F.pmod(F.xxhash64("rel_path"), F.lit(SLICES)))
    in_slice = Window.partitionBy("bundle_id", "slice").orderBy("rel_path")
    overall = Window.partitionBy("bundle_id").orderBy("rel_path")
    cut = (
        sliced.withColumn("r", F.row_number().over(in_slice)).where(F.col("r") <= limit)
        .withColumn("n", F.row_number().over(overall)).where(F.col("n") == limit)
        .select("bundle_id", F.col("rel_path").alias("cut"))
    )
    return paths.join(cut, "bundle_id").where(F.col("rel_path") > F.col("cut")).select("bundle_id", "rel_path")


def beyond_byte_limit(files: DataFrame, limit: int) -> DataFrame:
    """Files a byte-capped scan would cut, with the bytes it would not see. Our scan reads all of them."""
    return files.where(F.col("size_bytes") > limit).select(
        "bundle_id", "rel_path", "size_bytes", (F.col("size_bytes") - limit).alias("unseen_bytes")
    )


def scannable_counts(files: DataFrame, policy: Policy = DEFAULT_POLICY, skip_readme: bool = True) -> DataFrame:
    """Files per bundle a scan looks at, and whether they are more than the policy's limit. All of them are scanned."""
    rows = files.where(~F.col("ext").isin(*policy.inert_extensions))
    if skip_readme:
        rows = rows.where(~P.is_readme(F.col("rel_path")))
    return rows.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_scannable")).withColumn(
        "beyond_limit", F.col("n_scannable") > policy.max_files
    )


def symlink_findings(entries: DataFrame) -> DataFrame:
    """Links are never followed: each is a critical finding (needs an is_symlink column)."""
    return entries.where("is_symlink").select(
        "bundle_id", "rel_path", F.lit("SYMLINK").alias("rule_id"), F.lit("FileSystem").alias("display_category"),
        F.lit("Critical").alias("severity"),
    )


def discover_bundles(files: DataFrame) -> DataFrame:
    """Directories that hold a main file, at any depth; '.' for the root."""
    rows = files.where("is_main").select("root", "rel_path", P.parent_path(F.col("rel_path")).alias("directory"))
    return rows.select("root", "directory", F.element_at(F.split("directory", "/"), -1).alias("name"))
