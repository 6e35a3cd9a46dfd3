"""Files too long for a row, read in splits: numbered lines.

Spark's text reader takes a file apart at line feeds, however long it is, and says where in the file each split begins. A
line's number is its place in its split and the lines of the splits before, counted. Places are numbered once, while the
lines are written as a step table. A carriage return before a line feed belongs to the break; a mark of byte order in
front of the first line goes; bytes that are no UTF-8 become U+FFFD. A file with a NUL has no lines: it is binary, or text
in UTF-16, which can't be split at bytes. One line must fit into a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.packs.policy import DEFAULT_POLICY, Policy
from riskloom.session import Steps
from riskloom.sources.corpus import WHOLE, with_place
from riskloom.sources.derived import in_scope, with_file_columns

PLACE = ["bundle_id", "rel_path"]
#: Splits whose first lines are broadcast at most; more are joined by a shuffle.
BROADCAST = 100_000


def raw_lines(spark: SparkSession, root: str, policy: Policy, longer_than: int) -> DataFrame:
    """PLACE, n_bytes, begins (of the split, in the file), value of files in scope; filters on the path and size reach the listing."""
    read = spark.read.option("recursiveFileLookup", True).text(root, lineSep="\n")
    rows = read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("n_bytes"), F.col("_metadata.file_block_start").alias("begins"), "value"
    ).where(F.col("n_bytes") > longer_than)
    # Metadata gives paths as URIs.
    return in_scope(with_place(rows.withColumn("path", F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))), root), policy).select(*PLACE, "n_bytes", "begins", "value")


def numbered_lines(spark: SparkSession, root: str, steps: Steps, policy: Policy = DEFAULT_POLICY, longer_than: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """Lines (file columns, line_no, line) of files longer than that, and files with a NUL (PLACE, n_bytes), which have none."""
    raw = steps.keep(raw_lines(spark, root, policy, longer_than).withColumn("at", F.monotonically_increasing_id()), "raw-lines")
    splits = raw.groupBy(*PLACE, "begins").agg(
        F.count("*").alias("n"), F.min("at").alias("first"), F.max("n_bytes").alias("n_bytes"), F.max(F.contains("value", F.lit("\0"))).alias("holds_nul")
    )
    before = Window.partitionBy(*PLACE).orderBy("begins").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    whole = Window.partitionBy(*PLACE)
    splits = steps.keep(
        splits.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "holds_nul": F.max("holds_nul").over(whole)}), "splits"
    )
    texts = splits.where(~F.col("holds_nul")).select(*PLACE, "begins", "first", "base")
    side = F.broadcast(texts) if texts.count() <= BROADCAST else texts
    line = F.make_valid_utf8(F.regexp_replace("value", r"\r\z", ""))
    no = F.col("at") - F.col("first") + F.col("base") + 1
    lines = raw.join(side, [*PLACE, "begins"]).select(
        *PLACE, "n_bytes", no.alias("line_no"), F.when(no == 1, F.regexp_replace(line, "^﻿", "")).otherwise(line).alias("line"))
    starts = lines.where("line_no = 1").select(*PLACE, "n_bytes", F.col("line").alias("content"))
    files = steps.keep(
        with_file_columns(starts, policy).withColumn("size_bytes", F.col("n_bytes")).select(*PLACE, "size_bytes", "ext", "file_type", "is_binary", "is_main", "is_doc_path"), "long-files"
    )
    return lines.drop("n_bytes").join(files, PLACE), splits.where("holds_nul").groupBy(*PLACE).agg(F.max("n_bytes").alias("n_bytes"))
