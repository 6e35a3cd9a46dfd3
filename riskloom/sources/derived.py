"""A corpus of bundles derived from the `documents` table.

The prose of every document is kept whole; a fragment of code or text is added,
and path, extension and bundle follow from the document id. Row-wise only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import paths as P
from riskloom.functions.sqltext import quoted
from riskloom.packs.policy import DEFAULT_POLICY, Policy
from riskloom.sources.payloads import BYTE_PREFIXES, DIRS, MANIFESTS, PAYLOADS


def _pick(values, index: Column) -> Column:
    items = ", ".join("NULL" if v is None else quoted(v) for v in values)
    return F.element_at(F.expr(f"array({items})"), (index + 1).cast("int"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out as the session says (riskloom.input.partitions); without the setting the table's own splits stay.

    For tables written as one small file, where splits are too few for the cores.
    """
    wanted = df.sparkSession.conf.get("riskloom.input.partitions", None)
    return df.repartition(int(wanted), key) if wanted else df


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spread(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id"))


def derive(docs: DataFrame) -> DataFrame:
    """Bundle files out of documents; works on a stream as well."""
    group = F.floor(F.col("doc_id") / 200)
    bundle = F.concat(F.col("source"), F.lit("-"), group.cast("string"))
    is_main = (F.floor(F.col("doc_id") / 20) % 10 == 0) & ((F.col("doc_id") + group) % 9 != 4)
    k = F.col("doc_id") % len(PAYLOADS)
    suffix = _pick([s for s, _ in PAYLOADS], k)
    body = _pick([b for _, b in PAYLOADS], k)
    manifest = F.replace(
        _pick(MANIFESTS, (F.col("doc_id") % 20 + group * 3) % len(MANIFESTS)), F.lit("@ID@"), bundle
    )
    path = F.when(is_main, F.lit("SKILL.md")).otherwise(
        F.concat(_pick(DIRS, F.col("doc_id") % len(DIRS)), F.lit("f"), F.col("doc_id").cast("string"), suffix)
    )
    text = F.col("text")
    content = (
        F.when(is_main, F.concat(manifest, F.lit("\n"), text))
        .when(body.isNull(), text)
        .when(F.col("doc_id") % 3 == 0, F.concat(body, F.lit("\n"), text))
        .when(F.col("doc_id") % 3 == 1, F.concat(text, F.lit("\n"), body))
        .otherwise(F.concat(text, F.lit("\r\n"), body, F.lit("\n")))
    )
    passed = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    return docs.select(
        *passed, F.col("doc_id"), bundle.alias("bundle_id"), path.alias("rel_path"), content.alias("content")
    )


def with_file_columns(raw: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Attach the per-file columns every operator reads."""
    path = F.col("rel_path")
    ext = P.extension(path)
    declared = P.file_class(ext)
    return raw.withColumns(
        {
            "ext": ext,
            "file_type": F.when((declared == "unknown") & F.col("content").startswith("#!"), F.lit("script")).otherwise(declared),
            "size_bytes": F.octet_length("content").cast("bigint"),
            "is_binary": declared == "binary",
            "is_hidden": P.is_hidden(path),
            "is_main": P.is_main_file(path),
            "is_doc_path": P.is_doc_path(path, policy),
        }
    )


def in_scope(files: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Drop build and dependency directories and housekeeping files, at whatever depth."""
    path = F.col("rel_path")
    return files.where(
        ~P.in_skipped_dir(path, policy, keep_bytecode_dirs=True)
        & ~F.lower(P.file_name(path)).isin(*policy.housekeeping_files)
    )


def files(spark: SparkSession, sf_dir: str, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return in_scope(with_file_columns(raw_files(spark, sf_dir), policy), policy)


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as bytes, some with a foreign signature in front."""
    prefix = F.unhex(_pick(BYTE_PREFIXES, F.col("doc_id") % len(BYTE_PREFIXES)))
    return raw_files(spark, sf_dir).select(
        "bundle_id", "rel_path", P.extension(F.col("rel_path")).alias("ext"),
        F.concat(prefix, F.encode("content", "UTF-8")).alias("bytes"),
    )
