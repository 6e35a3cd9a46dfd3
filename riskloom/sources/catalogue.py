"""Nested catalogue documents as flat plugin rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT = "struct<en:string, zh:string>"
SCHEMA = (
    f"categories array<struct<id:string, name:{TEXT}, marketplaces:array<struct<name:string, repository_url:string, "
    f"plugins:array<struct<name:string, version:string, description:{TEXT}>>>>>>"
)


def localized(text: Column, locale: str) -> Column:
    return text["zh"] if locale.startswith("zh") else text["en"]


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue files, one JSON document each."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def plugin_rows(documents: DataFrame, locale: str = "en") -> DataFrame:
    """category -> marketplace -> plugin, one row per plugin; other columns of the document row stay."""
    kept = [c for c in documents.columns if c != "categories"]
    per_category = documents.select(*kept, F.explode("categories").alias("c"))
    per_market = per_category.select(*kept, "c", F.explode("c.marketplaces").alias("m"))
    rows = per_market.select(*kept, "c", "m", F.explode("m.plugins").alias("p"))
    return rows.select(
        *kept, F.col("c.id").alias("category"), localized(F.col("c.name"), locale).alias("category_name"),
        F.col("m.name").alias("marketplace"), "m.repository_url", F.col("p.name").alias("plugin"), "p.version",
        localized(F.col("p.description"), locale).alias("description"),
    )
