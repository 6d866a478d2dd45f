"""Catalog source: nested JSON lines or parquet, with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JSON_SCHEMA = (
    "parent_asin string, title string, features array<string>, "
    "details map<string,string>, description variant, categories array<string>, "
    "store string, price variant, average_rating double, rating_number bigint"
)
COLUMNS = (
    "parent_asin", "title", "features", "details", "description", "categories",
    "store", "price", "price_text", "average_rating", "rating_number",
)


def read_catalog(spark: SparkSession, path: str, fail_fast: bool = True) -> DataFrame:
    """Products of a JSON-lines catalog.

    Blank lines are skipped and ids trimmed.  ``price`` keeps JSON numbers only
    (text and booleans become null) while ``price_text`` keeps what was written.
    A description may be one text or a list.  With ``fail_fast=False`` lines that
    do not parse are dropped into nulls instead of failing the read.
    """
    mode = "FAILFAST" if fail_fast else "PERMISSIVE"
    raw = spark.read.schema(JSON_SCHEMA).option("mode", mode).json(path)
    price_type = F.schema_of_variant("price")
    is_number = price_type.isin("BIGINT", "DOUBLE", "FLOAT") | price_type.startswith("DECIMAL")
    text_type = F.schema_of_variant("description")
    description = (
        F.when(text_type == "STRING", F.array(F.try_variant_get("description", "$", "string")))
        .otherwise(F.try_variant_get("description", "$", "array<string>"))
    )
    written = F.try_variant_get("price", "$", "string")
    price_text = (
        F.when(price_type == "BOOLEAN", F.initcap(written))
        .when(is_number & (price_type != "BIGINT"), F.try_variant_get("price", "$", "double").cast("string"))
        .otherwise(written)
    )
    return raw.select(
        F.trim("parent_asin").alias("parent_asin"),
        "title", "features", "details",
        description.alias("description"),
        "categories", "store",
        F.when(is_number, F.try_variant_get("price", "$", "double")).alias("price"),
        price_text.alias("price_text"),
        "average_rating", "rating_number",
    )


def read_catalog_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from parquet, where price is already numeric or null."""
    df = spark.read.parquet(path)
    if "price_text" not in df.columns:
        df = df.withColumn("price_text", F.col("price").cast("string"))
    return df.select(F.trim("parent_asin").alias("parent_asin"), *COLUMNS[1:])
