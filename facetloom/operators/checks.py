"""Integrity checks and statistics over catalogs, indexes and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.functions import scalars as S


def catalog_violations(catalog: DataFrame) -> DataFrame:
    """Rows without an id, and ids that occur more than once."""
    ids = catalog.select(F.trim(F.coalesce("parent_asin", F.lit(""))).alias("parent_asin"))
    counted = ids.groupBy("parent_asin").agg(F.count("*").alias("n"))
    missing = F.when(F.col("parent_asin") == "", "missing_id")
    kind = missing.otherwise(F.when(F.col("n") > 1, "duplicate_id"))
    return counted.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        "kind", "parent_asin", "n"
    )


def index_coverage(index_ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """Ids found on one side only."""
    left = index_ids.select("parent_asin").distinct()
    right = catalog.select("parent_asin").distinct()
    only_index = left.join(right, "parent_asin", "left_anti").withColumn("side", F.lit("index"))
    only_catalog = right.join(left, "parent_asin", "left_anti").withColumn("side", F.lit("catalog"))
    return only_index.unionByName(only_catalog)


def vector_check(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Counts of bad vectors per check: finite, one dimension, unit norm, unique id."""
    v = vectors.select(
        F.col(id_col).alias("id"),
        F.size(vector_col).alias("dim"),
        F.exists(
            vector_col, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
        ).alias("odd"),
        F.sqrt(
            F.aggregate(
                vector_col, F.lit(0.0).cast("double"),
                lambda a, x: a + x.cast("double") * x.cast("double"),
            )
        ).alias("norm"),
    )
    per_id = v.groupBy("id").agg(
        F.count("*").alias("n"),
        F.sum(F.col("odd").cast("int")).alias("odd"),
        F.sum((F.abs(F.col("norm") - 1.0) > 0.02).cast("int")).alias("off_norm"),
        F.min("dim").alias("lo"), F.max("dim").alias("hi"),
    )
    totals = per_id.agg(
        F.coalesce(F.sum("odd"), F.lit(0)).alias("not_finite"),
        F.coalesce(F.sum("off_norm"), F.lit(0)).alias("not_unit"),
        F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("duplicate_id"),
        F.when(F.max("hi") > F.min("lo"), 1).otherwise(0).cast("long").alias("mixed_dimension"),
    )
    return totals.select(
        F.expr(
            "stack(4, 'not_finite', not_finite, 'not_unit', not_unit, "
            "'duplicate_id', duplicate_id, 'mixed_dimension', mixed_dimension) as (check, n_bad)"
        )
    )


def index_stats(products: DataFrame, nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Row counts of every index table as (key, value)."""
    one = products.agg(
        F.count("*").alias("products"),
        F.count_distinct("coarse_category").alias("coarse_categories"),
        F.sum(F.col("uncategorized").cast("long")).alias("uncategorized_products"),
    ).select(
        F.expr(
            "stack(3, 'products', products, 'coarse_categories', coarse_categories, "
            "'uncategorized_products', uncategorized_products) as (key, value)"
        )
    )
    tree = nodes.agg(F.count("*").alias("value")).select(F.lit("categories").alias("key"), "value")
    rows = facts.groupBy("attribute").agg(F.count("*").alias("value")).select(
        F.concat("attribute", F.lit("_rows")).alias("key"), "value"
    )
    return one.unionByName(tree).unionByName(rows)


def content_fingerprint(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Row count and an order-free digest of ``key NUL payload`` rows.

    Each row's SHA-256 is cut into eight 32-bit words and the words are summed
    by place: sums combine map-side, count copies, and need no list of rows.
    """
    row = F.sha2(F.concat(F.col(key), F.lit(S.NUL), F.col(payload), F.lit("\n")), 256)
    words = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    sums = df.select(row.alias("h")).agg(
        F.count("*").alias("n"), *[F.coalesce(F.sum(w), F.lit(0)).cast("decimal(38,0)").alias(f"w{i}") for i, w in enumerate(words)]
    )
    return sums.select("n", F.sha2(F.concat_ws(":", "n", *[f"w{i}" for i in range(8)]), 256).alias("digest"))

