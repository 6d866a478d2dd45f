"""Linear, factorization-machine and crossed scoring of (context, product) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.session import spread_join


def add_vectors(vectors: Column, dimension: int) -> Column:
    """Sum of an array of vectors, in order."""
    zero = F.array_repeat(F.lit(0.0), dimension)
    return F.aggregate(vectors, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def item_components(item_features: DataFrame, params: DataFrame, dimension: int) -> DataFrame:
    """(parent_asin, features, linear, base, vector) per product.

    ``base`` holds the item-only part of a factorization machine, so that scoring
    a pair later costs one dot product.  ``params``: (name, linear, vector).  A
    product has few features; they are gathered in name order, which fixes the
    order of summation.
    """
    rows = item_features.join(params, "name").groupBy("parent_asin").agg(
        F.array_sort(F.collect_list(F.struct("name", "linear", "vector"))).alias("f")
    )
    zero = F.lit(0.0)
    return (
        rows.withColumn("features", F.col("f.name"))
        .withColumn("linear", F.aggregate("f", zero, lambda s, x: s + x["linear"]))
        .withColumn("vector", add_vectors(F.col("f.vector"), dimension))
        .withColumn("squares", F.aggregate("f", zero, lambda s, x: s + dot(x["vector"], x["vector"])))
        .withColumn("base", F.col("linear") + 0.5 * (dot(F.col("vector"), F.col("vector")) - F.col("squares")))
        .select("parent_asin", "features", "linear", "base", "vector")
    )


def context_vectors(context_features: DataFrame, params: DataFrame, dimension: int) -> DataFrame:
    """(context_key, features, context_vector) from mapped (context_key, name) rows."""
    rows = context_features.join(params, "name").groupBy("context_key").agg(
        F.array_sort(F.collect_list(F.struct("name", "vector"))).alias("f")
    )
    return rows.select(
        "context_key", F.col("f.name").alias("features"),
        add_vectors(F.col("f.vector"), dimension).alias("context_vector"),
    )


def score_linear(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Static item score; the context plays no part."""
    return pairs.join(items.select("parent_asin", F.col("linear").alias("score")), "parent_asin")


def score_fm(pairs: DataFrame, contexts: DataFrame, items: DataFrame) -> DataFrame:
    """Item base plus the context-item interaction (context-only terms cancel)."""
    rows = pairs.join(items.select("parent_asin", "base", "vector"), "parent_asin")
    joined = spread_join(
        rows, contexts.select("context_key", "context_vector"), ["context_key"], ["parent_asin"]
    )
    return joined.select(
        "context_key", "parent_asin",
        (F.col("base") + dot(F.col("context_vector"), F.col("vector"))).alias("score"),
    )


def feature_field(name: str) -> Column:
    """Field of a feature name such as ``ctx:color=red``."""
    return F.regexp_extract(name, r"^[^:]+:([^=]*)", 1)


def product_crosses(items: DataFrame, crosses: DataFrame, asked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cross weight of (context feature, product), summed over the product's features.

    ``crosses``: (context_feature, item_feature, weight).  A feature crosses very many others: only the
    (context_feature, parent_asin) of ``asked`` are looked up.
    """
    named = asked.join(items.select("parent_asin", "features"), "parent_asin").select(
        "context_feature", "parent_asin", F.explode("features").alias("item_feature")
    )
    joined = named.join(crosses, ["context_feature", "item_feature"])
    if "item_field" in by:
        joined = joined.withColumn("item_field", feature_field("item_feature"))
    return joined.groupBy("context_feature", "parent_asin", *by).agg(F.sum("weight").alias("weight"))


def crossing_sets(contexts: DataFrame, crosses: DataFrame) -> DataFrame:
    """(context_key, cross_key, crossing): a context's features that have a cross; equal sets share a key."""
    useful = crosses.select("context_feature").distinct()
    own = contexts.select("context_key", F.explode("features").alias("context_feature")).join(
        useful, "context_feature", "left_semi"
    )
    sets = own.groupBy("context_key").agg(F.array_sort(F.collect_set("context_feature")).alias("crossing"))
    return sets.withColumn("cross_key", F.sha2(F.to_json(F.struct("crossing")), 256))


def crossing_features(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct (cross_key, parent_asin, context_feature) of the pairs: contexts with the same crossing features share them."""
    keyed = spread_join(
        pairs.select("context_key", "parent_asin"), sets.select("context_key", "cross_key"), ["context_key"], ["parent_asin"]
    ).select("cross_key", "parent_asin").distinct()
    own = sets.select("cross_key", "crossing").dropDuplicates(["cross_key"])
    return spread_join(keyed, own, ["cross_key"], ["parent_asin"]).select(
        "cross_key", "parent_asin", F.explode("crossing").alias("context_feature")
    )


def crossed(pairs: DataFrame, contexts: DataFrame, items: DataFrame, crosses: DataFrame, by: tuple[str, ...] = ()):
    """Weights of (cross_key, parent_asin, context_feature, *by), and the contexts' cross keys."""
    sets = crossing_sets(contexts, crosses)
    rows = crossing_features(pairs, sets)
    weights = product_crosses(items, crosses, rows.select("context_feature", "parent_asin").distinct(), by)
    return rows.join(weights, ["context_feature", "parent_asin"]), sets.select("context_key", "cross_key")


def for_contexts(pairs: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """What was found of (cross_key, parent_asin), for each pair of a context with that key."""
    keyed = spread_join(pairs.select("context_key", "parent_asin"), sets, ["context_key"], ["parent_asin"])
    return keyed.join(found, ["cross_key", "parent_asin"]).drop("cross_key")


def cross_weight_join(
    pairs: DataFrame, contexts: DataFrame, items: DataFrame, crosses: DataFrame,
    disabled: tuple[str, str] | None = None,
) -> DataFrame:
    """(context_key, parent_asin, cross_score) of the pairs that have any cross.

    Weights are summed per (context feature, product) for those that some pair brings together,
    then once for all contexts with the same crossing features.
    """
    if disabled is not None:
        off = (feature_field("context_feature") == disabled[0]) & (feature_field("item_feature") == disabled[1])
        crosses = crosses.filter(~off)
    rows, sets = crossed(pairs, contexts, items, crosses)
    found = rows.groupBy("cross_key", "parent_asin").agg(F.sum("weight").alias("cross_score"))
    return for_contexts(pairs, sets, found)


def score_hybrid(
    pairs: DataFrame, contexts: DataFrame, items: DataFrame, crosses: DataFrame,
    disabled: tuple[str, str] | None = None,
) -> DataFrame:
    """Factorization machine plus explicit crosses."""
    base = score_fm(pairs, contexts, items)
    crossed = cross_weight_join(pairs, contexts, items, crosses, disabled)
    return base.join(crossed, ["context_key", "parent_asin"], "left").select(
        "context_key", "parent_asin", (F.col("score") + F.coalesce("cross_score", F.lit(0.0))).alias("score")
    )


def routed_scores(
    contexts: DataFrame, linear: DataFrame | None, hybrid: DataFrame | None, pairs: DataFrame
) -> DataFrame:
    """Linear scores for buying contexts, hybrid ones otherwise.

    A missing model is replaced by the other; without any, products tie and
    rank by id.  ``contexts``: (context_key, scenario).
    """
    if linear is None and hybrid is None:
        return pairs.withColumn("score", F.lit(0.0))
    if linear is None or hybrid is None:
        return hybrid if linear is None else linear
    buying = contexts.filter(F.col("scenario") == "buying").select("context_key")
    other = contexts.filter(F.col("scenario") != "buying").select("context_key")
    return linear.join(buying, "context_key", "left_semi").unionByName(
        hybrid.join(other, "context_key", "left_semi")
    )


def cross_contributions(
    pairs: DataFrame, contexts: DataFrame, items: DataFrame, crosses: DataFrame
) -> DataFrame:
    """(context_key, parent_asin, context_field, item_field, contribution)."""
    rows, sets = crossed(pairs, contexts, items, crosses, ("item_field",))
    found = (
        rows.withColumn("context_field", feature_field("context_feature"))
        .groupBy("cross_key", "parent_asin", "context_field", "item_field")
        .agg(F.sum("weight").alias("contribution"))
    )
    return for_contexts(pairs, sets, found)
