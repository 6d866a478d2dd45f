"""Category tree, attribute facts and intent cards of a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.functions import scalars as S
from facetloom.functions import text as X
from facetloom.functions import vocab as V

EMPTY = "array<string>"


def category_prefixes(catalog: DataFrame) -> DataFrame:
    """One row per product and path prefix."""
    named = catalog.select("parent_asin", X.category_names(F.col("categories")).alias("names"))
    rows = named.select("parent_asin", "names", F.posexplode("names").alias("position", "name"))
    path = F.array_join(F.slice("names", 1, F.col("position") + 1), V.PATH_SEPARATOR)
    parent = F.when(
        F.col("position") > 0, F.array_join(F.slice("names", 1, F.col("position")), V.PATH_SEPARATOR)
    )
    return rows.select(
        "parent_asin", "name", path.alias("full_path"), parent.alias("parent_path"),
        "position", (F.col("position") == F.size("names") - 1).alias("is_leaf"),
    )


def category_nodes(bridge: DataFrame) -> DataFrame:
    """Category tree with product counts; the full path is the key."""
    nodes = bridge.groupBy("full_path").agg(
        F.any_value("name").alias("name"),
        F.any_value("parent_path").alias("parent_path"),
        F.any_value("position").alias("depth"),
        F.count("*").alias("product_count"),
    )
    return X.with_normalized(nodes, "name", "normalized_name")


def category_counts(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("full_path").agg(F.count("*").alias("product_count"))


def category_bridge_join(bridge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Product rows with their node's attributes."""
    links = bridge.select("parent_asin", "full_path", "position", "is_leaf")
    return links.join(nodes, "full_path")


def product_categories(catalog: DataFrame) -> DataFrame:
    names = X.category_names(F.col("categories"))
    return catalog.select("parent_asin", X.coarse_category(names).alias("coarse_category"))


def product_category_path(bridge: DataFrame, products: DataFrame, ids: DataFrame) -> DataFrame:
    """Ordered node paths and the coarse category of the given products."""
    paths = (
        bridge.join(ids, "parent_asin", "left_semi")
        .groupBy("parent_asin")
        .agg(F.array_sort(F.collect_list(F.struct("position", "full_path"))).alias("p"))
        .select("parent_asin", F.col("p.full_path").alias("paths"))
    )
    return products.join(ids, "parent_asin", "left_semi").join(paths, "parent_asin", "left")


def with_disclosed(catalog: DataFrame, corpus: Column | None = None) -> DataFrame:
    """Add ``corpus``, ``materials``, ``colors`` and ``disclosed``.

    ``disclosed`` lists all cleaned constraints in order, without repeats:
    features then details; the first material leads, the first colour comes
    second, the price closes the list.  Steps are separate columns so that no
    list is built twice.
    """
    none = F.array().cast(EMPTY)
    material = F.get("materials", F.lit(0))
    color = F.get("colors", F.lit(0))
    price = F.col("price_text")
    return (
        catalog.withColumn("corpus", X.searchable_text() if corpus is None else corpus)
        .withColumn("materials", X.word_tags(F.col("corpus"), V.MATERIALS))
        .withColumn("colors", X.word_tags(F.col("corpus"), V.COLORS))
        .withColumn("_base", F.concat(X.flatten_list(F.col("features")), X.flatten_map(F.col("details"))))
        .withColumn(
            "_base", F.concat(F.when(material.isNotNull(), F.array(material)).otherwise(none), "_base")
        )
        .withColumn(
            "_base",
            F.concat(
                F.slice("_base", 1, 1),
                F.when(color.isNotNull(), F.array(F.concat(F.lit("color: "), color))).otherwise(none),
                F.slice("_base", 2, F.greatest(F.size("_base"), F.lit(1))),
                F.when(
                    price.isNotNull() & (price != ""),
                    F.array(F.concat(F.lit("budget around $"), price)),
                ).otherwise(none),
            ),
        )
        .withColumn(
            "disclosed",
            F.array_distinct(
                F.filter(F.transform("_base", lambda c: X.clean_text(c)), lambda c: c != "")
            ),
        )
        .drop("_base")
    )


def shown_title() -> Column:
    return X.clean_text(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("product")))


def with_constraints(catalog: DataFrame) -> DataFrame:
    """``with_disclosed`` plus the first four ``constraints`` (the title if none)."""
    return with_disclosed(catalog).withColumn(
        "constraints",
        F.when(F.size("disclosed") > 0, F.slice("disclosed", 1, 4)).otherwise(F.array(shown_title())),
    )


def attribute_facts(catalog: DataFrame) -> DataFrame:
    """(attribute, normalized_value, display_value, parent_asin, ordinal) facts."""
    base = with_constraints(catalog)
    categories = F.filter(
        F.transform(X.flatten_list(F.col("categories")), lambda c: X.clean_text(c)), lambda c: c != ""
    )
    base = base.withColumn("names", categories)
    # Name and path of every level, interleaved.
    levels = F.flatten(
        F.transform(
            "names",
            lambda name, i: F.array(
                name, F.array_join(F.slice("names", 1, i + 1), V.PATH_SEPARATOR)
            ),
        )
    )
    makers = F.filter(
        F.map_entries("details"),
        lambda e: F.lower(e["key"]).rlike("brand|manufacturer") & e["value"].isNotNull(),
    )
    brands = F.concat(
        X.flatten_scalar(F.col("store")),
        F.coalesce(F.transform(makers, lambda e: e["value"]), F.array().cast(EMPTY)),
    )
    brands = F.transform(brands, lambda b: X.clean_text(b))
    budget = F.when(F.col("price").isNotNull(), F.array(F.format_string("%.2f", "price"))).otherwise(
        F.array().cast(EMPTY)
    )
    own = {
        "category": levels,
        "brand": brands,
        "budget": budget,
        "material": F.col("materials"),
        "color": F.col("colors"),
        "other": F.col("constraints"),
    }
    base = base.withColumn(
        "typed",
        F.transform(
            "constraints",
            lambda c: F.struct(X.classify_constraint(c, V.COLORS).alias("a"), c.alias("c")),
        ),
    )

    def values(attribute: str) -> Column:
        parts = own.get(attribute, F.array().cast(EMPTY))
        if attribute != "other":
            said = F.filter("typed", lambda t: t["a"] == attribute)
            parts = F.concat(parts, F.transform(said, lambda t: t["c"]))
        return F.array_distinct(F.filter(parts, lambda v: v.isNotNull() & (v != "")))

    table = F.map_from_arrays(
        F.array(*[F.lit(a) for a in V.ASK_ATTRIBUTES]),
        F.array(*[values(a) for a in V.ASK_ATTRIBUTES]),
    )
    rows = (
        base.select("parent_asin", F.explode(table).alias("attribute", "v"))
        .select("parent_asin", "attribute", F.posexplode("v").alias("ordinal", "display_value"))
    )
    rows = X.with_normalized(rows, "display_value", "normalized_value")
    # Values that only differ before normalisation: the first one stands.
    return rows.groupBy("attribute", "normalized_value", "parent_asin").agg(
        F.min_by("display_value", "ordinal").alias("display_value"),
        F.min("ordinal").alias("ordinal"),
    )


def intent_card(catalog: DataFrame) -> DataFrame:
    """Target category, hard constraints (1-2) and soft preferences (3-4 or first)."""
    cards = with_disclosed(catalog, X.evaluator_text()).withColumn(
        "c", F.when(F.size("disclosed") > 0, F.col("disclosed")).otherwise(F.array(shown_title()))
    )
    soft = F.slice("c", 3, 2)
    return cards.select(
        "parent_asin",
        shown_title().alias("target_category"),
        F.slice("c", 1, 2).alias("hard_constraints"),
        F.when(F.size(soft) > 0, soft).otherwise(F.slice("c", 1, 1)).alias("soft_preferences"),
    )


def product_profile(catalog: DataFrame) -> DataFrame:
    """Products as rankers see them: category, typed constraints, buckets; values folded as facts are.

    ``constraints`` holds hard then soft constraints, so a product with one or
    two of them repeats the first.
    """
    base = with_constraints(catalog)
    folded = X.fold_list(F.transform("constraints", lambda c: X.clean_text(c, None)))
    typed = F.filter(
        F.zip_with(
            "constraints", folded,
            lambda c, v: F.struct(
                X.classify_constraint(c).alias("attribute"),
                F.trim(X.collapse_white(v)).alias("value"),
                c.alias("display"),
            ),
        ),
        lambda t: t["value"] != "",
    )
    base = base.withColumn("t", typed)
    soft = F.when(F.size("t") > 2, F.slice("t", 3, 2)).otherwise(F.slice("t", 1, 1))
    return base.select(
        "parent_asin",
        X.coarse_category(X.category_names(F.col("categories"))).alias("category"),
        F.concat(F.slice("t", 1, 2), soft).alias("constraints"),
        F.nullif(X.normalize_value(F.coalesce("store", F.lit("")), True), F.lit("")).alias("brand"),
        S.price_bucket(F.col("price")).alias("price_bucket"),
        S.rating_bucket(F.col("average_rating")).alias("rating_bucket"),
        S.popularity_bucket(F.col("rating_number")).alias("popularity_bucket"),
        F.least(F.size("t"), F.lit(2)).alias("hard_count"),
    )


def reply_values(profile: DataFrame) -> DataFrame:
    """Ordered (product, ordinal, attribute, value); repeats stay."""
    return profile.select(
        "parent_asin", F.posexplode("constraints").alias("ordinal", "c")
    ).select("parent_asin", "ordinal", F.col("c.attribute"), F.col("c.value").alias("normalized_value"))


def brand_dictionary(facts: DataFrame, min_count: int = 2) -> DataFrame:
    """Brands of at least ``min_count`` products, longest first."""
    return (
        facts.filter(F.col("attribute") == "brand")
        .groupBy("normalized_value")
        .agg(F.count("*").alias("product_count"), F.min("display_value").alias("brand"))
        .filter(F.col("product_count") >= min_count)
        .filter(~F.lower(F.trim("brand")).isin(*V.GENERIC_BRANDS))
        .orderBy(F.char_length("brand").desc(), "brand")
    )


def attribute_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("attribute").agg(F.count("*").alias("n"))
