"""Lookups and filters over facts, products and the category tree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.functions import text as X
from facetloom.functions import vocab as V
from facetloom.session import spread_join


def check_attribute(attribute: str) -> None:
    if attribute not in V.ASK_ATTRIBUTES:
        raise ValueError(f"attribute must be one of: {', '.join(V.ASK_ATTRIBUTES)}")


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    if limit is None:
        return df
    if limit < 0:
        raise ValueError("limit must be non-negative")
    return df.limit(limit)


def norm_literal(value: str) -> str:
    import unicodedata

    return " ".join(unicodedata.normalize("NFKC", value).casefold().split())


def facet_lookup(facts: DataFrame, attribute: str, value: str, limit: int | None = None) -> DataFrame:
    """Products with one exact value, by id."""
    check_attribute(attribute)
    hits = facts.filter(
        (F.col("attribute") == attribute) & (F.col("normalized_value") == norm_literal(value))
    )
    return limited(hits.select("parent_asin").orderBy("parent_asin"), limit)


def facet_lookup_many(facts: DataFrame, lookups: DataFrame) -> DataFrame:
    """(lookup columns, parent_asin) for many (attribute, normalized_value) rows."""
    postings = facts.select("attribute", "normalized_value", "parent_asin")
    return lookups.join(postings, ["attribute", "normalized_value"])


def values_for_product(facts: DataFrame, ids: DataFrame, attribute: str) -> DataFrame:
    """Display values of one attribute per product, in catalog order."""
    check_attribute(attribute)
    return (
        facts.filter(F.col("attribute") == attribute)
        .join(ids.select("parent_asin").distinct(), "parent_asin", "left_semi")
        .groupBy("parent_asin")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "display_value"))).alias("v"))
        .select("parent_asin", F.col("v.display_value").alias("values"))
    )


def price_between(
    products: DataFrame, maximum: float, minimum: float = 0, limit: int | None = None
) -> DataFrame:
    """Priced products of an inclusive range, cheapest first."""
    hits = products.filter(F.col("price").between(minimum, maximum))
    return limited(hits.select("parent_asin", "price").orderBy("price", "parent_asin"), limit)


def price_ceiling(candidates: DataFrame, products: DataFrame, ceilings: DataFrame, key: str) -> DataFrame:
    """Candidates under their session's ceiling (exclusive unless ``inclusive``).

    A product without a price never passes; a session without a ceiling keeps all.
    """
    priced = candidates.join(products.select("parent_asin", "price"), "parent_asin")
    judged = spread_join(priced, ceilings.select(key, "max_price", "inclusive"), [key], ["parent_asin"], "left")
    under = F.when(F.col("inclusive"), F.col("price") <= F.col("max_price")).otherwise(
        F.col("price") < F.col("max_price")
    )
    return judged.filter(F.col("max_price").isNull() | under).select(key, "parent_asin")


def facet_filter(
    products: DataFrame,
    facts: DataFrame,
    filters: Mapping[str, str | Sequence[str]] | None = None,
    min_price: float | None = None,
    max_price: float | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Products passing every attribute (values of one attribute are alternatives)."""
    result = products
    if min_price is not None:
        result = result.filter(F.col("price") >= float(min_price))
    if max_price is not None:
        result = result.filter(F.col("price") < float(max_price))
    for attribute, requested in (filters or {}).items():
        check_attribute(attribute)
        values = [requested] if isinstance(requested, str) else list(requested)
        wanted = sorted({norm_literal(v) for v in values if v.strip()})
        if not wanted:
            return products.select("parent_asin").filter(F.lit(False))
        hits = facts.filter((F.col("attribute") == attribute) & F.col("normalized_value").isin(wanted))
        result = result.join(hits.select("parent_asin"), "parent_asin", "left_semi")
    return limited(result.select("parent_asin").orderBy("parent_asin"), limit)


def category_lookup(nodes: DataFrame, name: str) -> DataFrame:
    return (
        nodes.filter(F.col("normalized_name") == norm_literal(name))
        .select("name", "full_path", "depth", "product_count")
        .orderBy(F.desc("product_count"), "full_path")
    )


def category_products(
    bridge: DataFrame, full_path: str, leaf_only: bool = False, limit: int | None = None
) -> DataFrame:
    """Products under an exact node path."""
    hits = bridge.filter(F.col("full_path") == full_path)
    if leaf_only:
        hits = hits.filter(F.col("is_leaf"))
    return limited(hits.select("parent_asin").orderBy("parent_asin"), limit)


def resolve_pools(sessions: DataFrame, products: DataFrame) -> DataFrame:
    """Name the candidate pool of each session by its ``category``.

    An unknown category falls back to the default one, and to ``*`` (the whole
    catalog) when that is empty too.  Pools are named, never copied per session.
    """
    known = products.select(F.col("coarse_category").alias("category"), F.lit(True).alias("_known")).distinct()
    default = products.filter(F.col("coarse_category") == V.DEFAULT_CATEGORY).limit(1).agg(
        F.when(F.count("*") > 0, V.DEFAULT_CATEGORY).otherwise("*").alias("_default")
    )
    marked = sessions.join(known, "category", "left")
    return (
        marked.crossJoin(F.broadcast(default))  # one row
        .withColumn("pool", F.when(F.col("_known"), F.col("category")).otherwise(F.col("_default")))
        .drop("_known", "_default")
    )


def pool_members(products: DataFrame) -> DataFrame:
    """(pool, parent_asin): every coarse category, and ``*`` for the whole catalog."""
    return products.select(
        F.explode(F.array(F.col("coarse_category"), F.lit("*"))).alias("pool"), "parent_asin"
    )


def category_name_products(bridge: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(label, parent_asin): products under nodes of the given names.

    ``targets`` has (label, names, terms); a node's path must contain every term.
    Names, terms and paths are folded alike, so a label finds its own node in any script.
    """
    wanted = X.with_normalized(
        targets.select("label", F.explode(F.array_distinct("names")).alias("_name"), X.fold_list(F.col("terms")).alias("terms"))
        .filter(F.trim("_name") != ""),
        "_name", "normalized_name",
    ).select("label", "normalized_name", F.transform("terms", lambda x: X.normalize_value(x)).alias("terms"))
    paths = (
        nodes.select("normalized_name", "full_path", X.fold_case(F.col("full_path"), True).alias("_folded_path"))
        .join(wanted, "normalized_name")
        .filter(F.forall("terms", lambda term: F.contains("_folded_path", term)))
        .select("label", "full_path")
    )
    return bridge.select("full_path", "parent_asin").join(paths, "full_path").select("label", "parent_asin").distinct()
