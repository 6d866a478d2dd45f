"""Context and item features, value support, vocabulary and its mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.functions import scalars as S
from facetloom.functions import text as X
from facetloom.functions import vocab as V
from facetloom.operators.ordering import numbered, ranged

EMPTY = "array<string>"


def context_names(
    category: Column, scenario: Column, turn: Column, post_override: Column,
    known: Column, mode: str = "dual",
) -> Column:
    """Ordered, distinct context feature names of a session state.

    ``known`` is an array of (attribute, display) structs.  In dual mode a value
    learnt through the open question keeps its origin, its raw text and its
    inferred attribute; legacy mode stores every value under its own attribute.
    """
    if mode not in ("dual", "legacy"):
        raise ValueError("mode must be dual or legacy")
    head = F.array(
        F.concat(F.lit("ctx:category="), X.normalize_value(category, True)),
        F.concat(F.lit("ctx:scenario="), scenario),
        F.concat(F.lit("ctx:turn="), S.turn_bucket(turn)),
        F.when(post_override, "ctx:override=post").otherwise("ctx:override=pre"),
    )

    def encode(item: Column) -> Column:
        attribute, value = item["attribute"], item["value"]
        if mode == "legacy":
            return F.array(F.concat(F.lit("ctx:"), attribute, F.lit("="), value))
        field = F.lower(F.trim(attribute))
        open_answer = F.array(
            F.lit("ctx:answer_source=other"),
            F.concat(F.lit("ctx:other="), value),
            F.concat(F.lit("ctx:"), X.classify_constraint(item["display"]), F.lit("="), value),
        )
        typed = F.array(F.concat(F.lit("ctx:"), field, F.lit("="), value))
        return F.when(value == "", F.array().cast(EMPTY)).when(field == "other", open_answer).otherwise(typed)

    shown = F.transform(known, lambda k: X.clean_text(k["display"], None) if mode == "dual" else k["display"])
    valued = F.zip_with(
        known, X.fold_list(shown),
        lambda k, v: F.struct(
            k["attribute"].alias("attribute"), k["display"].alias("display"), F.trim(X.collapse_white(v)).alias("value")
        ),
    )
    # Attributes in alphabetical order, values of one attribute as they came.
    ordered = F.array_sort(
        F.transform(
            F.filter(valued, lambda k: k["attribute"].isNotNull()),
            lambda k, i: F.struct(k["attribute"].alias("attribute"), i.alias("i"), k["display"].alias("display"), k["value"].alias("value")),
        )
    )
    return F.array_distinct(F.concat(head, F.flatten(F.transform(ordered, encode))))


def train_support(profile: DataFrame, split: Column) -> DataFrame:
    """(field, value, support): training products per value and per brand.

    A value counts once per product; constraints also count under ``other``.
    Brand support is kept under the field ``#brand`` because a constraint may be
    of type brand too.
    """
    train = profile.filter(split == "train")
    pair = lambda a, v: F.struct(a.alias("field"), v.alias("value"))
    values = F.concat(
        F.array(pair(F.lit("category"), X.normalize_constraint(F.col("category"), True))),
        F.transform("constraints", lambda c: pair(c["attribute"], c["value"])),
        F.transform("constraints", lambda c: pair(F.lit("other"), c["value"])),
        F.when(F.col("brand").isNotNull(), F.array(pair(F.lit("#brand"), F.col("brand")))).otherwise(
            F.array().cast("array<struct<field:string,value:string>>")
        ),
    )
    return (
        train.select(F.explode(F.array_distinct(values)).alias("p"))
        .groupBy(F.col("p.field").alias("field"), F.col("p.value").alias("value"))
        .agg(F.count("*").alias("support"))
    )


def item_pairs(profile: DataFrame) -> DataFrame:
    """(product, kind, value) before rare values are folded."""
    pair = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    pairs = F.concat(
        F.array(
            pair("category", X.normalize_constraint(F.col("category"), True)),
            pair("#brand", F.coalesce("brand", F.lit(V.RARE))),
            pair("price", F.col("price_bucket")),
            pair("rating", F.col("rating_bucket")),
            pair("popularity", F.col("popularity_bucket")),
        ),
        F.transform("constraints", lambda c: F.struct(c["attribute"].alias("field"), c["value"].alias("value"))),
        F.transform("constraints", lambda c: F.struct(F.lit("other").alias("field"), c["value"].alias("value"))),
    )
    return profile.select("parent_asin", F.explode(F.array_distinct(pairs)).alias("p")).select(
        "parent_asin", F.col("p.field").alias("field"), F.col("p.value").alias("value")
    )


def item_features(profile: DataFrame, support: DataFrame, min_support: int = 5) -> DataFrame:
    """(product, name): item features; values rare in training fold to ``<rare>``."""
    pairs = item_pairs(profile)
    common = support.filter(F.col("support") >= min_support).select("field", "value", F.lit(True).alias("common"))
    always = F.col("field").isin("price", "rating", "popularity")
    folded = F.when(always | F.col("common"), F.col("value")).otherwise(F.lit(V.RARE))
    field = F.when(F.col("field") == "#brand", "brand").otherwise(F.col("field"))
    return (
        pairs.join(common, ["field", "value"], "left")
        .select("parent_asin", F.concat(F.lit("item:"), field, F.lit("="), folded).alias("name"))
        .distinct()
    )


def product_context_names(profile: DataFrame, support: DataFrame, min_support: int = 5) -> DataFrame:
    """Distinct context names products can give rise to, rare values folded."""
    pair = lambda f, v: F.struct(f.alias("field"), v.alias("value"))
    pairs = F.concat(
        F.array(pair(F.lit("category"), X.normalize_constraint(F.col("category"), True))),
        F.transform("constraints", lambda c: pair(c["attribute"], c["value"])),
        F.transform("constraints", lambda c: pair(F.lit("other"), c["value"])),
    )
    rows = profile.select(F.explode(pairs).alias("p")).select("p.field", "p.value").distinct()
    common = support.filter(F.col("support") >= min_support).select("field", "value", F.lit(True).alias("common"))
    folded = F.when(F.col("common"), F.col("value")).otherwise(F.lit(V.RARE))
    return rows.join(common, ["field", "value"], "left").select(
        F.concat(F.lit("ctx:"), F.col("field"), F.lit("="), folded).alias("name")
    ).distinct()


def fit_vocabulary(
    profile: DataFrame, split: Column, min_support: int = 5, dual: bool = True
) -> DataFrame:
    """(side, name, feature_id): dense ids in name order per side."""
    spark = profile.sparkSession
    support = train_support(profile, split)
    fixed = [
        *[("context", f"ctx:scenario={s}") for s in V.SCENARIO_STATES],
        *[("context", f"ctx:turn={t}") for t in ("early", "middle", "late")],
        ("context", "ctx:override=pre"), ("context", "ctx:override=post"),
        *[(side, f"{p}:{a}={V.RARE}") for side, p in (("context", "ctx"), ("item", "item")) for a in V.ASK_ATTRIBUTES],
    ]
    if dual:
        fixed.append(("context", "ctx:answer_source=other"))
    names = (
        product_context_names(profile, support, min_support).select(F.lit("context").alias("side"), "name")
        .unionByName(item_features(profile, support, min_support).select(F.lit("item").alias("side"), "name"))
        .unionByName(spark.createDataFrame(fixed, "side string, name string"))
        .distinct()
    )
    # Ids follow name order.  Blocks are ranges of it cut at sampled names, so no task has to number
    # a whole side, or all values of a field.
    ranked = numbered(ranged(names, ["side", "name"]), ["side"], [F.col("name")], F.col("range"), "n")
    return ranked.select("side", "name", (F.col("n") - 1).alias("feature_id"))


def vocab_map(names: DataFrame, vocab: DataFrame, key: list[str]) -> DataFrame:
    """Map (key, name) to distinct feature ids.

    An unknown ``field=value`` falls back to ``field=<rare>``; an unknown name
    without ``=`` is dropped.
    """
    exact = vocab.select(F.col("name"), F.col("feature_id").alias("exact_id"))
    rare = vocab.filter(F.col("name").endswith(f"={V.RARE}")).select(
        F.col("name").alias("rare_name"), F.col("feature_id").alias("rare_id")
    )
    fallback = F.when(
        F.col("name").contains("="),
        F.concat(F.substring_index("name", "=", 1), F.lit(f"={V.RARE}")),
    )
    return (
        names.withColumn("rare_name", fallback)
        .join(exact, "name", "left")
        .join(rare, "rare_name", "left")
        .select(*key, F.coalesce("exact_id", "rare_id").alias("feature_id"))
        .filter(F.col("feature_id").isNotNull())
        .distinct()
    )


def semantic_query_text(
    fragments: Column, category: Column, category_alternatives: Column, known: Column
) -> Column:
    """Positive search text of a state: safe fragments, category, typed values."""
    alternatives = F.transform(
        category_alternatives, lambda v: F.concat(F.lit("product category alternative "), v)
    )
    named = F.when(
        category.isNotNull() & (category != "") & (category != V.DEFAULT_CATEGORY),
        F.array(F.concat(F.lit("product category "), category)),
    ).otherwise(F.array().cast(EMPTY))
    order = ("use_case", "feature", "style", "material", "color", "brand", "size", "budget")

    def described(attribute: str) -> Column:
        kept = F.filter(known, lambda k: k["attribute"] == attribute)
        if attribute == "budget":  # numeric ceilings are enforced, not searched
            kept = F.filter(kept, lambda k: ~k["value"].startswith("maximum $"))
        return F.transform(
            kept, lambda k: F.concat(F.lit(attribute.replace("_", " ") + " "), k["value"])
        )

    typed = F.flatten(F.array(*[described(attribute) for attribute in order]))
    middle = F.when(F.size(category_alternatives) > 0, alternatives).otherwise(named)
    parts = F.filter(F.concat(fragments, middle, typed), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(F.array_distinct(parts), " | ")


def eligible_crosses(
    positives: DataFrame, contexts: DataFrame, items: DataFrame, min_support: int = 20
) -> DataFrame:
    """Feature pairs seen together often enough to deserve a weight of their own.

    ``positives``: (context_key, parent_asin, n).  Pairs are folded to (context
    feature, product) counts before item features multiply them.  Only contexts
    about attributes count, rare names never do.
    """
    fields = "|".join(V.ASK_ATTRIBUTES)
    allowed = F.filter(
        "features", lambda f: f.rlike(f"^ctx:({fields})=") & ~f.contains(V.RARE)
    )
    sides = positives.join(contexts.select("context_key", allowed.alias("c")), "context_key")
    by_product = (
        sides.select("parent_asin", "n", F.explode("c").alias("context_feature"))
        .groupBy("context_feature", "parent_asin").agg(F.sum("n").alias("n"))
    )
    exposure = by_product.groupBy("context_feature").agg(F.sum("n").alias("context_exposure"))
    named = items.select("parent_asin", F.filter("features", lambda f: ~f.contains(V.RARE)).alias("i"))
    counted = (
        by_product.join(named, "parent_asin")
        .select("context_feature", "n", F.explode("i").alias("item_feature"))
        .groupBy("context_feature", "item_feature").agg(F.sum("n").alias("positive_support"))
        .filter(F.col("positive_support") >= min_support)
    )
    return counted.join(exposure.filter(F.col("context_exposure") >= min_support), "context_feature").select(
        "context_feature", "item_feature", "positive_support", "context_exposure"
    )


def cross_audit(crosses: DataFrame) -> DataFrame:
    """Crosses with their field pair, supports and weight, heaviest first."""
    field = lambda c: F.regexp_extract(c, r"^[^:]+:([^=]*)", 1)
    return crosses.select(
        "context_feature", "item_feature",
        F.concat(field("context_feature"), F.lit("×"), field("item_feature")).alias("field_pair"),
        "positive_support", "context_exposure", F.col("weight").alias("learned_weight"),
        F.abs("weight").alias("absolute_weight"),
    ).orderBy(F.desc("absolute_weight"), "context_feature", "item_feature")
