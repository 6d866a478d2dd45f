"""Scans, checks, sinks, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetloom.functions import scalars as S
from facetloom.functions import text as X
from facetloom.functions import vocab as V
from facetloom.operators import catalog as C
from facetloom.operators import checks, features
from facetloom.plans import oracle as O
from facetloom.plans.registry import query
from facetloom.session import scratch_path
from facetloom.sources import sinks
from facetloom.sources.catalog import read_catalog
from facetloom.sources.tables import Tables, product_id


@query(
    "read_catalog",
    O.with_views(
        "prod",
        """SELECT parent_asin, title, array_to_string(features, '|') AS features, array_to_string(categories, '|') AS categories,
  array_to_string(detail_items, '|') AS details, store, price, coalesce(price::VARCHAR, 'ask') AS price_text,
  average_rating, rating_number FROM prod""",
    ),
    raw=True,
)
def q_read_catalog(t: Tables):
    common = ["title", "features", "details", "categories", "store"]
    rating = ["average_rating", "rating_number"]
    padded = F.concat(F.lit(" "), F.col("parent_asin")).alias("parent_asin")
    priced = F.to_json(F.struct(padded, *common, F.col("price"), *rating))
    unpriced = F.to_json(F.struct(padded, *common, F.lit("ask").alias("price"), *rating))
    line = F.when(F.col("price").isNull(), F.concat(unpriced, F.lit("\n"))).otherwise(priced)
    path = scratch_path(t.spark, "catalog-json")
    t.catalog.select(line.alias("value")).write.text(path)
    return read_catalog(t.spark, path).select(
        "parent_asin", "title", F.array_join("features", "|").alias("features"),
        F.array_join("categories", "|").alias("categories"),
        F.array_join(X.flatten_map(F.col("details")), "|").alias("details"),
        "store", "price", "price_text", *rating,
    )


@query(
    "catalog_violations",
    """SELECT CASE WHEN id = '' THEN 'missing_id' ELSE 'duplicate_id' END AS kind, id AS parent_asin, count(*) AS n
FROM (SELECT CASE WHEN l_discount > 0 THEN 'P' || lpad(l_orderkey::VARCHAR, 8, '0') ELSE '' END AS id FROM lineitem)
GROUP BY id HAVING id = '' OR count(*) > 1""",
)
def q_catalog_violations(t: Tables):
    ids = F.when(F.col("l_discount") > 0, product_id(F.col("l_orderkey"))).otherwise(F.lit(" "))
    return checks.catalog_violations(t.table("lineitem").select(ids.alias("parent_asin")))


@query(
    "index_coverage",
    O.with_views(
        "prod",
        """, idx AS (SELECT DISTINCT 'P' || lpad((l_partkey + l_suppkey)::VARCHAR, 8, '0') AS parent_asin FROM lineitem)
SELECT 'index' AS side, parent_asin FROM idx ANTI JOIN prod USING (parent_asin)
UNION ALL SELECT 'catalog', parent_asin FROM prod ANTI JOIN idx USING (parent_asin)""",
    ),
)
def q_index_coverage(t: Tables):
    index = t.table("lineitem").select(product_id(F.col("l_partkey") + F.col("l_suppkey")).alias("parent_asin"))
    return checks.index_coverage(index, t.catalog).select("side", "parent_asin")


@query(
    "vector_check",
    """SELECT 'not_finite' AS "check", count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS n_bad FROM embeddings
UNION ALL SELECT 'not_unit', count(*) FILTER (abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 0.02) FROM embeddings
UNION ALL SELECT 'duplicate_id', (SELECT count(*) FROM (SELECT vec_id FROM embeddings GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'mixed_dimension', (max(len(embedding)) > min(len(embedding)))::BIGINT FROM embeddings""",
)
def q_vector_check(t: Tables):
    return checks.vector_check(t.vectors, "id", "vector")


@query(
    "index_stats",
    O.with_views(
        "facts nodes",
        """SELECT 'products' AS key, count(*) AS value FROM prod UNION ALL SELECT 'coarse_categories', count(DISTINCT category) FROM prod_cons
UNION ALL SELECT 'uncategorized_products', count(*) FILTER (len(categories) = 0) FROM prod UNION ALL SELECT 'categories', count(*) FROM nodes
UNION ALL SELECT attribute || '_rows', count(*) FROM facts GROUP BY attribute""",
    ),
)
def q_index_stats(t: Tables):
    return checks.index_stats(t.products, t.nodes, t.facts)


DOCUMENT_SQL = (
    "substr('Title: ' || title || ' | Category: ' || array_to_string(categories, ' > ') || ' | Brand: ' || store || "
    "' | Features: ' || array_to_string(features[1:2], ' '), 1, 300)"
)


@query(
    "content_fingerprint",
    O.with_views(
        "prod",
        f""", h AS (SELECT sha256(parent_asin || chr(0) || {DOCUMENT_SQL} || chr(10)) AS h FROM prod),
w AS (SELECT count(*) AS n, {", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::HUGEINT) AS w{i}" for i in range(8))} FROM h)
SELECT n, sha256(concat_ws(':', n, {", ".join(f"w{i}" for i in range(8))})) AS digest FROM w""",
    ),
)
def q_content_fingerprint(t: Tables):
    docs = t.catalog.select("parent_asin", X.product_document().alias("document"))
    return checks.content_fingerprint(docs, "parent_asin", "document")


@query("write_tables", O.with_views("facts", "SELECT attribute, count(*) AS n, count(DISTINCT normalized_value) AS n_values FROM facts GROUP BY 1"))
def q_write_tables(t: Tables):
    path = scratch_path(t.spark, "facts")
    sinks.write_facts(t.facts, path)
    return t.spark.read.parquet(path).groupBy("attribute").agg(
        F.count("*").alias("n"), F.count_distinct("normalized_value").alias("n_values")
    )


@query("write_audit_csv", O.with_views("nodes", "SELECT full_path, product_count, depth FROM nodes"))
def q_write_audit_csv(t: Tables):
    path = scratch_path(t.spark, "audit")
    report = t.nodes.select("full_path", "product_count", "depth")
    sinks.write_audit_csv(report, path, [F.desc("product_count"), "full_path"])
    return t.spark.read.schema("full_path string, product_count bigint, depth bigint").option("header", True).csv(path)


@query(
    "flatten_field",
    O.with_views(
        "prod",
        """SELECT parent_asin, array_to_string(features, '|') AS features, array_to_string(detail_items, '|') AS details,
  CASE WHEN store IS NULL OR store = '' THEN 0 ELSE 1 END AS n_store, 0 AS n_description FROM prod""",
    ),
)
def q_flatten_field(t: Tables):
    return t.catalog.select(
        "parent_asin",
        F.array_join(X.flatten_list(F.col("features")), "|").alias("features"),
        F.array_join(X.flatten_map(F.col("details")), "|").alias("details"),
        F.size(X.flatten_scalar(F.col("store"))).alias("n_store"),
        F.size(X.flatten_list(F.col("description"))).alias("n_description"),
    )


@query(
    "clean_text",
    f"SELECT doc_id, {O.clean('text')} AS cleaned, {O.clean('text', None)} AS unlimited FROM documents",
)
def q_clean_text(t: Tables):
    text = F.col("text")
    return t.documents.select(
        "doc_id", X.clean_text(text).alias("cleaned"), X.clean_text(text, None).alias("unlimited")
    )


@query(
    "normalize_value",
    f"SELECT doc_id, replace({O.norm('text')}, 'ß', 'ss') AS normalized FROM documents",
)
def q_normalize_value(t: Tables):
    return t.documents.select("doc_id", X.normalize_value(F.col("text"), unicode=True).alias("normalized"))


@query(
    "searchable_text",
    O.with_views(
        "prod_tags",
        """SELECT parent_asin, corpus, array_to_string(list_concat([title], features, ['Department ' || p_type, 'Brand ' || p_brand], categories, [store]), ' ') AS evaluator
FROM prod_tags""",
    ),
)
def q_searchable_text(t: Tables):
    return t.catalog.select(
        "parent_asin", X.searchable_text().alias("corpus"), X.evaluator_text().alias("evaluator")
    )


@query("product_document", O.with_views("prod", f"SELECT parent_asin, {DOCUMENT_SQL} AS document, substr({DOCUMENT_SQL}, 1, 40) AS short FROM prod"))
def q_product_document(t: Tables):
    return t.catalog.select(
        "parent_asin", X.product_document().alias("document"), X.product_document(40).alias("short")
    )


@query("coarse_category", O.with_views("prod_cons", "SELECT parent_asin, category AS coarse_category FROM prod_cons"), raw=True)
def q_coarse_category(t: Tables):
    return C.product_categories(t.catalog)


@query("category_prefixes", O.with_views("bridge", "SELECT parent_asin, name, full_path, parent_path, position, is_leaf FROM bridge"), raw=True)
def q_category_prefixes(t: Tables):
    return t.bridge


@query(
    "classify_constraint",
    O.with_views(
        "prod_all",
        f"""SELECT parent_asin, c AS display, {O.classify('c')} AS conversation_type, {O.classify('c', V.COLORS)} AS catalog_type
FROM (SELECT parent_asin, unnest(all_constraints) AS c FROM prod_all)""",
    ),
)
def q_classify_constraint(t: Tables):
    rows = C.with_disclosed(t.catalog).select("parent_asin", F.explode("disclosed").alias("display"))
    return rows.select(
        "parent_asin", "display",
        X.classify_constraint(F.col("display")).alias("conversation_type"),
        X.classify_constraint(F.col("display"), V.COLORS).alias("catalog_type"),
    )


@query(
    "regex_tags",
    O.with_views(
        "prod_tags",
        f"""SELECT parent_asin, array_to_string(mats, '|') AS materials, array_to_string({O.dedup('cols')}, '|') AS colors,
  mats[1] AS first_material, cols[1] AS first_color FROM prod_tags""",
    ),
)
def q_regex_tags(t: Tables):
    rows = t.catalog.withColumn("corpus", X.searchable_text())
    materials = X.word_tags(F.col("corpus"), V.MATERIALS)
    colors = X.word_tags(F.col("corpus"), V.COLORS)
    return rows.select(
        "parent_asin", F.array_join(materials, "|").alias("materials"),
        F.array_join(F.array_distinct(colors), "|").alias("colors"),
        F.get(materials, F.lit(0)).alias("first_material"),
        F.get(colors, F.lit(0)).alias("first_color"),
    )


@query("attribute_facts", O.with_views("facts", "SELECT attribute, normalized_value, parent_asin, display_value, ordinal FROM facts"), raw=True)
def q_attribute_facts(t: Tables):
    return t.facts


@query(
    "intent_card",
    O.with_views(
        "prod_all",
        """SELECT parent_asin, title AS target_category, array_to_string(c[1:2], '|') AS hard, array_to_string(CASE WHEN len(c) > 2 THEN c[3:4] ELSE c[1:1] END, '|') AS soft
FROM (SELECT *, CASE WHEN len(all_constraints) = 0 THEN [title] ELSE all_constraints END AS c FROM prod_all)""",
    ),
)
def q_intent_card(t: Tables):
    cards = C.intent_card(t.catalog)
    return cards.select(
        "parent_asin", "target_category", F.array_join("hard_constraints", "|").alias("hard"),
        F.array_join("soft_preferences", "|").alias("soft"),
    )


@query(
    "bucketize",
    f"""SELECT 'order' AS source, o_orderkey AS id, {O.price_bucket('o_totalprice / 1000')} AS price, {O.rating_bucket('floor(o_totalprice / 100) / 1000')} AS rating,
  {O.popularity_bucket('floor(o_totalprice)::BIGINT')} AS popularity, {O.turn_bucket('o_orderkey % 11')} AS turn,
  CASE WHEN o_orderkey % 300 <= 10 THEN '<=10' WHEN o_orderkey % 300 <= 50 THEN '11-50' WHEN o_orderkey % 300 <= 200 THEN '51-200' ELSE '>200' END AS width FROM orders
UNION ALL SELECT 'event', event_id, {O.price_bucket('value')}, {O.rating_bucket('value / 4')}, {O.popularity_bucket('floor(value)::BIGINT')},
  {O.turn_bucket('user_id % 11')}, CASE WHEN user_id <= 10 THEN '<=10' WHEN user_id <= 50 THEN '11-50' WHEN user_id <= 200 THEN '51-200' ELSE '>200' END FROM events""",
)
def q_bucketize(t: Tables):
    def buckets(df, source, id_, price, rating, count, turn, width):
        return df.select(
            F.lit(source).alias("source"), F.col(id_).alias("id"),
            S.price_bucket(price).alias("price"), S.rating_bucket(rating).alias("rating"),
            S.popularity_bucket(count).alias("popularity"), S.turn_bucket(turn).alias("turn"),
            S.width_bucket(width).alias("width"),
        )

    total, key, value = F.col("o_totalprice"), F.col("o_orderkey"), F.col("value")
    orders = buckets(
        t.table("orders"), "order", "o_orderkey", total / 1000, F.floor(total / 100) / 1000,
        F.floor(total), F.pmod(key, F.lit(11)), F.pmod(key, F.lit(300)),
    )
    events = buckets(
        t.table("events"), "event", "event_id", value, value / 4, F.floor(value),
        F.pmod("user_id", F.lit(11)), F.col("user_id"),
    )
    return orders.unionByName(events)


@query(
    "stable_hash",
    f"SELECT o_orderkey, sha256('order' || chr(0) || o_orderkey) AS hash, ({O.stable_int(chr(39) + 'order' + chr(39), 'o_orderkey')})::VARCHAR AS number FROM orders",
)
def q_stable_hash(t: Tables):
    parts = (F.lit("order"), F.col("o_orderkey").cast("string"))
    return t.table("orders").select(
        "o_orderkey", S.stable_hash(*parts).alias("hash"), S.stable_int(*parts).cast("string").alias("number")
    )


SPLIT_SQL = (
    "CASE WHEN {0} < 8 THEN 'train' WHEN {0} = 8 THEN 'validation' ELSE 'test' END".format(
        "(" + O.stable_int("'split'", "'2026'", "parent_asin") + " % 10)"
    )
)


@query("hash_split", O.with_views("prod", f"SELECT parent_asin, {SPLIT_SQL} AS split FROM prod"))
def q_hash_split(t: Tables):
    return t.catalog.select("parent_asin", S.hash_split(F.col("parent_asin")).alias("split"))


def tokens_sql(c: str, limit: int = 16) -> str:
    found = f"regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"
    kept = (
        f"list_filter({found}, lambda t: t NOT IN ({O.quoted(V.QUERY_STOPWORDS)}) "
        "AND (length(t) >= 2 OR regexp_matches(t, '^\\p{N}$')))"
    )
    return f"list_slice({O.dedup(kept)}, 1, {limit})"


@query(
    "query_tokens",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
f AS (SELECT doc_id, w, min(i) AS i FROM e WHERE w NOT IN ({O.quoted(V.QUERY_STOPWORDS)}) AND (length(w) >= 2 OR regexp_matches(w, '^\\p{{N}}$')) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
SELECT doc_id, coalesce(t.tokens, '') AS tokens FROM documents LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS tokens FROM r WHERE n <= 16 GROUP BY 1) t USING (doc_id)""",
)
def q_query_tokens(t: Tables):
    return t.documents.select(
        "doc_id", F.array_join(X.query_tokens(F.col("text"), unicode=True), " ").alias("tokens")
    )


def asked_known():
    """Third and later constraints count as answers to the open question."""
    return F.transform(
        "known",
        lambda k, i: F.struct(
            F.when(i >= 2, "other").otherwise(k["attribute"]).alias("attribute"),
            k["value"].alias("value"), k["display"].alias("display"),
        ),
    )


ASKED_SQL = (
    "list_transform(known, lambda k, i: {'attribute': CASE WHEN i > 2 THEN 'other' ELSE k.attribute END, "
    "'value': k.value, 'display': k.display})"
)
ORDERED_SQL = (
    "flatten(list_transform(list_sort(list_distinct(list_transform(asked, lambda k: k.attribute))), "
    "lambda a: list_filter(asked, lambda k: k.attribute = a)))"
)
HEAD_SQL = (
    f"['ctx:category=' || lower(category), 'ctx:scenario=' || scenario, 'ctx:turn=' || {O.turn_bucket('turn')}, "
    "CASE WHEN scenario = 'intent_override' AND turn >= 3 THEN 'ctx:override=post' ELSE 'ctx:override=pre' END]"
)
DUAL_SQL = (
    f"flatten(list_transform({ORDERED_SQL}, lambda k: CASE WHEN k.attribute = 'other' THEN "
    f"['ctx:answer_source=other', 'ctx:other=' || {O.norm(O.clean('k.display', None))}, 'ctx:' || ({O.classify('k.display')}) || '=' || {O.norm(O.clean('k.display', None))}] "
    f"ELSE ['ctx:' || k.attribute || '=' || {O.norm(O.clean('k.display', None))}] END))"
)
LEGACY_SQL = f"list_transform({ORDERED_SQL}, lambda k: 'ctx:' || k.attribute || '=' || {O.norm('k.display')})"
CONTEXT_SQL = (
    f"ctx AS MATERIALIZED (SELECT session_id, turn, scenario, target, category, {O.dedup('names')} AS names, {O.dedup('legacy')} AS legacy FROM ("
    f"SELECT *, list_concat({HEAD_SQL}, {DUAL_SQL}) AS names, list_concat({HEAD_SQL}, {LEGACY_SQL}) AS legacy FROM ("
    f"SELECT *, {ASKED_SQL} AS asked FROM states)))"
)


def state_context(t: Tables, mode: str = "dual"):
    override = (F.col("scenario") == "intent_override") & (F.col("turn") >= 3)
    return features.context_names(
        F.col("category"), F.col("scenario"), F.col("turn"), override, asked_known(), mode
    )


@query(
    "context_features",
    O.with_views(
        "states",
        f""", {CONTEXT_SQL} SELECT session_id, turn, array_to_string(names, '|') AS names, array_to_string(legacy, '|') AS legacy FROM ctx""",
    ),
)
def q_context_features(t: Tables):
    texts = t.situations.select(
        "kind", "scenario", "turn",
        F.array_join(state_context(t), "|").alias("names"),
        F.array_join(state_context(t, "legacy"), "|").alias("legacy"),
    )
    return t.per_situation(texts, "names", "legacy").select("session_id", "turn", "names", "legacy")


SUPPORT_SQL = f"""psplit AS (SELECT *, {SPLIT_SQL} AS split FROM profile),
pvals AS (SELECT parent_asin, split, 'category' AS field, lower(category) AS value FROM psplit
  UNION SELECT parent_asin, split, c.attribute, c.value FROM (SELECT parent_asin, split, unnest(constraints) AS c FROM psplit)
  UNION SELECT parent_asin, split, 'other', c.value FROM (SELECT parent_asin, split, unnest(constraints) AS c FROM psplit)
  UNION SELECT parent_asin, split, '#brand', brand FROM psplit WHERE brand IS NOT NULL),
support AS (SELECT field, value, count(*) AS support FROM pvals WHERE split = 'train' GROUP BY 1, 2)"""
ITEM_SQL = f"""{SUPPORT_SQL},
items AS (SELECT DISTINCT parent_asin, 'item:' || CASE WHEN field = '#brand' THEN 'brand' ELSE field END || '=' ||
    CASE WHEN s.support >= 5 THEN p.value ELSE '{V.RARE}' END AS name FROM pvals p LEFT JOIN support s USING (field, value)
  UNION SELECT parent_asin, 'item:price=' || price_bucket FROM profile
  UNION SELECT parent_asin, 'item:rating=' || rating_bucket FROM profile
  UNION SELECT parent_asin, 'item:popularity=' || popularity_bucket FROM profile)"""


@query("item_features", O.with_views("profile", f", {ITEM_SQL} SELECT parent_asin, name FROM items"))
def q_item_features(t: Tables):
    support = features.train_support(t.profile, S.hash_split(F.col("parent_asin")))
    return features.item_features(t.profile, support)


@query(
    "semantic_query_text",
    O.with_views(
        "states messages",
        f""", q AS (SELECT s.session_id, s.turn, s.category, s.known, CASE WHEN length(m.text) >= 3 AND NOT regexp_matches(m.text, '{V.SEMANTIC_OPERATORS.replace(chr(39), chr(39) * 2)}') THEN m.text END AS fragment
  FROM states s JOIN messages m USING (session_id, turn)),
p AS (SELECT *, list_concat(CASE WHEN fragment IS NULL THEN [] ELSE [fragment] END, ['product category ' || category],
  """
        + ", ".join(
            f"list_transform(list_filter(known, lambda k: k.attribute = '{a}'), lambda k: '{a.replace('_', ' ')} ' || k.value)"
            for a in ("use_case", "feature", "style", "material", "color", "brand", "size", "budget")
        )
        + f""") AS parts FROM q)
SELECT session_id, turn, array_to_string({O.dedup('parts')}, ' | ') AS query FROM p""",
    ),
)
def q_semantic_query_text(t: Tables):
    rows = t.states.join(t.messages.select("session_id", "turn", "text"), ["session_id", "turn"])
    fragment = X.semantic_fragment(F.col("text"))
    fragments = F.array_compact(F.array(fragment))
    none = F.array().cast("array<string>")
    return rows.select(
        "session_id", "turn",
        features.semantic_query_text(fragments, F.col("category"), none, F.col("known")).alias("query"),
    )
