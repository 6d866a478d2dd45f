"""Facet lookups, candidate sets, set operations and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetloom.functions import scalars as S
from facetloom.functions import text as X
from facetloom.functions import vocab as V
from facetloom.operators import candidates as K
from facetloom.operators import catalog as C
from facetloom.operators import facets
from facetloom.plans import oracle as O
from facetloom.plans.registry import query
from facetloom.session import spread_join
from facetloom.sources.tables import Tables


@query(
    "facet_lookup",
    O.with_views(
        "facts",
        """SELECT attribute, normalized_value, parent_asin, false AS first_50 FROM facts WHERE attribute IN ('material', 'color')
UNION ALL SELECT 'material', 'cotton', parent_asin, true FROM (SELECT parent_asin FROM facts WHERE attribute = 'material' AND normalized_value = 'cotton' ORDER BY parent_asin LIMIT 50)""",
    ),
)
def q_facet_lookup(t: Tables):
    lookups = t.facts.filter(F.col("attribute").isin("material", "color")).select("attribute", "normalized_value").distinct()
    many = facets.facet_lookup_many(t.facts, lookups).withColumn("first_50", F.lit(False))
    one = facets.facet_lookup(t.facts, "material", "Cotton", 50).select(
        F.lit("material").alias("attribute"), F.lit("cotton").alias("normalized_value"), "parent_asin",
        F.lit(True).alias("first_50"),
    )
    return many.unionByName(one)


@query(
    "values_for_product",
    O.with_views(
        "facts sess",
        """SELECT parent_asin, string_agg(display_value, '|' ORDER BY ordinal) AS "values" FROM facts
WHERE attribute = 'other' AND parent_asin IN (SELECT target FROM sess) GROUP BY 1""",
    ),
)
def q_values_for_product(t: Tables):
    ids = t.sessions.select(F.col("target").alias("parent_asin"))
    found = facets.values_for_product(t.facts, ids, "other")
    return found.select("parent_asin", F.array_join("values", "|").alias("values"))


@query("price_between", O.with_views("prod", "SELECT parent_asin, price FROM prod WHERE price BETWEEN 905 AND 980 ORDER BY price, parent_asin LIMIT 500"))
def q_price_between(t: Tables):
    return facets.price_between(t.products, 980, 905, 500)


def category_pool(t: Tables):
    """Each coarse category as a state whose candidates are its products."""
    return t.products.select(F.col("coarse_category").alias("state_key"), "parent_asin")


def category_states(t: Tables):
    return t.products.select(F.col("coarse_category").alias("state_key")).distinct()


@query(
    "price_ceiling",
    O.with_views(
        "prod_cons",
        """SELECT category AS state_key, parent_asin FROM prod_cons
WHERE CASE WHEN length(category) % 2 = 0 THEN price <= 900 + 4 * length(category) ELSE price < 900 + 4 * length(category) END""",
    ),
)
def q_price_ceiling(t: Tables):
    size = F.char_length("state_key")
    ceilings = category_states(t).select(
        "state_key", (900 + 4 * size).cast("double").alias("max_price"), (size % 2 == 0).alias("inclusive")
    )
    return facets.price_ceiling(category_pool(t), t.products, ceilings, "state_key")


@query(
    "facet_filter",
    O.with_views(
        "facts",
        """SELECT parent_asin FROM prod p WHERE price >= 900.5 AND price < 995
AND EXISTS (SELECT 1 FROM facts f WHERE f.parent_asin = p.parent_asin AND attribute = 'material' AND normalized_value IN ('cotton', 'wool'))
AND EXISTS (SELECT 1 FROM facts f WHERE f.parent_asin = p.parent_asin AND attribute = 'color' AND normalized_value IN ('red', 'blue'))
ORDER BY parent_asin LIMIT 1000""",
    ),
)
def q_facet_filter(t: Tables):
    wanted = {"material": ["Cotton", "wool"], "color": ("red", "BLUE")}
    return facets.facet_filter(t.products, t.facts, wanted, 900.5, 995, 1000)


@query("category_lookup", O.with_views("nodes", "SELECT name, full_path, depth, product_count FROM nodes WHERE normalized_name = 'ring'"))
def q_category_lookup(t: Tables):
    return facets.category_lookup(t.nodes, " Ring ")


@query(
    "category_products",
    O.with_views(
        "bridge",
        """SELECT 'node' AS kind, parent_asin FROM bridge WHERE full_path = 'Parts > LARGE'
UNION ALL SELECT 'leaf', parent_asin FROM bridge WHERE full_path = 'Parts > LARGE > bolt' AND is_leaf""",
    ),
)
def q_category_products(t: Tables):
    node = facets.category_products(t.bridge, "Parts > LARGE").select(F.lit("node").alias("kind"), "parent_asin")
    leaf = facets.category_products(t.bridge, "Parts > LARGE > bolt", leaf_only=True)
    return node.unionByName(leaf.select(F.lit("leaf").alias("kind"), "parent_asin"))


@query(
    "coarse_category_products",
    O.with_views(
        "states",
        """, named AS (SELECT CASE WHEN scenario = 'boundary' THEN 'no such shelf' ELSE category END AS category, count(*) AS n_sessions FROM states WHERE turn = 1 GROUP BY 1),
pools AS (SELECT *, CASE WHEN category IN (SELECT category FROM profile) THEN category WHEN 'clothing item' IN (SELECT category FROM profile) THEN 'clothing item' ELSE '*' END AS pool FROM named)
SELECT pools.category, pool, n_sessions, parent_asin FROM pools JOIN profile p ON p.category = pool OR pool = '*'""",
    ),
)
def q_coarse_category_products(t: Tables):
    """All members of each named category; sessions that name the same one share its rows."""
    named = t.session_profiles.select(
        F.when(F.col("scenario") == "boundary", "no such shelf").otherwise(F.col("category")).alias("category")
    ).groupBy("category").agg(F.count("*").alias("n_sessions"))
    pools = facets.resolve_pools(named, t.products)
    return spread_join(facets.pool_members(t.products), pools, ["pool"], ["parent_asin"]).select(
        "category", "pool", "n_sessions", "parent_asin"
    )


def target_table(t: Tables):
    """The fixed label table, plus one label per leaf name restricted to MEDIUM paths."""
    rows = [(label, list(names), list(terms)) for label, (names, terms) in V.CATEGORY_TARGETS.items()]
    fixed = t.spark.createDataFrame(rows, "label string, names array<string>, terms array<string>")
    leaves = t.nodes.filter(F.col("depth") == 2).select("name").distinct().select(
        F.concat(F.lit("medium "), "name").alias("label"), F.array("name").alias("names"),
        F.array(F.lit("Medium")).alias("terms"),
    )
    return fixed.unionByName(leaves)


@query(
    "category_name_products",
    O.with_views("bridge", "SELECT DISTINCT 'medium ' || name AS label, parent_asin FROM bridge WHERE position = 2 AND contains(lower(full_path), 'medium')"),
)
def q_category_name_products(t: Tables):
    return facets.category_name_products(t.bridge, t.nodes, target_table(t))


@query(
    "product_category_path",
    O.with_views(
        "bridge prod_cons sess",
        """SELECT p.parent_asin, category AS coarse_category, paths FROM prod_cons p JOIN (SELECT parent_asin, string_agg(full_path, '|' ORDER BY position) AS paths FROM bridge GROUP BY 1) USING (parent_asin)
WHERE p.parent_asin IN (SELECT target FROM sess)""",
    ),
)
def q_product_category_path(t: Tables):
    ids = t.sessions.select(F.col("target").alias("parent_asin")).distinct()
    found = C.product_category_path(t.bridge, t.products.select("parent_asin", "coarse_category"), ids)
    return found.select("parent_asin", "coarse_category", F.array_join("paths", "|").alias("paths"))


@query(
    "semantic_text_guard",
    O.with_views(
        "messages",
        f"""SELECT session_id, turn, CASE WHEN length(trim(text)) >= 3 AND NOT regexp_matches(text, '{V.SEMANTIC_OPERATORS.replace(chr(39), chr(39) * 2)}') THEN trim(text) END AS fragment FROM messages""",
    ),
)
def q_semantic_text_guard(t: Tables):
    return t.messages.select("session_id", "turn", X.semantic_fragment(F.col("text")).alias("fragment"))


@query(
    "category_bridge_join",
    O.with_views("nodes", "SELECT b.parent_asin, full_path, b.position, is_leaf, n.name, n.product_count FROM bridge b JOIN nodes n USING (full_path)"),
)
def q_category_bridge_join(t: Tables):
    return C.category_bridge_join(t.bridge, t.nodes).select(
        "parent_asin", "full_path", "position", "is_leaf", "name", "product_count"
    )


def wanted_states(t: Tables):
    """Session turns with a shared state key; boundary sessions may end with a guess."""
    known = F.transform("known", lambda k: K.token(F.lit("other"), k["value"]))
    guess = F.array(F.concat(F.lit("other=size "), F.pmod("session_id", F.lit(60)).cast("string")))
    guessed = (F.col("scenario") == "boundary") & (F.col("turn") == 4)
    return with_wanted(t.states, F.when(guessed, F.concat(known, guess)).otherwise(known))


def with_wanted(rows, tokens):
    wanted = F.array_sort(F.array_distinct(tokens))
    return rows.withColumn("wanted", wanted).withColumn("pool", F.col("category")).withColumn(
        "state_key", S.stable_hash(F.col("pool"), F.array_join("wanted", "\x01"))
    )


def plain_situations(t: Tables):
    """Situations with the state key of what they know."""
    return with_wanted(t.situations, F.transform("known", lambda k: K.token(F.lit("other"), k["value"])))


def other_members(t: Tables):
    tokens = K.product_tokens(t.facts, ("other",))
    return K.members(t.products.select(F.col("coarse_category").alias("pool"), "parent_asin"), tokens), tokens


WANTED_SQL = """st AS MATERIALIZED (SELECT *, list_sort(list_distinct(list_concat(list_transform(known, lambda k: 'other=' || k.value),
  CASE WHEN scenario = 'boundary' AND turn = 4 THEN ['other=size ' || (session_id % 60)] ELSE [] END))) AS wanted FROM states),
tok AS MATERIALIZED (SELECT parent_asin, category, list('other=' || normalized_value) AS toks FROM facts JOIN profile USING (parent_asin) WHERE attribute = 'other' GROUP BY 1, 2)"""
PLAIN_SQL = WANTED_SQL.replace("scenario = 'boundary' AND turn = 4", "false")
SURVIVORS_SQL = """d AS MATERIALIZED (SELECT DISTINCT category, wanted FROM st),
surv AS MATERIALIZED (SELECT d.category, d.wanted, t.parent_asin FROM d JOIN tok t ON t.category = d.category AND list_has_all(t.toks, d.wanted))"""


@query(
    "and_intersect_rollback",
    O.with_views(
        "states facts",
        f""", {WANTED_SQL}, {SURVIVORS_SQL},
cnt AS (SELECT category, wanted, count(*) AS n, min(parent_asin) AS first_id, max(parent_asin) AS last_id FROM surv GROUP BY 1, 2),
pool AS (SELECT category, count(*) AS n, min(parent_asin) AS first_id, max(parent_asin) AS last_id FROM profile GROUP BY 1),
vals AS (SELECT list(DISTINCT 'other=' || normalized_value) AS vs FROM facts WHERE attribute = 'other')
SELECT session_id, turn, cnt.n IS NULL AS rolled_back, coalesce(cnt.n, pool.n) AS n_candidates, coalesce(cnt.first_id, pool.first_id) AS first_id,
  coalesce(cnt.last_id, pool.last_id) AS last_id,
  CASE WHEN cnt.n IS NULL THEN array_to_string(CASE WHEN list_has_all(vs, st.wanted) THEN st.wanted ELSE list_filter(st.wanted, lambda w: NOT list_contains(vs, w)) END, '|') END AS rejected
FROM st JOIN pool USING (category) LEFT JOIN cnt ON cnt.category = st.category AND cnt.wanted = st.wanted CROSS JOIN vals""",
    ),
)
def q_and_intersect_rollback(t: Tables):
    rows = wanted_states(t)
    states = rows.select("state_key", "pool", "wanted").distinct()
    members, tokens = other_members(t)
    _, outcome = K.and_intersect_rollback(states, members, tokens)
    outcome = outcome.join(K.pool_summary(members), "pool").select(
        "state_key", "rolled_back",
        F.coalesce("n_survivors", "pool_size").alias("n_candidates"),
        F.coalesce("first_id", "pool_first").alias("first_id"),
        F.coalesce("last_id", "pool_last").alias("last_id"),
        F.array_join("rejected", "|").alias("rejected"),
    )
    return rows.select("session_id", "turn", "state_key").join(outcome, "state_key").drop("state_key")


@query(
    "and_intersect_survivors",
    O.with_views(
        "states facts",
        f""", {WANTED_SQL}, {SURVIVORS_SQL}
SELECT category AS pool, array_to_string(wanted, '|') AS wanted, parent_asin FROM surv WHERE len(wanted) > 0""",
    ),
)
def q_and_intersect_survivors(t: Tables):
    """Every product left by each state that wants something; sessions in the same state share its rows."""
    states = wanted_states(t).select("state_key", "pool", "wanted").distinct()
    members, _ = other_members(t)
    shown = states.select("state_key", "pool", F.array_join("wanted", "|").alias("wanted"))
    return spread_join(K.match_all(states, members), shown, ["state_key"], ["parent_asin"]).drop("state_key")


MATERIAL_OF_SQL = f"([{O.quoted(V.MATERIALS)}])[length(category) % 9 + 1]"


def keyed_material():
    position = (F.pmod(F.char_length("state_key"), F.lit(9)) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(m) for m in V.MATERIALS]), position)


@query(
    "or_union_filter",
    O.with_views(
        "facts",
        f""", c AS (SELECT parent_asin, category, length(category) % 2 = 1 AND EXISTS (SELECT 1 FROM facts f WHERE f.parent_asin = p.parent_asin
  AND attribute = 'material' AND normalized_value = {MATERIAL_OF_SQL}) AS hit FROM prod_cons p)
SELECT category AS state_key, parent_asin FROM c WHERE hit OR category NOT IN (SELECT category FROM c WHERE hit)""",
    ),
)
def q_or_union_filter(t: Tables):
    odd = F.char_length("state_key") % 2 == 1
    values = F.when(odd, F.array(F.lit("plaid"), keyed_material())).otherwise(F.array(F.lit("plaid")))
    alternatives = category_states(t).select(
        "state_key", F.lit("material").alias("attribute"), F.explode(values).alias("normalized_value")
    )
    return K.or_union_filter(category_pool(t), alternatives, t.facts, "state_key")


@query(
    "exclude_values",
    O.with_views(
        "facts",
        f"""SELECT category AS state_key, parent_asin FROM prod_cons p WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.parent_asin = p.parent_asin
  AND ((attribute = 'material' AND normalized_value = {MATERIAL_OF_SQL}) OR (attribute = 'brand' AND normalized_value = 'brand#' || length(category))))""",
    ),
)
def q_exclude_values(t: Tables):
    pair = lambda a, v: F.struct(F.lit(a).alias("attribute"), v.alias("normalized_value"))
    brand = F.concat(F.lit("brand#"), F.char_length("state_key").cast("string"))
    exclusions = category_states(t).select(
        "state_key", F.inline(F.array(pair("material", keyed_material()), pair("brand", brand)))
    )
    return K.exclude_values(category_pool(t), exclusions, t.facts, "state_key")


def free_form_states(t: Tables):
    """Free-form wishes per session, by scenario; equal wishes share a key."""
    none = F.array().cast("array<string>")
    steps = F.array().cast(K.STEP)
    step = lambda a, v: F.struct(F.lit(a).alias("attribute"), v.alias("values"))
    word = F.split_part("category", F.lit(" "), F.lit(2))
    material = F.get(F.filter("constraints", lambda c: c["attribute"] == "material"), F.lit(0))["value"]
    tints = F.array(F.lit("red"), F.lit("blue"))
    is_ = lambda s: F.col("scenario") == s
    has_material = F.when(material.isNotNull(), F.array(step("material", F.array(material)))).otherwise(steps)
    brand = F.concat(F.lit("brand#"), (F.pmod("session_id", F.lit(25)) + 1).cast("string"))
    rows = t.session_profiles.select(
        "session_id",
        F.when(is_("browsing"), F.array_distinct(F.array(word, F.lit("ring")))).otherwise(F.array(word)).alias("labels"),
        F.when(is_("buying"), has_material)
        .when(is_("boundary"), F.concat(has_material, F.array(step("color", tints)))).otherwise(steps).alias("hard"),
        F.when(is_("browsing"), F.array(step("color", tints))).otherwise(steps).alias("alternatives"),
        F.when(
            is_("intent_override"),
            F.array(step("brand", F.array(brand)), step("category", F.array(F.lit("ring")))),
        ).otherwise(steps).alias("excluded"),
        F.when(is_("buying"), 900.5 + 10 * F.pmod("session_id", F.lit(10))).alias("max_price"),
        (F.pmod("session_id", F.lit(2)) == 0).alias("inclusive"),
    )
    described = F.to_json(F.struct("labels", "hard", "alternatives", "excluded", "max_price", "inclusive"))
    return rows.withColumn("state_key", F.sha2(described, 256))


@query(
    "rebuild_candidates",
    O.with_views(
        "sess profile facts",
        """, raw AS (SELECT session_id, scenario, split_part(category, ' ', 2) AS word, session_id AS s,
  list_filter(constraints, lambda c: c.attribute = 'material')[1].value AS mat FROM sess JOIN profile ON parent_asin = target),
st AS MATERIALIZED (SELECT session_id, CASE WHEN scenario = 'browsing' THEN list_distinct([word, 'ring']) ELSE [word] END AS labels,
  CASE WHEN scenario IN ('buying', 'boundary') THEN mat END AS mat, scenario = 'boundary' AS tint_all, scenario = 'browsing' AS tint_any,
  CASE WHEN scenario = 'intent_override' THEN 'brand#' || (s % 25 + 1) END AS no_brand,
  CASE WHEN scenario = 'buying' THEN 900.5 + 10 * (s % 10) END AS max_price, s % 2 = 0 AS inclusive FROM raw),
d AS MATERIALIZED (SELECT DISTINCT labels, mat, tint_all, tint_any, no_brand, max_price, inclusive FROM st),
p AS MATERIALIZED (SELECT parent_asin, categories[3] AS label, any_value(price) AS price,
  list(attribute || '=' || normalized_value) AS toks FROM facts JOIN prod USING (parent_asin) WHERE attribute IN ('material', 'color', 'brand') GROUP BY 1, 2),
j AS (SELECT d.*, p.parent_asin, [d.mat IS NULL OR list_contains(toks, 'material=' || d.mat),
    NOT tint_all OR (list_has_all(toks, ['color=red', 'color=blue'])), NOT tint_any OR list_has_any(toks, ['color=red', 'color=blue']),
    d.no_brand IS NULL OR NOT list_contains(toks, d.no_brand) AND NOT list_contains(toks, 'brand=' || d.no_brand), d.no_brand IS NULL OR label <> 'ring',
    d.max_price IS NULL OR coalesce(CASE WHEN inclusive THEN price <= max_price ELSE price < max_price END, false)] AS ok
  FROM d JOIN p ON list_contains(d.labels, p.label)),
o AS (SELECT labels, mat, tint_all, tint_any, no_brand, max_price, inclusive, count(*) FILTER (NOT list_contains(ok, false)) AS n,
  min(parent_asin) FILTER (NOT list_contains(ok, false)) AS first_id, max(parent_asin) FILTER (NOT list_contains(ok, false)) AS last_id,
  max(coalesce(list_position(ok, false), 0)) AS e FROM j GROUP BY ALL)
SELECT session_id, n, first_id, last_id, n = 0 AND (o.mat IS NOT NULL OR o.tint_all OR o.tint_any OR o.no_brand IS NOT NULL OR o.max_price IS NOT NULL) AS conflict,
  CASE WHEN n > 0 THEN '' ELSE array_to_string(list_sort(list_distinct(list_concat(
    CASE WHEN o.mat IS NOT NULL AND e <= 1 THEN ['material:' || o.mat] ELSE [] END,
    CASE WHEN o.tint_all AND e <= 2 THEN ['color:red', 'color:blue'] ELSE [] END,
    CASE WHEN o.tint_any AND e <= 3 THEN ['color:red', 'color:blue'] ELSE [] END,
    CASE WHEN o.no_brand IS NOT NULL AND e = 4 THEN ['brand:excluded:' || o.no_brand] ELSE [] END,
    CASE WHEN o.no_brand IS NOT NULL AND e = 5 THEN ['category:excluded:ring'] ELSE [] END,
    CASE WHEN o.max_price IS NOT NULL AND e <= 6 THEN ['budget:maximum:' || format('{:g}', o.max_price)] ELSE [] END))), '|') END AS reasons
FROM st JOIN o ON o.labels = st.labels AND o.mat IS NOT DISTINCT FROM st.mat AND o.tint_all = st.tint_all AND o.tint_any = st.tint_any
  AND o.no_brand IS NOT DISTINCT FROM st.no_brand AND o.max_price IS NOT DISTINCT FROM st.max_price AND o.inclusive = st.inclusive""",
    ),
)
def q_rebuild_candidates(t: Tables):
    sessions = free_form_states(t)
    states = sessions.drop("session_id").dropDuplicates(["state_key"])
    pools = t.catalog.select(F.get("categories", F.lit(2)).alias("label"), "parent_asin")
    _, outcome = K.rebuild_candidates(states, pools, t.facts, t.products)
    outcome = outcome.withColumn("reasons", F.array_join("reasons", "|"))
    return sessions.select("session_id", "state_key").join(outcome, "state_key").drop("state_key")


def labelled_states(t: Tables):
    """Distinct (target, turn) situations, the sessions in each, what is known and what was known before."""
    rows = t.states.groupBy("target", "turn").agg(
        F.count("*").alias("n_sessions"), F.any_value("category").alias("category"), F.any_value("known").alias("known")
    )
    before = F.slice("known", 1, F.greatest(F.size("known") - 1, F.lit(0)))
    before = F.when(F.col("turn") > F.size("known"), F.col("known")).otherwise(before)
    wanted = F.array_sort(F.array_distinct(F.transform(before, lambda k: K.token(F.lit("other"), k["value"]))))
    return rows.select(
        F.concat_ws("|", "target", "turn").alias("state_id"), "target", "turn", "category", "n_sessions",
        F.array_distinct(F.transform("known", lambda k: K.token(k["attribute"], k["value"]))).alias("known"),
        wanted.alias("wanted"), F.col("category").alias("pool"),
    ).withColumn("state_key", S.stable_hash(F.col("pool"), F.array_join("wanted", "\x01")))


def labelled_sets(t: Tables, labelled):
    """(state_key, parent_asin): the candidate sets that equal situations share."""
    members, _ = other_members(t)
    return K.match_all(labelled.select("state_key", "pool", "wanted").distinct(), members, keep_open=True)


def labelled_candidates(t: Tables, labelled):
    """(state_id, parent_asin) from the sets shared by equal situations."""
    return labelled.select("state_id", "state_key").join(labelled_sets(t, labelled), "state_key").drop("state_key")


LABELLED_SQL = """lab AS MATERIALIZED (SELECT DISTINCT target || '|' || turn AS state_id, target, turn, category,
  list_distinct(list_transform(known, lambda k: k.attribute || '=' || k.value)) AS known_tokens,
  list_distinct(list_transform(CASE WHEN turn > len(known) THEN known ELSE known[1:len(known) - 1] END, lambda k: 'other=' || k.value)) AS before
  FROM states),
tok AS MATERIALIZED (SELECT parent_asin, category, list('other=' || normalized_value) AS toks FROM facts JOIN profile USING (parent_asin) WHERE attribute = 'other' GROUP BY 1, 2),
labc AS MATERIALIZED (SELECT state_id, target, known_tokens, parent_asin FROM lab JOIN tok ON tok.category = lab.category AND list_has_all(toks, before)),
ev AS MATERIALIZED (SELECT parent_asin, list_concat(list_transform(constraints, lambda c: c.attribute || '=' || c.value), list_transform(constraints, lambda c: 'other=' || c.value)) AS ev FROM profile)"""


@query(
    "evidence_match",
    O.with_views(
        "states facts",
        f""", {LABELLED_SQL}
SELECT state_id, c.parent_asin, len(list_intersect(known_tokens, e.ev)) AS matched, len(list_intersect(known_tokens, te.ev)) AS needed,
  len(list_intersect(known_tokens, e.ev)) >= len(list_intersect(known_tokens, te.ev)) AS indistinguishable
FROM labc c JOIN ev e ON e.parent_asin = c.parent_asin JOIN ev te ON te.parent_asin = c.target""",
    ),
)
def q_evidence_match(t: Tables):
    labelled = labelled_states(t)
    found = K.shared_evidence_match(
        labelled_sets(t, labelled), labelled.select("state_id", "state_key", "target", "known"), K.evidence_of(t.profile)
    )
    return found.select("state_id", "parent_asin", "matched", "needed", "indistinguishable")


@query(
    "answer_split",
    O.with_views(
        "sess profile facts",
        """, r AS (SELECT session_id, list_transform(constraints, lambda c: c.display) AS shown, scenario FROM sess JOIN profile ON parent_asin = target),
pay AS MATERIALIZED (SELECT session_id, CASE scenario WHEN 'buying' THEN shown[1] WHEN 'browsing' THEN shown[1] || '; ' || shown[2]
   WHEN 'boundary' THEN shown[1] || ';  not a fact; ' || shown[2] ELSE 'loose; ' || shown[1] END AS payload FROM r),
v AS (SELECT DISTINCT normalized_value AS v FROM facts WHERE attribute = 'other'),
c AS (SELECT session_id, regexp_replace(payload, '\\s+', ' ', 'g') AS payload, string_split(regexp_replace(payload, '\\s+', ' ', 'g'), '; ') AS pieces FROM pay),
o AS (SELECT *, unnest(generate_series(0, len(pieces) - 1)) AS cut FROM c),
h AS (SELECT *, CASE WHEN cut = 0 THEN payload ELSE array_to_string(pieces[1:cut], '; ') END AS l, CASE WHEN cut = 0 THEN payload ELSE array_to_string(pieces[cut + 1:], '; ') END AS r FROM o),
b AS (SELECT session_id, any_value(pieces) AS pieces, any_value(payload) AS payload,
  min(cut) FILTER (lower(l) IN (SELECT v FROM v) AND lower(r) IN (SELECT v FROM v)) AS cut FROM h GROUP BY 1)
SELECT session_id, 1 AS turn, i - 1 AS position, vals[i] AS value FROM (SELECT *, unnest(generate_series(1, len(vals))) AS i FROM (SELECT session_id, CASE WHEN cut = 0 THEN [payload]
  WHEN cut > 0 THEN [array_to_string(pieces[1:cut], '; '), array_to_string(pieces[cut + 1:], '; ')] ELSE pieces END AS vals FROM b))""",
    ),
)
def q_answer_split(t: Tables):
    rows = t.session_profiles.withColumn("shown", F.transform("constraints", lambda c: c["display"]))
    first, second = F.get("shown", F.lit(0)), F.get("shown", F.lit(1))
    payload = (
        F.when(F.col("scenario") == "buying", first)
        .when(F.col("scenario") == "browsing", F.concat(first, F.lit("; "), second))
        .when(F.col("scenario") == "boundary", F.concat(first, F.lit(";  not a fact; "), second))
        .otherwise(F.concat(F.lit("loose; "), first))
    )
    replies = rows.select("session_id", F.lit(1).alias("turn"), F.lit("other").alias("attribute"), payload.alias("payload"))
    return K.answer_split(replies, t.facts)


SETS_SQL = """a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount >= 0.05)"""


def two_sets(t: Tables):
    lines = t.table("lineitem")
    return (
        lines.filter(F.col("l_returnflag") == "A").select(F.col("l_partkey").alias("k")),
        lines.filter(F.col("l_discount") >= 0.05).select(F.col("l_partkey").alias("k")),
    )


@query("candidates_union", f"WITH {SETS_SQL} SELECT k FROM a UNION SELECT k FROM b")
def q_candidates_union(t: Tables):
    a, b = two_sets(t)
    return a.unionByName(b).distinct()


@query("candidates_intersect", f"WITH {SETS_SQL} SELECT k FROM a INTERSECT SELECT k FROM b")
def q_candidates_intersect(t: Tables):
    a, b = two_sets(t)
    return a.intersect(b)


@query("candidates_except", f"WITH {SETS_SQL} SELECT k FROM a EXCEPT SELECT k FROM b")
def q_candidates_except(t: Tables):
    a, b = two_sets(t)
    return a.distinct().join(b, "k", "left_anti")


@query("category_counts", O.with_views("nodes", "SELECT full_path, product_count FROM nodes"))
def q_category_counts(t: Tables):
    return C.category_counts(t.bridge)


@query("attribute_counts", O.with_views("facts", "SELECT attribute, count(*) AS n FROM facts GROUP BY 1"))
def q_attribute_counts(t: Tables):
    return C.attribute_counts(t.facts)


@query(
    "brand_dictionary",
    O.with_views(
        "facts",
        """SELECT normalized_value, count(*) AS product_count, min(display_value) AS brand FROM facts WHERE attribute = 'brand'
GROUP BY 1 HAVING count(*) >= 2 AND lower(trim(min(display_value))) NOT IN ('no', 'generic', 'unknown')""",
    ),
)
def q_brand_dictionary(t: Tables):
    return C.brand_dictionary(t.facts)
