"""Splits, survivors, negatives, weights, manifests and model fitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetloom.functions import scalars as S
from facetloom.functions import vocab as V
from facetloom.operators import candidates as K
from facetloom.operators import catalog as C
from facetloom.operators import dataset as D
from facetloom.operators import features, metrics, training
from facetloom.plans import oracle as O
from facetloom.plans import ranking_queries as R
from facetloom.plans.catalog_queries import ITEM_SQL, SPLIT_SQL
from facetloom.plans.facet_queries import (
    LABELLED_SQL, SURVIVORS_SQL, WANTED_SQL, labelled_candidates, labelled_sets, labelled_states, other_members, wanted_states,
)
from facetloom.plans.registry import query
from facetloom.session import spread_join
from facetloom.sources.tables import Tables, product_id


# --- splits and quotas ---------------------------------------------------------


SPLITS_SQL = f"""tot AS (SELECT count(*) AS n, count(*) * 8 // 10 AS a, count(*) // 10 AS b, count(DISTINCT category) AS nc FROM profile),
goal AS (SELECT n, nc, n - tr AS held, tr, b + CASE WHEN n - tr - 2 * b > 0 THEN 1 ELSE 0 END AS val FROM (SELECT *, a + CASE WHEN n - a - 2 * b > 0 AND n * 8 % 10 >= n % 10 THEN 1 ELSE 0 END AS tr FROM tot)),
line AS MATERIALIZED (SELECT parent_asin, category, {O.hash_key("'split-products'", "'2026'", 'parent_asin')} AS h,
  row_number() OVER (PARTITION BY category ORDER BY {O.hash_key("'split-products'", "'2026'", 'parent_asin')}, parent_asin) AS slot,
  row_number() OVER (ORDER BY {O.hash_key("'split-categories'", "'2026'", 'category')}, category, {O.hash_key("'split-products'", "'2026'", 'parent_asin')}, parent_asin) - 1 AS pos FROM profile),
plc AS MATERIALIZED (SELECT *, CASE WHEN (pos + 1) * held // n = pos * held // n THEN 'train'
  WHEN (pos * held // n + 1) * val // held > (pos * held // n) * val // held THEN 'validation' ELSE 'test' END AS split FROM line, goal),
tr AS MATERIALIZED (SELECT *, count(*) FILTER (split = 'train') OVER (PARTITION BY category) AS n_train,
  count(*) FILTER (split = 'train') OVER (PARTITION BY category ORDER BY slot) AS train_rank FROM plc),
wants AS (SELECT parent_asin, split, row_number() OVER (ORDER BY h, parent_asin) AS i FROM tr WHERE n_train = 0 AND slot = 1 AND (SELECT tr >= nc FROM goal)),
gives AS (SELECT parent_asin, row_number() OVER (ORDER BY h, parent_asin) AS i FROM tr WHERE split = 'train' AND train_rank >= 2),
trades AS (SELECT w.parent_asin, 'train' AS traded FROM wants w JOIN gives USING (i) UNION ALL SELECT g.parent_asin, w.split FROM wants w JOIN gives g USING (i)),
splits AS MATERIALIZED (SELECT parent_asin, category, coalesce(traded, split) AS split FROM tr LEFT JOIN trades USING (parent_asin))"""


@query("stratified_split", O.with_views("profile", f", {SPLITS_SQL} SELECT parent_asin, category, split FROM splits"))
def q_stratified_split(t: Tables):
    return product_splits(t)


def product_splits(t: Tables):
    return t.keep("product_splits", lambda: D.stratified_split(t.profile.select("parent_asin", "category")))


@query(
    "split_integrity",
    O.with_views(
        "profile",
        f""", {SPLITS_SQL}, seen AS (SELECT parent_asin, split FROM splits WHERE category NOT LIKE '%brown%'
  UNION ALL SELECT parent_asin, 'test' FROM splits WHERE parent_asin LIKE '%7' UNION ALL SELECT 'S' || s_suppkey, 'train' FROM supplier),
per AS (SELECT parent_asin, count(DISTINCT split) AS k FROM seen GROUP BY 1)
SELECT 'several' AS problem, parent_asin FROM per WHERE k > 1 UNION ALL SELECT 'none', parent_asin FROM profile WHERE parent_asin NOT IN (SELECT parent_asin FROM per)
UNION ALL SELECT 'unknown', parent_asin FROM per WHERE parent_asin NOT IN (SELECT parent_asin FROM profile)""",
    ),
)
def q_split_integrity(t: Tables):
    """The engine's splits, damaged: a category's products missing, some in two splits, some unknown."""
    splits = product_splits(t)
    damaged = (
        splits.filter(~F.col("category").like("%brown%")).select("parent_asin", "split")
        .unionByName(splits.filter(F.col("parent_asin").like("%7")).select("parent_asin", F.lit("test").alias("split")))
        .unionByName(t.table("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("parent_asin"), F.lit("train").alias("split")))
    )
    return D.split_integrity(damaged, t.products)


# Rows placed before the first order, so that the last block is a partial one.
EARLIER = 7


def slots_sql(kind: str, counts: dict[str, int]) -> str:
    entries = (
        f"{{'h': {O.hash_key(*[f"'{p}'" for p in ('scenario-public', '2026', kind)], 'b::VARCHAR', f"'{label}'", f"'{i}'")}, 'l': '{label}', 'i': {i}}}"
        for label, n in counts.items() for i in range(n)
    )
    return f"list_sort([{', '.join(entries)}])"


@query(
    "exact_quota_labels",
    f"""WITH b AS (SELECT DISTINCT (o_orderkey + {EARLIER}) // 20 AS b FROM orders),
s AS (SELECT b, CASE WHEN b < (SELECT (max(o_orderkey) + 1 + {EARLIER}) // 20 FROM orders) THEN {slots_sql("block", V.SCENARIO_MIXES["public"])}
  ELSE {slots_sql("partial", D.largest_remainder(EARLIER, V.SCENARIO_MIXES["public"]))} END AS s FROM b)
SELECT o_orderkey, s[(o_orderkey + {EARLIER}) % 20 + 1].l AS label FROM orders JOIN s ON b = (o_orderkey + {EARLIER}) // 20""",
)
def q_exact_quota_labels(t: Tables):
    orders = t.table("orders").select("o_orderkey", (F.col("o_orderkey") + EARLIER).alias("position"))
    # Keys run from zero, without gaps.
    total = EARLIER + orders.count()
    return D.exact_quota_labels(orders, "position", total, V.SCENARIO_MIXES["public"], "scenario-public").select("o_orderkey", "label")


@query(
    "cyclic_assign",
    O.with_views(
        "prod",
        f""", p AS (SELECT parent_asin AS item, {SPLIT_SQL} AS split, count(*) OVER (PARTITION BY {SPLIT_SQL}) AS size FROM prod),
r AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'validation' ELSE 'test' END AS split FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_id) - 1 AS i FROM r),
m AS (SELECT row_id, n.split, i // size AS cycle, i % size + 1 AS place FROM n JOIN (SELECT DISTINCT split, size FROM p) USING (split)),
c AS (SELECT split, item, cycle, row_number() OVER (PARTITION BY split, cycle ORDER BY {O.hash_key("'trajectory-target'", "'2026'", 'split', 'cycle::VARCHAR', 'item')}, item) AS place
  FROM p JOIN (SELECT DISTINCT split, cycle FROM m) USING (split))
SELECT row_id, split, item FROM m JOIN c USING (split, cycle, place)""",
    ),
)
def q_cyclic_assign(t: Tables):
    slot = F.pmod("o_orderkey", F.lit(10))
    rows = t.table("orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.when(slot < 8, "train").when(slot == 8, "validation").otherwise("test").alias("split"),
    )
    pool = t.products.select(F.col("parent_asin").alias("item"), S.hash_split(F.col("parent_asin")).alias("split"))
    return D.cyclic_assign(rows, pool)


@query(
    "reply_values_table",
    O.with_views("reply", "SELECT parent_asin, ordinal, attribute, normalized_value FROM reply"),
)
def q_reply_values_table(t: Tables):
    return C.reply_values(t.profile)


# --- survivors and negatives -----------------------------------------------------


@query(
    "state_survivors",
    O.with_views(
        "states facts",
        f""", {WANTED_SQL.replace("boundary' AND turn = 4", "boundary' AND turn >= 4")}, {SURVIVORS_SQL},
cnt AS (SELECT category, wanted, count(*) AS n, min(parent_asin) AS first_id FROM surv GROUP BY 1, 2),
plain AS (SELECT session_id, turn, category, list_sort(list_distinct(list_transform(known, lambda k: 'other=' || k.value))) AS base, wanted FROM st)
SELECT p.session_id, p.turn, c.n IS NULL AS rolled_back, coalesce(c.n, b.n) AS n_survivors, coalesce(c.first_id, b.first_id) AS first_id
FROM plain p LEFT JOIN cnt c ON c.category = p.category AND c.wanted = p.wanted
  JOIN (SELECT category, toks, count(*) AS n, min(parent_asin) AS first_id FROM (SELECT d.category, d.base AS toks, t.parent_asin FROM (SELECT DISTINCT category, base FROM plain) d JOIN tok t ON t.category = d.category AND list_has_all(t.toks, d.base)) GROUP BY 1, 2) b
  ON b.category = p.category AND b.toks = CASE WHEN p.turn = 4 AND c.n IS NULL THEN (SELECT base FROM plain q WHERE q.session_id = p.session_id AND q.turn = 3) ELSE p.base END""",
    ),
)
def q_state_survivors(t: Tables):
    """Turn by turn: each turn adds its new facts or, if nothing is left, drops them."""
    rows = wanted_states(t)
    before = F.transform(
        F.slice("known", 1, F.greatest(F.col("turn") - 1, F.lit(0))), lambda k: K.token(F.lit("other"), k["value"])
    )
    turns = rows.select("session_id", "pool", "turn", F.array_except("wanted", before).alias("values"))
    members, _ = other_members(t)
    folded = K.fold_turns(turns, members)
    keyed = folded.withColumn("state_key", S.stable_hash(F.col("pool"), F.array_join("accepted", "\x01")))
    states = keyed.select("state_key", "pool", F.col("accepted").alias("wanted")).distinct()
    found = K.match_all(states, members, keep_open=True).groupBy("state_key").agg(
        F.count("*").alias("n_survivors"), F.min("parent_asin").alias("first_id")
    )
    return keyed.join(found, "state_key").select("session_id", "turn", "rolled_back", "n_survivors", "first_id")


def training_states(t: Tables):
    """(state_id, target, known, weight, ...) of labelled situations with their product split."""
    def build():
        labelled = labelled_states(t)
        split = product_splits(t).select(F.col("parent_asin").alias("target"), "split")
        weighted = metrics.state_weights(labelled.withColumn("trajectory", F.col("target")), "trajectory")
        # Sessions in one situation share its row, which weighs as much as all of them.
        return weighted.withColumn("weight", F.col("weight") * F.col("n_sessions")).join(split, "target")

    return t.keep("training_states", build)


def training_pool(t: Tables):
    def build():
        labelled = training_states(t)
        sets = labelled_sets(t, labelled).join(product_splits(t).select("parent_asin", "split"), "parent_asin")
        states = labelled.select("state_id", "state_key", "target", "known", "split")
        return D.negative_pool(K.shared_evidence_match(sets, states, K.evidence_of(t.profile), ("split",)))

    return t.keep("training_pool", build)


def state_scores(t: Tables, rows):
    """Stand-in model scores of pool rows: item base values."""
    return rows.join(R.items(t).select("parent_asin", F.round("base", 9).alias("score")), "parent_asin").select(
        "state_id", "parent_asin", "score"
    )


def sampled(t: Tables, policy: str = "downweight_ties"):
    def overlaps(rows):
        found = D.feature_overlap(rows.select("state_id", "target", "parent_asin"), R.items(t))
        return found.select("state_id", "parent_asin", "shared")

    def build():
        return D.survivor_negatives(training_pool(t), lambda rows: state_scores(t, rows), overlaps, policy=policy)

    return t.keep(f"sampled_{policy}", build)


POOL_SQL = f"""{ITEM_SQL}, {SPLITS_SQL}, {LABELLED_SQL},
feat AS MATERIALIZED (SELECT parent_asin, list(name) AS fs FROM items GROUP BY 1),
tiw AS MATERIALIZED (SELECT name, d, {O.hash_weight('name', 'd')} AS w FROM (SELECT DISTINCT name FROM items), (SELECT unnest([{R.DIMS}, 'linear']) AS d)),
tsum AS (SELECT parent_asin, d, sum(w) AS s, sum(w * w) AS q FROM items JOIN tiw USING (name) GROUP BY 1, 2),
tbase AS MATERIALIZED (SELECT parent_asin, round(sum(s) FILTER (d = 'linear') + 0.5 * sum(s * s - q) FILTER (d <> 'linear'), 9) AS score FROM tsum GROUP BY 1),
tpool AS MATERIALIZED (SELECT c.state_id, c.target, c.parent_asin, len(list_intersect(known_tokens, e.ev)) >= len(list_intersect(known_tokens, te.ev)) AS tie
  FROM labc c JOIN ev e ON e.parent_asin = c.parent_asin JOIN ev te ON te.parent_asin = c.target JOIN splits s ON s.parent_asin = c.parent_asin
  JOIN splits ts ON ts.parent_asin = c.target WHERE s.split = ts.split AND c.parent_asin <> c.target)"""


def sampled_sql(ties: bool) -> str:
    """Common tables of the sampled pairs, with or without indistinguishable products."""
    key = lambda kind: O.hash_key(f"'{kind}'", "'2026'", "'0'", "state_id", "parent_asin")
    return f"""{POOL_SQL},
s0 AS MATERIALIZED (SELECT p.*, score, len(list_intersect(f.fs, tf.fs)) AS shared FROM (SELECT *, count(*) OVER (PARTITION BY state_id) AS valid,
    row_number() OVER (PARTITION BY state_id ORDER BY {key('pre-pool')}, parent_asin) AS pre FROM tpool {'' if ties else 'WHERE NOT tie'}) p
  JOIN tbase USING (parent_asin) JOIN feat f USING (parent_asin) JOIN feat tf ON tf.parent_asin = p.target WHERE pre <= 128),
s1 AS (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY score DESC, parent_asin) <= 8 AS hard FROM s0),
s2 AS (SELECT *, NOT hard AND row_number() OVER (PARTITION BY state_id, hard ORDER BY shared DESC, {key('near')}, parent_asin) <= 4 AS near FROM s1),
s3 AS (SELECT *, NOT hard AND NOT near AND row_number() OVER (PARTITION BY state_id, hard OR near ORDER BY {key('random')}, parent_asin) <= 4 AS rest FROM s2),
smp AS MATERIALIZED (SELECT state_id, target, parent_asin, tie, CASE WHEN valid <= 16 THEN 'all' WHEN hard THEN 'model_hard' WHEN near THEN 'near_match' ELSE 'random' END AS sampler
  FROM s3 WHERE valid <= 16 OR hard OR near OR rest)"""


PAIRS_SQL = f"""{sampled_sql(True)},
nst AS (SELECT target || '|' || turn AS state_id, count(*) AS n FROM states GROUP BY 1),
tst AS MATERIALIZED (SELECT state_id, n::DOUBLE / count(*) OVER (PARTITION BY target) AS tw, len(known_tokens) AS known FROM lab JOIN nst USING (state_id)),
prs AS MATERIALIZED (SELECT smp.*, tw, CASE WHEN known = 0 THEN 0.05::DOUBLE ELSE least(1.0::DOUBLE, known / 3.0::DOUBLE) END AS ew, 1.0::DOUBLE / count(*) OVER (PARTITION BY state_id) AS sw,
  CASE WHEN tie THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS aw FROM smp JOIN tst USING (state_id))"""


@query("survivor_negatives", O.with_views("states facts", f", {sampled_sql(True)} SELECT state_id, target, parent_asin, sampler, tie FROM smp"))
def q_survivor_negatives(t: Tables):
    return sampled(t).select("state_id", "target", "parent_asin", "sampler", "tie")


FIXED_SQL = f"""{ITEM_SQL}, {SPLITS_SQL}, feat AS MATERIALIZED (SELECT parent_asin, list(name) AS fs FROM items GROUP BY 1),
ring AS MATERIALIZED (SELECT parent_asin, category, split, count(*) OVER (PARTITION BY category, split) AS size,
  row_number() OVER (PARTITION BY category, split ORDER BY {O.hash_key("'product-fixed-pool'", "'2026'", 'parent_asin')}, parent_asin) AS place FROM splits),
wa AS (SELECT parent_asin AS target, category, split, (place - 1 + step) % size + 1 AS place FROM (SELECT *, unnest(range(1, least(128, size - 1) + 1)) AS step FROM ring)),
sh AS (SELECT target, r.parent_asin, len(list_intersect(a.fs, b.fs)) AS shared FROM wa JOIN ring r USING (category, split, place) JOIN feat a ON a.parent_asin = target JOIN feat b ON b.parent_asin = r.parent_asin),
fx AS MATERIALIZED (SELECT target, parent_asin, shared, row_number() OVER (PARTITION BY target ORDER BY shared DESC, {O.hash_key("'product-fixed'", "'2026'", 'target', 'parent_asin')}, parent_asin) AS rank FROM sh)"""


@query("product_fixed_pool", O.with_views("profile", f", {FIXED_SQL} SELECT target, parent_asin, shared, rank FROM fx"))
def q_product_fixed_pool(t: Tables):
    return fixed_pool(t).select("target", "parent_asin", "shared", "rank")


def fixed_pool(t: Tables):
    return D.product_fixed_pool(product_splits(t), R.items(t))


@query(
    "product_fixed_negatives",
    O.with_views(
        "states facts",
        f""", {FIXED_SQL}, {LABELLED_SQL},
tf AS (SELECT lab.state_id, fx.target, fx.parent_asin, fx.rank FROM lab JOIN fx USING (target) JOIN ev e ON e.parent_asin = fx.parent_asin JOIN ev te ON te.parent_asin = fx.target
  WHERE len(list_intersect(known_tokens, e.ev)) < len(list_intersect(known_tokens, te.ev)))
SELECT * FROM (SELECT state_id, target, parent_asin, row_number() OVER (PARTITION BY state_id ORDER BY rank) AS place FROM tf) WHERE place <= 16""",
    ),
)
def q_product_fixed_negatives(t: Tables):
    """Every state's first sixteen of its target's pool, once the products it cannot tell apart are gone."""
    states = training_states(t).groupBy(F.col("target").alias("parent_asin")).agg(F.collect_list(F.struct("state_id", "known")).alias("states"))
    described = R.items(t).select("parent_asin", "features").join(K.evidence_of(t.profile), "parent_asin").join(states, "parent_asin", "left")
    found = D.fixed_negatives_of_lists(D.fixed_lists(product_splits(t), described, carry=("evidence",)))
    return found.select("state_id", "target", "parent_asin", "place")


def weighted_pairs(t: Tables):
    states = training_states(t).select("state_id", "weight", F.size("known").alias("known"))
    return D.pair_weights(sampled(t), states)


@query(
    "pair_weights",
    O.with_views(
        "states facts",
        f""", {PAIRS_SQL} SELECT state_id, parent_asin, sampler, round(tw, 6) AS trajectory_weight, round(ew, 6) AS evidence_weight, round(sw, 6) AS sampling_weight,
  round(aw, 6) AS ambiguity_weight, round(tw * ew * sw * aw, 8) AS effective_weight FROM prs""",
    ),
)
def q_pair_weights(t: Tables):
    return weighted_pairs(t).select(
        "state_id", "parent_asin", "sampler", F.round("trajectory_weight", 6).alias("trajectory_weight"),
        F.round("evidence_weight", 6).alias("evidence_weight"), F.round("sampling_weight", 6).alias("sampling_weight"),
        F.round("ambiguity_weight", 6).alias("ambiguity_weight"), F.round("effective_weight", 8).alias("effective_weight"),
    )


@query(
    "set_valued_positive",
    O.with_views(
        "states facts",
        f""", {sampled_sql(False)},
ti AS (SELECT state_id, parent_asin AS tied, count(*) OVER (PARTITION BY state_id) AS ties,
  row_number() OVER (PARTITION BY state_id ORDER BY {O.hash_key("'tie'", 'state_id', 'parent_asin')}, parent_asin) AS slot FROM tpool WHERE tie),
pk AS (SELECT s.*, {O.stable_int("'positive'", "'2026'", "'0'", 's.state_id', 's.parent_asin')} % (coalesce(ties, 0) + 1)::UBIGINT AS slot
  FROM smp s LEFT JOIN (SELECT DISTINCT state_id, ties FROM ti) USING (state_id))
SELECT pk.state_id, target, parent_asin, coalesce(tied, target) AS positive FROM pk LEFT JOIN ti ON ti.state_id = pk.state_id AND ti.slot = pk.slot""",
    ),
)
def q_set_valued_positive(t: Tables):
    return D.set_valued_positive(sampled(t, "set_valued_positives"), training_pool(t)).select(
        "state_id", "target", "parent_asin", "positive"
    )


@query(
    "sampler_diagnostics",
    O.with_views(
        "states facts",
        f""", {PAIRS_SQL}, v AS (SELECT (SELECT count(DISTINCT state_id) FROM tpool) AS swp, (SELECT count(*) FROM tpool) AS c, (SELECT count(*) FROM tpool WHERE tie) AS ti,
  (SELECT count(DISTINCT state_id) FROM prs) AS act, (SELECT count(*) FROM prs) AS pc, (SELECT coalesce(sum(tw * ew * sw * aw), 0) FROM prs) AS w, (SELECT count(*) FROM tst) AS sc)
SELECT unnest(['states_with_pool', 'candidates', 'skipped_ties', 'active_states', 'pair_count', 'effective_weight', 'state_count', 'active_rate', 'tie_rate']) AS key,
  round(unnest([swp::DOUBLE, c, ti, act, pc, w, sc, act / greatest(1, sc), ti / greatest(1, c)]), 6) AS value FROM v
UNION ALL SELECT 'sampler:' || sampler, count(*)::DOUBLE FROM prs GROUP BY 1""",
    ),
)
def q_sampler_diagnostics(t: Tables):
    found = D.sampler_diagnostics(training_pool(t), weighted_pairs(t), training_states(t))
    return found.select("key", F.round("value", 6).alias("value"))


@query(
    "negative_audit",
    O.with_views(
        "states facts",
        f""", {PAIRS_SQL} SELECT state_id, target, parent_asin, sampler, tie, round(tw * ew * sw * aw, 8) AS effective_weight FROM prs
ORDER BY {O.hash_key("'audit'", "'2026'", 'state_id', 'parent_asin')} LIMIT 250""",
    ),
)
def q_negative_audit(t: Tables):
    return D.negative_audit(
        weighted_pairs(t).select("state_id", "target", "parent_asin", "sampler", "tie", F.round("effective_weight", 8).alias("effective_weight"))
    )


@query(
    "state_weights",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1.0 / count(*) OVER (PARTITION BY l_orderkey), 6) AS weight FROM lineitem",
)
def q_state_weights(t: Tables):
    lines = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return metrics.state_weights(lines, "l_orderkey").withColumn("weight", F.round("weight", 6))


@query(
    "dataset_manifest",
    O.with_views(
        "states facts",
        f""", {LABELLED_SQL}, w AS (SELECT state_id, count(*) AS width FROM labc GROUP BY 1),
s AS MATERIALIZED (SELECT st.session_id AS trajectory, {SPLIT_SQL.replace('parent_asin', 'st.target')} AS split, scenario, CASE WHEN scenario = 'intent_override' AND turn < 3 THEN 'provisional_override' ELSE scenario END AS scenario_state,
  turn, width, turn >= 3 AS has_other, scenario = 'browsing' AND turn = 4 AS extended FROM states st JOIN w ON w.state_id = st.target || '|' || st.turn),
tr AS (SELECT trajectory, any_value(split) AS split, any_value(scenario) AS scenario, bool_or(extended) AS extended FROM s GROUP BY 1),
d AS (SELECT 'states_by_split' AS section, split AS key FROM s UNION ALL SELECT 'states_by_scenario', scenario FROM s UNION ALL SELECT 'states_by_observed_scenario', scenario_state FROM s
  UNION ALL SELECT 'states_by_split_scenario', split || '/' || scenario FROM s UNION ALL SELECT 'states_by_turn_bucket', {O.turn_bucket('turn')} FROM s
  UNION ALL SELECT 'states_by_survivor_width', CASE WHEN width <= 10 THEN '<=10' WHEN width <= 50 THEN '11-50' WHEN width <= 200 THEN '51-200' ELSE '>200' END FROM s
  UNION ALL SELECT 'states_by_other', CASE WHEN has_other THEN 'with_other' ELSE 'without_other' END FROM s
  UNION ALL SELECT 'trajectories_by_split', split FROM tr UNION ALL SELECT 'trajectories_by_scenario', scenario FROM tr UNION ALL SELECT 'trajectories_by_split_scenario', split || '/' || scenario FROM tr)
SELECT section, key, count(*)::DOUBLE AS value FROM d GROUP BY 1, 2
UNION ALL SELECT 'totals', 'trajectory_count', count(*) FROM tr UNION ALL SELECT 'totals', 'extended_trajectories', count(*) FILTER (extended) FROM tr
UNION ALL SELECT 'totals', 'state_count', count(*) FROM s UNION ALL SELECT 'totals', 'survivor_count', sum(width)::DOUBLE FROM s UNION ALL SELECT 'totals', 'weight_sum_error', 0
UNION ALL SELECT 'width', 'minimum', min(width) FROM s UNION ALL SELECT 'width', 'maximum', max(width) FROM s
UNION ALL SELECT 'width', 'mean', round(sum(width) / count(*), 6) FROM s UNION ALL SELECT 'width', 'median', median(width) FROM s""",
    ),
)
def q_dataset_manifest(t: Tables):
    labelled = labelled_states(t)
    # Equal situations share a set: it is counted once, not copied to each of them.
    sizes = labelled_sets(t, labelled).groupBy("state_key").agg(F.count("*").alias("width"))
    widths = labelled.select("state_id", "state_key").join(sizes, "state_key").drop("state_key")
    provisional = (F.col("scenario") == "intent_override") & (F.col("turn") < 3)
    states = t.states.withColumn("state_id", F.concat_ws("|", "target", "turn")).join(widths, "state_id").select(
        F.col("session_id").alias("trajectory"), S.hash_split(F.col("target")).alias("split"), "scenario",
        F.when(provisional, "provisional_override").otherwise(F.col("scenario")).alias("scenario_state"),
        "turn", "width", (F.col("turn") >= 3).alias("has_other"),
        ((F.col("scenario") == "browsing") & (F.col("turn") == 4)).alias("extended"),
    )
    return metrics.dataset_manifest(metrics.state_weights(states, "trajectory"))


# --- model fitting -----------------------------------------------------------------


def named_pairs(t: Tables):
    """(positive, negative array<string>, weight) of the train split."""
    train = training_states(t).filter(F.col("split") == "train").select("state_id")
    own = R.items(t).select("parent_asin", F.col("features").alias("negative"))
    goal = R.items(t).select(F.col("parent_asin").alias("target"), F.col("features").alias("positive"))
    return (
        weighted_pairs(t).join(train, "state_id", "left_semi").join(own, "parent_asin").join(goal, "target")
        .select("state_id", "positive", "negative", F.col("effective_weight").alias("weight"))
    )


@query("bpr_fit_linear")
def q_bpr_fit_linear(t: Tables):
    pairs = t.keep("named_pairs", lambda: named_pairs(t))
    fitted = training.bpr_fit_linear(pairs.select("positive", "negative", "weight"))
    return fitted.select("name", F.round("weight", 4).alias("weight"))


def fm_tables(t: Tables):
    """Features of training states and products, the crosses of both, and the names of all parameters."""
    vocab = R.vocabulary(t)
    states = training_states(t)

    def state_names():
        own = F.concat(
            F.transform("known", lambda k: F.concat(F.lit("ctx:"), k)),
            F.array(
                F.concat(F.lit("ctx:category="), F.lower("category")), F.concat(F.lit("ctx:turn="), S.turn_bucket(F.col("turn")))
            ),
        )
        rows = states.select(F.col("state_id").alias("context"), F.explode(own).alias("name"))
        side = vocab.where(F.col("side") == "context")
        return features.vocab_map(rows, side, ["context"]).join(side.select("feature_id", "name"), "feature_id").select("context", "name")

    contexts = t.keep("fm_contexts", state_names)
    items = t.keep("fm_items", lambda: R.items(t).select(F.col("parent_asin").alias("product"), F.explode("features").alias("name")))

    def eligible():
        train = states.where(F.col("split") == "train")
        positive = train.select(F.col("state_id").alias("context_key"), F.col("target").alias("parent_asin"), F.col("n_sessions").alias("n"))
        named = contexts.groupBy(F.col("context").alias("context_key")).agg(F.collect_list("name").alias("features"))
        found = features.eligible_crosses(positive, named, R.items(t), 20)
        return found.withColumn("name", F.concat("context_feature", F.lit("×"), "item_feature"))

    known = t.keep("fm_crosses", eligible)

    def crossed():
        asked = fm_pairs(t).select("context", F.col("positive").alias("product")).unionByName(
            fm_pairs(t).select("context", F.col("negative").alias("product"))
        ).unionByName(fm_validation(t)).distinct()
        by_product = items.join(known.select(F.col("item_feature").alias("name"), "context_feature", F.col("name").alias("cross")), "name")
        own = contexts.join(known.select(F.col("context_feature").alias("name")).distinct(), "name", "left_semi")
        rows = spread_join(asked, own.withColumnRenamed("name", "context_feature"), ["context"], ["product"])
        return rows.join(by_product.select("context_feature", "product", "cross"), ["context_feature", "product"]).select(
            "context", "product", F.col("cross").alias("name")
        )

    crosses = t.keep("fm_crossed", crossed)
    names = vocab.select(F.col("side").alias("kind"), "name").unionByName(known.select(F.lit("cross").alias("kind"), "name"))
    return training.FmData(contexts, items, crosses), names


def fm_pairs(t: Tables):
    """(context, positive, negative, weight) of the train split."""
    def build():
        train = training_states(t).where(F.col("split") == "train").select("state_id")
        return weighted_pairs(t).join(train, "state_id", "left_semi").select(
            F.col("state_id").alias("context"), F.col("target").alias("positive"), F.col("parent_asin").alias("negative"),
            F.col("effective_weight").alias("weight"),
        )

    return t.keep("fm_pairs", build)


def fm_validation(t: Tables):
    """(context, product): validation states with all products their facts leave."""
    held_out = training_states(t).where(F.col("split") == "validation")
    return t.keep("fm_validation", lambda: labelled_candidates(t, held_out)).select(
        F.col("state_id").alias("context"), F.col("parent_asin").alias("product")
    )


STEP_SQL = f"""{PAIRS_SQL}, {R.VOCAB_SQL},
tn AS (SELECT state_id, 'ctx:' || unnest(known_tokens) AS n FROM lab UNION SELECT state_id, 'ctx:category=' || lower(category) FROM lab
  UNION SELECT state_id, 'ctx:turn=' || {O.turn_bucket('turn')} FROM lab),
tf AS MATERIALIZED (SELECT DISTINCT state_id, coalesce(e.name, r.name) AS name FROM tn LEFT JOIN ctxn e ON e.name = n
  LEFT JOIN ctxn r ON contains(n, '=') AND r.name = split_part(n, '=', 1) || '={V.RARE}' WHERE coalesce(e.name, r.name) IS NOT NULL),
tp AS (SELECT l.state_id, l.target, n FROM lab l JOIN nst USING (state_id) JOIN splits s ON s.parent_asin = l.target WHERE split = 'train'),
ta AS (SELECT * FROM tf WHERE split_part(split_part(name, '=', 1), ':', 2) IN ({O.quoted(V.ASK_ATTRIBUTES)}) AND NOT contains(name, '{V.RARE}')),
te AS (SELECT name, sum(n) AS exposure FROM tp JOIN ta USING (state_id) GROUP BY 1 HAVING sum(n) >= 20),
xr AS MATERIALIZED (SELECT ta.name AS cf, i.name AS itf FROM tp JOIN ta USING (state_id) JOIN items i ON i.parent_asin = tp.target
  WHERE NOT contains(i.name, '{V.RARE}') AND ta.name IN (SELECT name FROM te) GROUP BY 1, 2 HAVING sum(n) >= 20),
ds AS (SELECT unnest(range(1, 17)) AS d),
v0 AS MATERIALIZED (SELECT kind, name, d, (({O.stable_int("'fm-start-2026'", 'kind', 'name', 'd::VARCHAR')} % 2001)::BIGINT - 1000) / 50000.0::DOUBLE AS v
  FROM (SELECT 'context' AS kind, name FROM ctxn UNION ALL SELECT 'item', name FROM itemn), ds),
tc AS MATERIALIZED (SELECT state_id, d, sum(v) AS c FROM tf JOIN v0 ON kind = 'context' AND v0.name = tf.name GROUP BY 1, 2),
ts AS MATERIALIZED (SELECT parent_asin, d, sum(v) AS s, sum(v * v) AS q FROM items i JOIN v0 ON kind = 'item' AND v0.name = i.name GROUP BY 1, 2),
tb AS MATERIALIZED (SELECT parent_asin, 0.5 * sum(s * s - q) AS base FROM ts GROUP BY 1),
tw AS MATERIALIZED (SELECT state_id, prs.target AS p, prs.parent_asin AS n, tw * ew * sw * aw / sum(tw * ew * sw * aw) OVER () AS w
  FROM prs JOIN splits s ON s.parent_asin = prs.target WHERE s.split = 'train'),
tdot AS (SELECT state_id, p, n, sum(c * (a.s - b.s)) AS dot FROM tw JOIN tc USING (state_id) JOIN ts a ON a.parent_asin = p AND a.d = tc.d JOIN ts b ON b.parent_asin = n AND b.d = tc.d GROUP BY 1, 2, 3),
tg AS MATERIALIZED (SELECT tw.state_id, tw.p, tw.n, -w / (1 + exp(a.base - b.base + coalesce(dot, 0))) AS g FROM tw JOIN tb a ON a.parent_asin = p JOIN tb b ON b.parent_asin = n
  LEFT JOIN tdot ON tdot.state_id = tw.state_id AND tdot.p = tw.p AND tdot.n = tw.n),
gc AS (SELECT 'context' AS kind, name, d, sum(x) AS g FROM (SELECT state_id, a.d, sum(g * (a.s - b.s)) AS x FROM tg JOIN ts a ON a.parent_asin = p JOIN ts b ON b.parent_asin = n AND b.d = a.d GROUP BY 1, 2) JOIN tf USING (state_id) GROUP BY 2, 3),
sg AS MATERIALIZED (SELECT state_id, p AS parent_asin, g FROM tg UNION ALL SELECT state_id, n, -g FROM tg),
gb AS (SELECT parent_asin, d, sum(g * c) AS b FROM sg JOIN tc USING (state_id) GROUP BY 1, 2), ga AS (SELECT parent_asin, sum(g) AS a FROM sg GROUP BY 1),
gi AS (SELECT 'item' AS kind, i.name, ts.d, sum(coalesce(b, 0) + a * (s - v)) AS g FROM items i JOIN ga USING (parent_asin) JOIN ts USING (parent_asin)
  LEFT JOIN gb ON gb.parent_asin = i.parent_asin AND gb.d = ts.d JOIN v0 ON kind = 'item' AND v0.name = i.name AND v0.d = ts.d GROUP BY 2, 3),
gl AS (SELECT 'item' AS kind, i.name, 0 AS d, sum(a) AS g FROM items i JOIN ga USING (parent_asin) GROUP BY 2),
gx AS (SELECT 'cross' AS kind, cf || '×' || itf AS name, 0 AS d, sum(g) AS g FROM xr JOIN tf ON tf.name = cf JOIN sg USING (state_id) JOIN items i ON i.parent_asin = sg.parent_asin AND i.name = itf GROUP BY 2),
gr AS (SELECT * FROM gc UNION ALL SELECT * FROM gi UNION ALL SELECT * FROM gl UNION ALL SELECT * FROM gx),
al AS (SELECT kind, name, d, v FROM v0 UNION ALL SELECT 'item', name, 0, 0 FROM itemn UNION ALL SELECT 'cross', cf || '×' || itf, 0, 0 FROM xr),
st1 AS (SELECT al.kind, al.name, al.d, v, coalesce(g, 0) + v * 1e-5 AS g FROM al LEFT JOIN gr ON gr.kind = al.kind AND gr.name = al.name AND gr.d = al.d)"""


@query(
    "fm_adam_step",
    O.with_views("states facts", f""", {STEP_SQL} SELECT kind, name, d::INT AS place, round(v - 0.01 * g / (abs(g) + 1e-8), 6) AS value, round(0.1 * g, 9) AS moment FROM st1"""),
)
def q_fm_adam_step(t: Tables):
    """All parameters after the first step of a fit."""
    config = training.FmConfig()
    data, names = fm_tables(t)
    start = training.start_parameters(names, config.dimension)
    pairs = fm_pairs(t)
    total = pairs.agg(F.sum("weight").alias("total"))
    # One row of totals.
    scaled = pairs.crossJoin(F.broadcast(total)).withColumn("weight", F.col("weight") / F.col("total")).drop("total")
    sums = training.fm_sums(scaled, data, start, config.dimension)
    moved = training.adam(training.fm_gradients(sums, data, start, config.dimension), config, 1)
    return fm_values(moved, config.dimension, "m").select(
        "kind", "name", "place", F.round("value", 6).alias("value"), F.round("m", 9).alias("moment")
    )


def fm_values(parameters, dimension: int, *others: str):
    """(kind, name, place, value, *others): one row per number; places a kind does not use are left out."""
    entries = [
        F.struct(F.lit(d).alias("place"), F.get("v", F.lit(d)).alias("value"), *[F.get(o, F.lit(d)).alias(o) for o in others])
        for d in range(dimension + 1)
    ]
    used = F.when(F.col("kind") == "cross", F.col("place") == 0).when(F.col("kind") == "context", F.col("place") > 0).otherwise(F.lit(True))
    return parameters.select("kind", "name", F.inline(F.array(*entries))).where(used)


def fit_fm(t: Tables, config: training.FmConfig | None = None) -> training.FmFit:
    """A fit on train pairs; the epoch with the best MRR on validation states is kept."""
    config = config or training.FmConfig()
    data, names = fm_tables(t)
    start = t.keep(f"fm_start_{config.dimension}", lambda: training.start_parameters(names, config.dimension))
    pairs = fm_pairs(t)
    held_out = training_states(t).where(F.col("split") == "validation").select("state_id", "target", "weight")
    rows = fm_validation(t)

    def validate(parameters) -> float:
        scores = training.fm_scores(rows, data, parameters, config.dimension)
        goals = held_out.select(F.col("state_id").alias("context"), "target", "weight")
        goal = scores.join(goals, (scores["context"] == goals["context"]) & (scores["product"] == goals["target"])).select(
            goals["context"], "target", "weight", F.col("score").alias("own")
        )
        # Each state has one target: its rank is what stands before it, counted.
        before = (F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("product") < F.col("target")))
        ranks = spread_join(scores, goal, ["context"], ["product"]).groupBy("context").agg(
            (F.sum(before.cast("int")) + 1).alias("rank"), F.first("weight").alias("weight")
        )
        return ranks.agg(metrics.weighted_mean(1.0 / F.col("rank"), F.col("weight"))).first()[0] or 0.0

    return training.bpr_fit_fm(lambda epoch, p: pairs, data, start, config, validate)


@query("bpr_fit_fm")
def q_bpr_fit_fm(t: Tables):
    """The best epoch's parameters, and loss and MRR of every epoch."""
    config = training.FmConfig()
    fit = fit_fm(t, config)
    rows = [
        ("history", f"{name}{' (best)' if r['epoch'] == fit.best_epoch else ''}", r["epoch"], round(r[name], 6))
        for r in fit.history for name in ("loss", "mrr")
    ]
    history = t.spark.createDataFrame(rows, "kind string, name string, place int, value double")
    return fm_values(fit.parameters, config.dimension).withColumn("value", F.round("value", 6)).unionByName(history)
