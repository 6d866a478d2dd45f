"""Candidate sets of many session states at once.

Three choices keep this linear in the answers rather than in sessions x catalog:

* sessions that know the same things share one *state*, solved once;
* a candidate set is described by (pool, wanted facts) and pools are named, so a
  state without constraints or one that is rolled back copies no products;
* a state is matched through the postings of its rarest wanted fact, inside its
  pool; its other facts are checked on the product row, which carries its own
  small list of facts.  Hot postings are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.functions import text as X
from facetloom.functions import vocab as V
from facetloom.functions.scalars import shortest_number, stable_hash
from facetloom.session import cut, spread_join


def token(attribute: Column, value: Column) -> Column:
    return F.concat(attribute, F.lit("="), value)


def product_tokens(facts: DataFrame, attributes: tuple[str, ...] | None = None) -> DataFrame:
    """(parent_asin, tokens): the facts of a product as ``attribute=value``."""
    if attributes is not None:
        facts = facts.filter(F.col("attribute").isin(*attributes))
    return facts.groupBy("parent_asin").agg(
        F.collect_set(token(F.col("attribute"), F.col("normalized_value"))).alias("tokens")
    )


def members(pools: DataFrame, tokens: DataFrame) -> DataFrame:
    """(pool, parent_asin, tokens)."""
    none = F.array().cast("array<string>")
    return pools.join(tokens, "parent_asin", "left").withColumn("tokens", F.coalesce("tokens", none))


def with_driver(states: DataFrame, postings: DataFrame) -> DataFrame:
    """Add each state's rarest wanted token as ``driver``; ``missing`` lists unknown ones.

    A state that wants nothing is driven by its whole pool.
    """
    sizes = postings.groupBy("pool", "token").agg(F.count("*").alias("size"))
    rows = states.select("state_key", "pool", F.explode_outer("wanted").alias("token"))
    sized = rows.join(sizes, ["pool", "token"], "left")
    chosen = sized.groupBy("state_key").agg(
        F.min_by("token", F.struct(F.coalesce("size", F.lit(0)), "token")).alias("driver"),
        F.count_if(F.col("token").isNotNull() & F.col("size").isNull()).alias("n_absent"),
    )
    return states.join(chosen, "state_key").withColumn("driver", F.coalesce("driver", F.lit("*")))


def postings_of(pool_members: DataFrame, states: DataFrame) -> DataFrame:
    """(pool, token, parent_asin, tokens) for tokens that some state wants."""
    wanted = F.when(F.size("wanted") > 0, F.col("wanted")).otherwise(F.array(F.lit("*")))
    asked = states.select("pool", F.explode(wanted).alias("token")).distinct()
    rows = pool_members.select(
        "pool", "parent_asin", "tokens", F.explode(F.concat("tokens", F.array(F.lit("*")))).alias("token")
    )
    return rows.join(asked, ["pool", "token"], "left_semi")


def match_all(states: DataFrame, pool_members: DataFrame, keep_open: bool = False) -> DataFrame:
    """(state_key, parent_asin): pool members carrying every wanted token.

    ``states`` has distinct (state_key, pool, wanted).  States that want nothing
    are left out unless ``keep_open``: their set is the pool itself.
    """
    if not keep_open:
        states = states.filter(F.size("wanted") > 0)
    postings = postings_of(pool_members, states)
    driven = with_driver(states, postings).filter(F.col("n_absent") == 0)
    pairs = spread_join(
        postings.withColumnRenamed("token", "driver"),
        driven.select("state_key", "pool", "driver", "wanted"),
        ["pool", "driver"],
        ["parent_asin"],
    )
    return pairs.filter(F.size(F.array_except("wanted", "tokens")) == 0).select("state_key", "parent_asin")


def and_intersect_rollback(
    states: DataFrame, pool_members: DataFrame, tokens: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Survivors, and one outcome row per state.

    Outcome: (state_key, n_survivors, rolled_back, rejected).  A state nothing
    satisfies goes back to its pool and rejects the facts no product has, or all
    wanted facts when each exists somewhere.
    """
    survivors = match_all(states, pool_members)
    counts = survivors.groupBy("state_key").agg(
        F.count("*").alias("n_survivors"), F.min("parent_asin").alias("first_id"),
        F.max("parent_asin").alias("last_id"),
    )
    wanting = states.filter(F.size("wanted") > 0)
    failed = wanting.join(counts, "state_key", "left_anti")
    known = tokens.select(F.explode("tokens").alias("token")).distinct().withColumn("known", F.lit(True))
    rejected = (
        failed.select("state_key", F.explode("wanted").alias("token"))
        .join(known, "token", "left")
        .groupBy("state_key")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("token")))).alias("absent"),
            F.array_sort(F.collect_set("token")).alias("every"),
        )
        .select("state_key", F.when(F.size("absent") > 0, F.col("absent")).otherwise(F.col("every")).alias("rejected"))
    )
    outcome = (
        states.select("state_key", "pool")
        .join(counts, "state_key", "left")
        .join(rejected, "state_key", "left")
        .withColumn("rolled_back", F.col("rejected").isNotNull())
    )
    return survivors, outcome


def pool_summary(pool_members: DataFrame) -> DataFrame:
    return pool_members.groupBy("pool").agg(
        F.count("*").alias("pool_size"), F.min("parent_asin").alias("pool_first"),
        F.max("parent_asin").alias("pool_last"),
    )


def fold_turns(
    turns: DataFrame, pool_members: DataFrame
) -> DataFrame:
    """Accepted facts of every session after every turn.

    ``turns`` has (session_id, pool, turn, values array<string>).  Each turn's
    values are added as one step and dropped again if nothing would be left.
    Result: (session_id, turn, pool, accepted, rolled_back).  Sessions in the
    same situation share one check per turn, and the check only needs to know
    that some product remains.
    """
    none = F.array().cast("array<string>")
    state = turns.groupBy("session_id").agg(F.any_value("pool").alias("pool")).withColumn("accepted", none)
    result = None
    last = turns.agg(F.max("turn")).first()[0] or 0
    for turn in range(1, last + 1):
        values = turns.filter(F.col("turn") == turn).select("session_id", "values")
        tried = state.join(values, "session_id", "left").withColumn(
            "wanted",
            F.array_sort(F.array_union("accepted", F.coalesce("values", none))),
        ).withColumn("state_key", stable_hash(F.col("pool"), F.array_join("wanted", "\x01")))
        states = tried.filter(F.size(F.coalesce("values", none)) > 0).select("state_key", "pool", "wanted").distinct()
        alive = match_all(states, pool_members).select("state_key").distinct().withColumn("alive", F.lit(True))
        step = tried.join(alive, "state_key", "left").select(
            "session_id", "pool", F.lit(turn).alias("turn"), F.col("values").isNotNull().alias("spoke"),
            F.when(F.col("alive"), F.col("wanted")).otherwise(F.col("accepted")).alias("accepted"),
            (F.size(F.coalesce("values", none)) > 0).alias("_asked"), F.coalesce("alive", F.lit(False)).alias("_alive"),
        ).withColumn("rolled_back", F.col("_asked") & ~F.col("_alive")).drop("_asked", "_alive")
        # Each turn reads the previous one twice: cut, or the plan doubles per turn.
        step = cut(step)
        result = step if result is None else result.unionByName(step)
        state = step.select("session_id", "pool", "accepted")
    if result is None:
        return turns.select("session_id", "pool", "turn", none.alias("accepted"), F.lit(False).alias("rolled_back"))
    return result.filter("spoke").drop("spoke")


def or_union_filter(candidates: DataFrame, alternatives: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Keep candidates with any alternative; a key without a match keeps all.

    ``alternatives``: (key, attribute, normalized_value).
    """
    tokens = product_tokens(
        facts.join(
            alternatives.select("attribute", "normalized_value").distinct(),
            ["attribute", "normalized_value"], "left_semi",
        )
    )
    wanted = alternatives.groupBy(key).agg(
        F.collect_set(token(F.col("attribute"), F.col("normalized_value"))).alias("wanted")
    )
    none = F.array().cast("array<string>")
    judged = spread_join(
        candidates.join(tokens, "parent_asin", "left"), wanted, [key], ["parent_asin"], "left"
    ).withColumn("hit", F.coalesce(F.arrays_overlap("wanted", F.coalesce("tokens", none)), F.lit(False)))
    matched = judged.filter("hit").select(key).distinct().withColumn("matched", F.lit(True))
    return (
        spread_join(judged, matched, [key], ["parent_asin"], "left")
        .filter(F.col("hit") | F.col("matched").isNull())
        .select(key, "parent_asin")
    )


def exclude_values(candidates: DataFrame, exclusions: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Drop candidates carrying an excluded value of their key."""
    tokens = product_tokens(
        facts.join(
            exclusions.select("attribute", "normalized_value").distinct(),
            ["attribute", "normalized_value"], "left_semi",
        )
    )
    unwanted = exclusions.groupBy(key).agg(
        F.collect_set(token(F.col("attribute"), F.col("normalized_value"))).alias("unwanted")
    )
    none = F.array().cast("array<string>")
    judged = spread_join(
        candidates.join(tokens, "parent_asin", "left"), unwanted, [key], ["parent_asin"], "left"
    )
    hit = F.coalesce(F.arrays_overlap("unwanted", F.coalesce("tokens", none)), F.lit(False))
    return judged.filter(~hit).select(key, "parent_asin")


STEP = "array<struct<attribute:string,values:array<string>>>"


def rebuild_candidates(
    states: DataFrame, pools: DataFrame, facts: DataFrame, products: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Fail-closed candidates of free-form states: survivors and outcomes.

    ``states``: distinct (state_key, labels, hard, alternatives, excluded,
    max_price, inclusive) where the middle three are ordered arrays of
    (attribute, values).  ``pools``: (label, parent_asin).  Steps run in the
    order hard, alternatives, excluded, price.  The outcome tells at which step
    a state became empty and why; exclusions are only blamed when they removed
    the last products.  An excluded category that resolves to no pool removes
    nothing.
    """
    none = F.array().cast("array<string>")
    hard_facts = product_tokens(facts, V.HARD_ATTRIBUTES)
    labels = pools.groupBy("parent_asin").agg(
        F.collect_set(token(F.lit("category"), F.col("label"))).alias("label_tokens")
    )
    rows = (
        pools.withColumnRenamed("label", "pool")
        .join(hard_facts, "parent_asin", "left")
        .join(labels, "parent_asin")
        .join(products.select("parent_asin", "price"), "parent_asin")
        .withColumn("tokens", F.concat(F.coalesce("tokens", none), "label_tokens"))
        .drop("label_tokens")
    )
    usable = F.filter("alternatives", lambda a: a["attribute"].isin(*V.HARD_ATTRIBUTES))
    removing = F.filter("excluded", lambda a: a["attribute"].isin("category", *V.HARD_ATTRIBUTES))
    states = states.withColumn("alternatives", usable).withColumn("excluded", removing)

    def step_tokens(step: Column) -> Column:
        return F.transform(step["values"], lambda v: token(step["attribute"], v))

    drivers = (
        F.when(F.size("hard") > 0, F.slice(step_tokens(F.get("hard", F.lit(0))), 1, 1))
        .when(F.size("alternatives") > 0, step_tokens(F.get("alternatives", F.lit(0))))
        .otherwise(F.array(F.lit("*")))
    )
    driven = states.withColumn("pool", F.explode("labels")).withColumn("driver", F.explode(drivers))
    asked = driven.select("pool", "driver").distinct()
    postings = rows.withColumn("driver", F.explode(F.concat("tokens", F.array(F.lit("*"))))).join(
        asked, ["pool", "driver"], "left_semi"
    )
    pairs = spread_join(postings, driven.drop("labels"), ["pool", "driver"], ["parent_asin"])
    under = F.when(F.col("inclusive"), F.col("price") <= F.col("max_price")).otherwise(
        F.col("price") < F.col("max_price")
    )
    verdicts = F.concat(
        F.transform("hard", lambda h: F.size(F.array_except(step_tokens(h), "tokens")) == 0),
        F.transform("alternatives", lambda a: F.arrays_overlap(step_tokens(a), "tokens")),
        F.transform("excluded", lambda e: ~F.arrays_overlap(step_tokens(e), "tokens")),
        F.array(F.col("max_price").isNull() | F.coalesce(under, F.lit(False))),
    )
    judged = pairs.select("state_key", "parent_asin", F.array_position(verdicts, False).alias("failed_at"))
    survivors = judged.filter(F.col("failed_at") == 0).select("state_key", "parent_asin").distinct()
    counts = survivors.groupBy("state_key").agg(
        F.count("*").alias("n"), F.min("parent_asin").alias("first_id"), F.max("parent_asin").alias("last_id")
    )
    # A product outside the driver's postings fails the first step.
    last_failure = judged.groupBy("state_key").agg(F.max("failed_at").alias("emptied_at"))
    first_step = F.when(drivers[0] == "*", 0).otherwise(1)
    outcome = (
        states.join(counts, "state_key", "left")
        .join(last_failure, "state_key", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("emptied_at", F.coalesce("emptied_at", first_step))
    )

    def reasons(steps: str, offset: Column, prefix: str, only_at: bool) -> Column:
        def spell(step: Column, i: Column) -> Column:
            at = offset + i + 1
            blamed = (at == F.col("emptied_at")) if only_at else (at >= F.col("emptied_at"))
            texts = F.transform(step["values"], lambda v: F.concat(step["attribute"], F.lit(":" + prefix), v))
            return F.when(blamed, texts).otherwise(none)

        return F.flatten(F.transform(steps, spell))

    h, a, e = F.size("hard"), F.size("alternatives"), F.size("excluded")
    price_reason = F.when(
        F.col("max_price").isNotNull(),
        F.array(F.concat(F.lit("budget:maximum:"), shortest_number(F.col("max_price")))),
    ).otherwise(none)
    blame = F.concat(
        reasons("hard", F.lit(0), "", False),
        reasons("alternatives", h, "", False),
        reasons("excluded", h + a, "excluded:", True),
        F.when(h + a + e + 1 >= F.col("emptied_at"), price_reason).otherwise(none),
    )
    empty = F.col("n") == 0
    outcome = outcome.select(
        "state_key", "n", "first_id", "last_id",
        F.when(empty, F.array_sort(F.array_distinct(blame))).otherwise(none).alias("reasons"),
        (empty & ((h + a + e > 0) | F.col("max_price").isNotNull())).alias("conflict"),
    )
    return survivors, outcome


def evidence_of(profile: DataFrame) -> DataFrame:
    """(parent_asin, evidence): constraints under their own attribute and ``other``."""
    return profile.select(
        "parent_asin",
        F.array_distinct(
            F.concat(
                F.transform("constraints", lambda c: token(c["attribute"], c["value"])),
                F.transform("constraints", lambda c: token(F.lit("other"), c["value"])),
            )
        ).alias("evidence"),
    )


def evidence_match(candidates: DataFrame, states: DataFrame, evidence: DataFrame) -> DataFrame:
    """Known constraints a candidate satisfies, and whether that equals the target.

    ``states``: (state_id, target, known array<string>), one row per state.
    """
    goal = states.join(
        evidence.withColumnsRenamed({"parent_asin": "target", "evidence": "target_evidence"}), "target"
    ).select(
        "state_id", F.array_distinct("known").alias("known"),
        F.size(F.array_intersect("known", "target_evidence")).alias("needed"),
    )
    rows = candidates.join(evidence, "parent_asin")
    return spread_join(rows, goal, ["state_id"], ["parent_asin"]).select(
        "state_id", "parent_asin",
        F.size(F.array_intersect("known", "evidence")).alias("matched"), "needed",
    ).withColumn("indistinguishable", F.col("matched") >= F.col("needed"))


def shared_evidence_match(
    sets: DataFrame, states: DataFrame, evidence: DataFrame, also: tuple[str, ...] = ()
) -> DataFrame:
    """``evidence_match`` of states that share candidate sets, which are never copied per state before the last join.

    ``sets``: (state_key, parent_asin); ``states``: (state_id, state_key, target, known);
    further columns of both are kept, those in ``also`` have to be equal.  What a product
    matches is found once for all states of a set that know the same things; both sides of
    the join that makes the pairs grow with products and states, and nothing shuffles the pairs.
    """
    known = states.withColumn("known", F.array_distinct("known")).withColumn("_known", F.sha2(F.to_json(F.struct("known")), 256))
    distinct = known.select("state_key", "_known", "known").distinct()
    rows = spread_join(sets.join(evidence, "parent_asin"), distinct, ["state_key"], ["parent_asin"]).withColumn(
        "matched", F.size(F.array_intersect("known", "evidence"))
    ).drop("known", "evidence")
    goal = known.join(
        evidence.withColumnsRenamed({"parent_asin": "target", "evidence": "target_evidence"}), "target"
    ).withColumn("needed", F.size(F.array_intersect("known", "target_evidence"))).drop("known", "target_evidence")
    return spread_join(rows, goal, ["state_key", "_known", *also], ["parent_asin"]).drop("state_key", "_known").withColumn(
        "indistinguishable", F.col("matched") >= F.col("needed")
    )


def answer_split(replies: DataFrame, facts: DataFrame) -> DataFrame:
    """(session_id, turn, position, value) of a ``;`` separated reply.

    ``replies``: (session_id, turn, attribute, payload).  The whole payload wins
    if it is a known value; else the first cut with two known halves; else every
    piece.
    """
    base = replies.withColumn("payload", X.clean_text(F.col("payload"), None)).filter(F.col("payload") != "")
    pieces = F.split("payload", r";\s+")
    cuts = F.transform(
        F.sequence(F.lit(1), F.size("pieces") - 1),
        lambda i: F.struct(
            i.alias("cut"),
            X.clean_text(F.array_join(F.slice("pieces", 1, i), "; "), None).alias("left"),
            X.clean_text(F.array_join(F.slice("pieces", i + 1, F.size("pieces")), "; "), None).alias("right"),
        ),
    )
    whole = F.array(F.struct(F.lit(0).alias("cut"), F.col("payload").alias("left"), F.col("payload").alias("right")))
    options = base.withColumn("pieces", pieces).withColumn(
        "option", F.explode(F.when(F.size("pieces") > 1, F.concat(whole, cuts)).otherwise(whole))
    )
    known = facts.select("attribute", "normalized_value").distinct()
    asked = (
        options.select("attribute", F.explode(F.array("option.left", "option.right")).alias("text"))
        .distinct()
        .transform(X.with_normalized, "text", "normalized_value")
        .join(known, ["attribute", "normalized_value"], "left_semi")
        .select("attribute", "text")
        .distinct()
    )
    left = asked.select("attribute", F.col("text").alias("l"), F.lit(True).alias("known_left"))
    right = asked.select("attribute", F.col("text").alias("r"), F.lit(True).alias("known_right"))
    tried = (
        options.withColumn("l", F.col("option.left")).withColumn("r", F.col("option.right"))
        .join(left, ["attribute", "l"], "left")
        .join(right, ["attribute", "r"], "left")
    )
    both = F.col("known_left") & F.col("known_right")
    best = tried.groupBy("session_id", "turn").agg(
        F.any_value("payload").alias("payload"), F.any_value("pieces").alias("pieces"),
        F.min(F.when(both, F.struct("option.cut", "l", "r"))).alias("best"),
    )
    cleaned = F.filter(F.transform("pieces", lambda p: X.clean_text(p, None)), lambda p: p != "")
    values = (
        F.when(F.col("best.cut") == 0, F.array("payload"))
        .when(F.col("best").isNotNull(), F.array("best.l", "best.r"))
        .otherwise(cleaned)
    )
    return best.select("session_id", "turn", F.posexplode(values).alias("position", "value"))
