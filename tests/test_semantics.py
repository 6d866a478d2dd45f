"""Edge cases on literal rows: expected values are stated, not computed."""

import json
import random

import pytest
from pyspark.sql import functions as F

from facetloom.functions import scalars as S
from facetloom.functions import text as X
from facetloom.functions import vocab as V
from facetloom.functions.stem import fold_and_stem
from facetloom.operators import candidates as K
from facetloom.operators import catalog as C
from facetloom.operators import dataset as D
from facetloom.operators import features, metrics, ordering, questions, retrieval
from facetloom.operators import sessions as N
from facetloom.operators import training
from facetloom.operators import utterances as U
from facetloom.plans import QUERIES
from facetloom.sources.catalog import read_catalog
from facetloom.sources.sinks import write_audit_csv, write_facts
from facetloom.streaming import edits as stream


def one(df):
    return df.collect()[0]


def evaluate(spark, expression, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>").alias(k) for k, v in columns.items()])
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "names, expected",
    [
        (["Clothing, Shoes & Jewelry", "Men", "Shoes"], "Men Shoes"),
        ([], "clothing item"), (["Only"], "Only"), (["a, b", "c"], "b c"),
    ],
)
def test_coarse_category(spark, names, expected):
    assert evaluate(spark, X.coarse_category(F.col("c")), c=names) == expected


@pytest.mark.parametrize(
    "value, conversation, catalog",
    [
        ("Brown", "feature", "color"), ("tailored", "color", "color"), ("under 50 wool", "budget", "budget"),
        ("network", "use_case", "use_case"), ("benefit", "style", "style"), ("Size 3 cotton", "material", "material"),
    ],
)
def test_classify(spark, value, conversation, catalog):
    assert evaluate(spark, X.classify_constraint(F.col("c")), c=value) == conversation
    assert evaluate(spark, X.classify_constraint(F.col("c"), V.COLORS), c=value) == catalog


def test_buckets(spark):
    for rating, expected in ((4.25, "4.0"), (4.75, "5.0"), (None, "missing")):
        assert evaluate(spark, S.rating_bucket(F.col("r").cast("double")), r=rating) == expected
    for count, expected in ((0, "0"), (1, "1"), (2, "1"), (3, "2"), (10**9, "16"), (None, "missing")):
        assert evaluate(spark, S.popularity_bucket(F.col("n").cast("long")), n=count) == expected
    assert evaluate(spark, S.stable_int(F.lit("split"), F.lit("2026"), F.col("k")).cast("string"), k="P1") == str(
        int.from_bytes(__import__("hashlib").sha256(b"split\x002026\x00P1").digest()[:8], "big")
    )


def test_unicode_normalisation(spark):
    assert evaluate(spark, X.normalize_value(F.col("c"), unicode=True), c="Ｓtraße  Ⅷ x") == "strasse viii x"
    assert evaluate(spark, X.clean_text(F.col("c")), c="  - a \tb;,") == "a b"


def test_read_catalog(spark, tmp_path):
    lines = [
        {"parent_asin": " A ", "title": "red widget", "features": ["a", "b"], "price": 12.0, "description": "one text"},
        {"parent_asin": "B", "title": "t", "price": "12", "details": {"Brand Name": "Zed"}, "description": ["x", "y"]},
        {"parent_asin": "C", "price": True}, {"parent_asin": "D", "price": 30},
    ]
    path = tmp_path / "c.jsonl"
    path.write_text("\n\n".join(json.dumps(x) for x in lines) + "\n")
    rows = {r["parent_asin"]: r for r in read_catalog(spark, str(path)).collect()}
    assert [rows[k]["price"] for k in "ABCD"] == [12.0, None, None, 30.0]
    assert [rows[k]["price_text"] for k in "ABCD"] == ["12.0", "12", "True", "30"]
    assert rows["A"]["description"] == ["one text"] and rows["B"]["description"] == ["x", "y"]
    cards = {r["parent_asin"]: r["hard_constraints"] + r["soft_preferences"] for r in C.intent_card(read_catalog(spark, str(path))).collect()}
    assert cards["A"] == ["a", "color: red", "b", "budget around $12.0"]
    assert cards["C"] == ["budget around $True"] * 2
    facts = C.attribute_facts(read_catalog(spark, str(path)))
    assert {r[0] for r in facts.filter("parent_asin = 'B' and attribute = 'brand'").select("display_value").collect()} == {"Zed"}
    out = str(tmp_path / "facts")
    write_facts(facts, out)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_facts(facts, out)
    write_facts(facts, out, overwrite=True)
    empty = str(tmp_path / "csv")
    write_audit_csv(spark.createDataFrame([], "a string, b int"), empty, ["a"])
    assert spark.read.option("header", True).csv(empty).columns == ["a", "b"]


PARSES = [
    ("max $1,200 please", dict(max_price=1200.0, inclusive=True)),
    ("under $30", dict(max_price=30.0, inclusive=False)), ("up to $30", dict(max_price=30.0, inclusive=True)),
    ("$30 max", dict(max_price=None)),
    ("no leather or wool", dict(excluded={"material": ["leather", "wool"]}, required={})),
    ("black or white", dict(alternatives={"color": ["black", "white"]}, required={})),
    ("black and white", dict(required={"color": ["black", "white"]}, alternatives={})),
    ("faux leather belt", dict(required={}, category="belts")), ("leather-like", dict(required={})),
    ("black tie", dict(required={})), ("jet-black boots", dict(required={"color": ["black"]}, category="boots")),
    ("Cotton On tee", dict(required={"brand": ["Cotton On"]})),
    ("footwear for road runners", dict(category="running shoes")),
    ("shoes for jogging", dict(category="running shoes", required={"use_case": ["running"]})),
    ("size 9 or 10", dict(alternatives={"size": ["9", "10"]})), ("size is xl", dict(required={"size": ["xl"]})),
    ("any color is fine, red", dict(required={}, removed=["color"])),
    ("no budget limit", dict(removed=["budget"])), ("cheap hats", dict(qualitative_budget="affordable", intent="buying")),
    ("show me some cool things", dict(intent="browsing")), ("hello there", dict(intent="unknown", category=None)),
    ("anything but sandals", dict(excluded={"category": ["sandals"]}, category=None)),
    ("cotton-free socks", dict(excluded={"material": ["cotton"]}, category="socks")),
    ("either comfy or lightweight", dict(alternatives={"feature": ["comfort", "lightweight"]})),
]


def test_parse_messages(spark):
    messages = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(PARSES)], "message_id int, text string")
    brands = spark.createDataFrame([("Cotton On",), ("No",), ("Silk",)], "brand string")
    rows = {r["message_id"]: r for r in U.parse_messages(messages, brands).collect()}
    for i, (text, expected) in enumerate(PARSES):
        for key, value in expected.items():
            got = rows[i][key]
            if isinstance(value, dict):
                got = {s["attribute"]: s["values"] for s in got}
            assert got == value, (text, key, got)


def test_openings(spark):
    rows = [
        ("I'm looking for Men Shoes. A key requirement is: red; soft.", ("buying", "Men Shoes", "red; soft")),
        ("I’m looking for Hats, but I'm still exploring.", ("exploring_unknown", "Hats", None)),
        ("I am looking for Hats. I like wool", ("provisional_override", "Hats", "I like wool")),
        ("hats", ("unknown", "hats", None)),
    ]
    for text, expected in rows:
        assert tuple(evaluate(spark, U.template_extract(F.col("t")), t=text)) == expected
    assert evaluate(spark, U.override_replacement(F.col("t")), t="Actually, changed my mind: red.") == "red"
    assert evaluate(spark, U.override_replacement(F.col("t")), t="plain") is None
    assert evaluate(spark, U.opening_intent(F.col("t")), t="hats. a key requiremant is: red") == "buying"
    assert evaluate(spark, U.opening_intent(F.col("t")), t="I want hats") == "unknown"


def test_contextual_answer(spark):
    rows = [
        (1, "budget", "about $1,250", "max_price", "1250"), (2, "size", "Extra Large", "value", "extra large"),
        (3, "brand", "ACME", "value", "ACME"), (4, "brand", "nobody", None, None),
        (5, "color", "whatever", "remove", "color"), (6, "use_case", "my garden", "value", "my garden"),
        (7, "budget", "plenty", None, None), (8, None, "red", None, None),
    ]
    replies = spark.createDataFrame([(r[0], 1, r[1], r[2]) for r in rows], "session_id int, turn int, asked string, text string")
    facts = spark.createDataFrame([("brand", "acme")], "attribute string, normalized_value string")
    got = {r["session_id"]: (r["outcome"], r["answer"]) for r in U.contextual_answer(replies, facts).collect()}
    assert got == {r[0]: (r[3], r[4]) for r in rows}


def members_of(spark):
    rows = [("c", "P1", ["color=red", "other=x"]), ("c", "P2", ["color=red"]), ("c", "P3", ["color=blue"]), ("d", "P4", ["color=red"])]
    members = spark.createDataFrame(rows, "pool string, parent_asin string, tokens array<string>")
    return members, members.select("parent_asin", "tokens")


def test_rollback(spark):
    members, tokens = members_of(spark)
    states = spark.createDataFrame(
        [("s1", "c", ["color=red", "other=x"]), ("s2", "c", ["color=red", "color=blue"]), ("s3", "c", ["color=red", "gone=1"]), ("s4", "c", [])],
        "state_key string, pool string, wanted array<string>",
    )
    survivors, outcome = K.and_intersect_rollback(states, members, tokens)
    assert {tuple(r) for r in survivors.collect()} == {("s1", "P1")}
    got = {r["state_key"]: (r["rolled_back"], r["rejected"]) for r in outcome.collect()}
    assert got == {"s1": (False, None), "s2": (True, ["color=blue", "color=red"]), "s3": (True, ["gone=1"]), "s4": (False, None)}


def test_fold_turns_rolls_back_one_turn_only(spark):
    members, _ = members_of(spark)
    turns = spark.createDataFrame(
        [(1, "c", 1, ["color=red"]), (1, "c", 2, ["color=blue"]), (1, "c", 3, ["other=x"])],
        "session_id int, pool string, turn int, values array<string>",
    )
    got = {r["turn"]: (r["accepted"], r["rolled_back"]) for r in K.fold_turns(turns, members).collect()}
    assert got == {1: (["color=red"], False), 2: (["color=red"], True), 3: (["color=red", "other=x"], False)}


def test_rebuild_fails_closed(spark):
    pools = spark.createDataFrame([("hats", f"P{i}") for i in range(1, 5)], "label string, parent_asin string")
    facts = spark.createDataFrame(
        [("color", "red", "P1"), ("color", "blue", "P2"), ("color", "red", "P3"), ("brand", "z", "P3")],
        "attribute string, normalized_value string, parent_asin string",
    )
    prices = spark.createDataFrame([("P1", 10.0), ("P2", 20.0), ("P3", 30.0), ("P4", None)], "parent_asin string, price double")
    schema = f"state_key string, labels array<string>, hard {K.STEP}, alternatives {K.STEP}, excluded {K.STEP}, max_price double, inclusive boolean"
    step = lambda a, *v: [(a, list(v))]
    rows = [
        ("red", ["hats"], step("color", "red"), [], [], None, False), ("cheap", ["hats"], [], [], [], 10.0, True),
        ("cheaper", ["hats"], [], [], [], 10.0, False), ("or", ["hats"], [], step("color", "red", "blue"), step("brand", "z"), None, False),
        ("both", ["hats"], step("color", "red", "blue"), [], [], None, False), ("none", ["hats"], [], [], step("category", "hats"), None, False),
        ("odd", ["hats"], [], [], step("category", "boats"), None, False),
    ]
    survivors, outcome = K.rebuild_candidates(spark.createDataFrame(rows, schema), pools, facts, prices)
    got = {}
    for r in survivors.collect():
        got.setdefault(r["state_key"], set()).add(r["parent_asin"])
    assert got == {"red": {"P1", "P3"}, "cheap": {"P1"}, "or": {"P1", "P2"}, "odd": {"P1", "P2", "P3", "P4"}}
    reasons = {r["state_key"]: r["reasons"] for r in outcome.collect()}
    assert reasons["cheaper"] == ["budget:maximum:10"] and reasons["none"] == ["category:excluded:hats"]
    assert reasons["both"] == ["color:blue", "color:red"] and reasons["red"] == []


def test_rrf_ties_and_weights(spark):
    rows = [(1, 0, 1, "b", 1.0), (1, 0, 1, "b", 1.0), (1, 1, 1, "a", 1.0), (1, 2, 1, "z", 0.0)]
    lists = spark.createDataFrame(rows, "query_id int, source int, rank int, id string, weight double")
    assert [r["id"] for r in retrieval.rrf_fuse(lists).orderBy("rank").collect()] == ["b", "a"]


def test_hybrid_rank_falls_back_to_lexical(spark):
    lst = lambda rows: spark.createDataFrame(rows, "query_id int, id string, rank int")
    base, lexical = lst([(1, "a", 1), (1, "b", 2), (2, "a", 1)]), lst([(1, "b", 1)])
    dense = lst([(2, "q", 1)])
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.hybrid_rank(base, lexical, dense, "dense").collect()}
    assert got == {(1, 1): "b", (1, 2): "a", (2, 1): "q", (2, 2): "a"}


def test_posterior_and_entropy(spark):
    scores = spark.createDataFrame([("k", "a", 1.0), ("n", "a", float("nan")), ("n", "b", 1.0)], "k string, parent_asin string, score double")
    got = {(r["k"], r["parent_asin"]): r["p"] for r in questions.posterior(scores, "k").collect()}
    assert got == {("k", "a"): 1.0, ("n", "a"): 0.5, ("n", "b"): 0.5}


def test_metrics_edges(spark):
    schema = "session_id int, scenario string, hit boolean, first_hit_turn int, reciprocal_rank double"
    row = one(metrics.session_metrics(spark.createDataFrame([], schema)))
    assert (row["n"], row["hit_rate_at_10"], row["mrr"], row["mttc"]) == (0, 0.0, 0.0, None)
    rows = spark.createDataFrame([(1, "buying", True, 2, 0.5), (2, "buying", False, None, 0.0)], schema)
    row = one(metrics.session_metrics(rows).filter("scenario = 'all'"))
    assert (row["hit_rate_at_10"], row["mttc"], row["efficiency"], row["score"]) == (0.5, 6.5, 0.45, 0.415)
    scores = spark.createDataFrame([("k", "a", 1.0)], "k string, parent_asin string, score double")
    row = one(metrics.target_rank(scores, spark.createDataFrame([("k", "a")], "k string, target string"), "k"))
    assert (row["rank"], row["width"], row["pairwise_accuracy"]) == (1, 1, 1.0)


def test_splits(spark):
    assert D.largest_remainder(7, V.SPLIT_QUOTAS) == {"train": 5, "validation": 1, "test": 1}
    # Many categories of one product: some would have no training product without a trade.
    sizes = {f"c{i}": 1 if i % 3 else 1 + (i * 7) % 23 for i in range(60)}
    products = spark.createDataFrame([(f"{c}-{k}", c) for c, n in sizes.items() for k in range(n)], "parent_asin string, category string")
    rows = D.stratified_split(products).collect()
    total = sum(sizes.values())
    assert len(rows) == total == len({r["parent_asin"] for r in rows})
    for split, n in D.largest_remainder(total, V.SPLIT_QUOTAS).items():
        assert sum(r["split"] == split for r in rows) == n
    assert {r["category"] for r in rows if r["split"] == "train"} == set(sizes)
    assert D.stratified_split(products.where("false")).count() == 0


def test_stratified_split_covers(spark):
    products = spark.range(500).select(
        F.format_string("P%d", "id").alias("parent_asin"), F.when(F.col("id") < 300, "hot").otherwise(F.format_string("c%d", F.col("id") % 7)).alias("category")
    )
    splits = D.stratified_split(products)
    assert splits.count() == 500 and splits.select("parent_asin").distinct().count() == 500
    assert D.split_integrity(splits, products).count() == 0
    assert {r["split"]: r["count"] for r in splits.groupBy("split").count().collect()} == {"train": 400, "validation": 50, "test": 50}


def test_quota_prefixes_nest(spark):
    rows = spark.range(50).withColumnRenamed("id", "p")
    label = lambda n: [r["label"] for r in D.exact_quota_labels(rows.filter(F.col("p") < n), "p", n, V.SCENARIO_MIXES["public"], "x").orderBy("p").collect()]
    assert label(50)[:40] == label(40)
    assert {v: label(20).count(v) for v in V.SCENARIOS} == V.SCENARIO_MIXES["public"]
    assert {v: label(50)[40:].count(v) for v in V.SCENARIOS} == D.largest_remainder(10, V.SCENARIO_MIXES["public"])


def test_negatives_respect_the_rules(spark):
    pool = spark.range(400).select(
        F.lit("s").alias("state_id"), F.lit("T").alias("target"), F.format_string("P%03d", "id").alias("parent_asin"),
        F.lit("train").alias("split"), (F.col("id") < 10).alias("tie"),
    )
    scores = pool.select("state_id", "parent_asin", F.rand(3).alias("score"))
    shared = pool.select("state_id", "parent_asin", (F.hash("parent_asin") % 5).alias("shared"))
    rows = D.survivor_negatives(pool, scores, shared).collect()
    kinds = [r["sampler"] for r in rows]
    assert {k: kinds.count(k) for k in set(kinds)} == {"model_hard": 8, "near_match": 4, "random": 4}
    assert len({r["parent_asin"] for r in rows}) == 16 and not any(r["tie"] for r in rows)
    few = D.survivor_negatives(pool.limit(20).filter(~F.col("tie")), scores, shared).collect()
    assert {r["sampler"] for r in few} == {"all"}


def test_negatives_ask_for_the_pre_pool_only(spark):
    pool = spark.range(300).select(
        F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("state_id"), F.lit("t").alias("target"),
        F.format_string("p%03d", (F.col("id") / 2).cast("int")).alias("parent_asin"), (F.col("id") % 7 == 0).alias("tie"),
    )
    score = lambda rows: rows.select("state_id", "parent_asin", (F.crc32("parent_asin") / F.lit(2.0**32)).alias("score"))
    shared = lambda rows: rows.select("state_id", "parent_asin", (F.crc32(F.reverse("parent_asin")) % 5).cast("int").alias("shared"))
    asked = []

    def seen(of):
        def ask(rows):
            asked.append(rows.groupBy("state_id").count().agg(F.max("count")).first()[0])
            return of(rows)

        return ask

    got = D.survivor_negatives(pool, seen(score), seen(shared), pre_pool=20)
    want = D.survivor_negatives(pool, score(pool), shared(pool), pre_pool=20)
    assert sorted(got.collect()) == sorted(want.collect()) and asked == [20, 20]


def test_shared_evidence_is_the_evidence_of_each_state(spark):
    evidence = spark.createDataFrame(
        [(f"p{k}", [f"a={k % 2}", f"b={k % 3}", None if k % 4 else "c=0"]) for k in range(12)], "parent_asin string, evidence array<string>"
    )
    states = spark.createDataFrame(
        [(f"s{k}", f"k{k % 2}", f"p{k % 5}", [["a=0", "a=0", "b=1"], ["a=0", None], [], ["b=2", "c=0"]][k % 4]) for k in range(16)],
        "state_id string, state_key string, target string, known array<string>",
    )
    sets = evidence.select("parent_asin", F.explode(F.array(F.lit("k0"), F.lit("k1"))).alias("state_key")).where("state_key = 'k0' OR parent_asin < 'p5'")
    got = K.shared_evidence_match(sets, states, evidence)
    names = ["state_id", "parent_asin", "matched", "needed", "indistinguishable"]
    each = states.select("state_id", "state_key").join(sets, "state_key").drop("state_key")
    want = K.evidence_match(each, states.drop("state_key"), evidence)
    assert sorted(got.select(names).collect()) == sorted(want.select(names).collect())
    # Nothing shuffles the pairs: above the join that makes them there is no exchange.
    plan = got._jdf.queryExecution().sparkPlan().toString()
    ensured = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in ensured[: ensured.index("Join")] and "_known" in plan


def test_numbering_equals_row_number(spark):
    rows = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("k"), ((F.col("id") * 7919) % 3001).alias("o"))
    got = ordering.numbered(rows, ["k"], [F.col("o")], ordering.int_block(F.col("o"), 100))
    bad = got.groupBy("k").agg(F.count_distinct("rn").alias("d"), F.max("rn").alias("m"), F.count("*").alias("n")).filter("d <> n or m <> n")
    assert bad.count() == 0
    summed = ordering.running_sum(rows, ["k"], [F.col("o")], ordering.int_block(F.col("o"), 100), F.lit(1), "s")
    assert summed.join(got, ["k", "o"]).filter("s <> rn").count() == 0


def replay(rows):
    """Plain in-order fold of one session's edits."""
    state = {}
    for _, op, attribute, value in sorted(rows):
        if op == "clear":
            state.clear()
            continue
        positive, excluded = state.setdefault(attribute, ({}, set()))
        if op == "remove":
            state.pop(attribute)
        elif op == "exclude":
            positive.pop(value, None)
            excluded.add(value)
        else:
            positive.clear()
            positive[value] = "required" if op == "set" else "alternative"
            excluded.discard(value)
    return {(a, v, r) for a, (p, x) in state.items() for v, r in [*p.items(), *[(v, "excluded") for v in x]]}


def test_folds_agree_with_replay(spark):
    rng = random.Random(5)
    ops = ("set", "alternatives", "exclude", "remove", "set", "exclude", "clear")
    weights = (6, 4, 6, 1, 6, 6, 1)
    sessions = {s: [(i, rng.choices(ops, weights)[0], rng.choice("ab"), rng.choice("uvw")) for i in range(rng.randint(1, 25))] for s in range(60)}
    edits = spark.createDataFrame([(s, *r) for s, rows in sessions.items() for r in rows], "session_id long, seq long, op string, attribute string, value string")
    batch = {}
    for r in N.fold_edits_batch(edits).collect():
        batch.setdefault(r["session_id"], set()).add((r["attribute"], r["value"], r["role"]))
    for s, rows in sessions.items():
        want = replay(rows)
        assert batch.get(s, set()) == want
        mixed = rows[:]
        rng.shuffle(mixed)
        half = len(mixed) // 2
        state = stream.merge(json.loads(json.dumps(stream.merge({}, mixed[:half]))), mixed[half:])
        assert set(stream.current(state)) == want


def test_recent_fragments(spark):
    said = ["a", "b", "A", "c", "d", "a"]
    turns = spark.createDataFrame([(1, i, t, False) for i, t in enumerate(said)] + [(2, 0, "x", False), (2, 1, "y", True), (2, 2, None, False)], "session_id int, turn int, fragment string, clears boolean")
    got = {r["session_id"]: r["fragments"] for r in N.recent_fragments(turns).collect()}
    assert got == {1: ["c", "d", "a"], 2: ["y"]}


def test_stemmer():
    words = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "happy": "happi", "adoption": "adopt", "été": "et", "running": "run", "generalizations": "gener"}
    assert {w: fold_and_stem(w) for w in words} == words


def test_linear_ranker_learns(spark):
    rows = [(["good", "x"], ["bad", "x"], 1.0)] * 40 + [(["good"], ["fine"], 1.0)] * 20
    pairs = spark.createDataFrame(rows, "positive array<string>, negative array<string>, weight double")
    w = {r["name"]: r["weight"] for r in training.bpr_fit_linear(pairs).collect()}
    assert w["good"] > 0 > w["bad"] and abs(w.get("x", 0.0)) < 1e-6


def fm_case(spark):
    """Three pairs over small tables, and the loss of given parameters by hand."""
    import numpy as np

    contexts = {"k1": ["c1", "c2"], "k2": ["c3"]}
    products = {"a": ["i1", "i2"], "b": ["i3", "i4"], "c": ["i2", "i4"]}
    crossed = {("k1", "a"): ["x1"], ("k1", "b"): ["x2"], ("k2", "b"): ["x1", "x2"]}
    pairs = [("k1", "a", "b", 2.0), ("k2", "c", "b", 1.0), ("k3", "a", "c", 0.5)]
    flat = lambda table: [(*(k if isinstance(k, tuple) else (k,)), n) for k, names in table.items() for n in names]
    data = training.FmData(
        spark.createDataFrame(flat(contexts), "context string, name string"),
        spark.createDataFrame(flat(products), "product string, name string"),
        spark.createDataFrame(flat(crossed), "context string, product string, name string"),
    )
    names = [("context", n) for n in ("c1", "c2", "c3", "c4")] + [("item", f"i{k}") for k in range(1, 5)] + [("cross", "x1"), ("cross", "x2")]

    def loss(p):
        def score(k, x):
            s = sum((p["item", i] for i in products[x]), np.zeros(4))
            q = sum((p["item", i] ** 2 for i in products[x]), np.zeros(4))
            c = sum((p["context", n] for n in contexts.get(k, [])), np.zeros(4))
            return s[0] + 0.5 * (s[1:] ** 2 - q[1:]).sum() + c[1:] @ s[1:] + sum(p["cross", n][0] for n in crossed.get((k, x), []))

        return sum(w * np.logaddexp(0.0, -(score(k, a) - score(k, b))) for k, a, b, w in pairs)

    return data, spark.createDataFrame(names, "kind string, name string"), spark.createDataFrame(
        pairs, "context string, positive string, negative string, weight double"
    ), loss


def slope(loss, p, key, place):
    up, down = ({**p, key: p[key].copy()} for _ in range(2))
    up[key][place] += 1e-5
    down[key][place] -= 1e-5
    return (loss(up) - loss(down)) / 2e-5


def used_places(kind):
    return {"context": (1, 2, 3), "item": (0, 1, 2, 3), "cross": (0,)}[kind]


def test_fm_gradient_matches_differences(spark):
    import numpy as np

    data, names, pairs, loss = fm_case(spark)
    drawn = training.start_parameters(names, 3)
    # Larger numbers than a start has, and weights that are not zero.
    start = drawn.withColumn("v", F.transform("v", lambda x, d: F.when((F.col("kind") == "context") & (d == 0), 0.0).otherwise(x * 40 + F.when(d == 0, F.length("name") / 7).otherwise(0))))
    p = {(r["kind"], r["name"]): np.array(r["v"]) for r in start.collect()}
    sums = training.fm_sums(pairs, data, start, 3)
    assert abs(sums.where("kind = 'loss'").first()["a"] - loss(p)) < 1e-9
    for r in training.fm_gradients(sums, data, start, 3).collect():
        for place in used_places(r["kind"]):
            assert abs(r["g"][place] - slope(loss, p, (r["kind"], r["name"]), place)) < 1e-6, (r["kind"], r["name"], place)


@pytest.mark.parametrize("variant", ["hybrid", "fm", "linear"])
def test_fm_fit_takes_adam_steps(spark, variant):
    import numpy as np

    data, names, pairs, loss = fm_case(spark)
    start = training.start_parameters(names, 3, variant=variant)
    p = {(r["kind"], r["name"]): np.array(r["v"]) for r in start.collect()}
    m = {k: np.zeros(4) for k in p}
    u = {k: np.zeros(4) for k in p}
    total, losses = 3.5, []
    for step in (1, 2, 3):
        losses.append(loss(p) / total)
        slopes = {(k, d): slope(loss, p, k, d) / total for k in p for d in used_places(k[0])}
        for (key, d), g in slopes.items():
            if variant == "linear" and (key[0] != "item" or d) or variant == "fm" and key[0] == "cross":
                continue
            g += {"cross": 1e-4}.get(key[0], 1e-5) * p[key][d]
            m[key][d] += 0.1 * (g - m[key][d])
            u[key][d] += 0.001 * (g * g - u[key][d])
            p[key][d] -= 0.01 * (m[key][d] / (1 - 0.9**step)) / (np.sqrt(u[key][d] / (1 - 0.999**step)) + 1e-8)
    values = iter([0.5, 0.7, 0.7, 0.1])
    config = training.FmConfig(dimension=3, epochs=3, variant=variant)
    fit = training.bpr_fit_fm(lambda epoch, now: pairs, data, start, config)
    assert np.allclose([r["loss"] for r in fit.history], losses, atol=1e-7)
    for r in fit.parameters.collect():
        for d in used_places(r["kind"]):
            assert abs(r["v"][d] - p[r["kind"], r["name"]][d]) < 1e-4, (r["kind"], r["name"], d)
    if variant == "linear":
        kept = training.bpr_fit_fm(
            lambda epoch, now: pairs, data, start, training.FmConfig(dimension=3, epochs=9, patience=2, batches=2, variant=variant),
            lambda now: next(values),
        )
        assert kept.best_epoch == 2 and len(kept.history) == 4


def test_no_cartesian_product_and_pushdown(spark):
    from facetloom.plans import QUERIES

    for name in ("and_intersect_rollback", "rebuild_candidates", "question_entropy", "bm25_search"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan, name
    plan = QUERIES["weighted_mean"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_discount:double>" in plan


def test_values_fold_alike_on_both_sides(spark):
    from facetloom.operators import facets

    catalog = spark.createDataFrame(
        [("A", "Straße"), ("B", "strasse"), ("C", "ＳＴＲＡＳＳＥ"), ("D", "other")], "parent_asin string, store string"
    ).select(
        "parent_asin", F.lit("t").alias("title"), F.array().cast("array<string>").alias("features"),
        F.create_map().cast("map<string,string>").alias("details"), F.array(F.lit("Parts"), F.col("store")).alias("categories"),
        "store", F.lit(None).cast("double").alias("price"), F.lit(1.0).alias("average_rating"), F.lit(1).alias("rating_number"),
        F.array().cast("array<string>").alias("description"), F.lit(None).cast("string").alias("price_text"),
    )
    facts = C.attribute_facts(catalog)
    for asked in ("Straße", "STRASSE", "straße"):
        assert [r[0] for r in facets.facet_lookup(facts, "brand", asked).collect()] == ["A", "B", "C"]
    nodes = C.category_nodes(C.category_prefixes(catalog))
    assert facets.category_lookup(nodes, "strasse").count() == 3


def test_queries_without_direction(spark):
    from facetloom.operators import retrieval

    items = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(1, 5)], "id int, vector array<double>")
    queries = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0])], "query_id int, vector array<double>"
    )
    got = {}
    for r in retrieval.cosine_topk(queries, items, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 6)))
    assert [i for i, _ in got[1]] == [4, 3] and got[2] == got[3] == [(1, 0.0), (2, 0.0)]


def test_shortest_number(spark):
    from facetloom.functions.scalars import shortest_number

    values = [0.0, 10.0, 9.5, 12.345678, 1200.0 , 123456.0, 999999.6, 1234567.0, 0.5, 100.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", shortest_number(F.col("v")).alias("s")).collect()
    assert [r["s"] for r in rows] == [f"{r['v']:g}" for r in rows]


def test_targets_of_one_context(spark):
    scores = spark.createDataFrame(
        [("k", "a", 2.0), ("k", "b", 1.0), ("k", "c", 1.0), ("k", "d", 0.5), ("j", "a", 1.0)], "k string, parent_asin string, score double"
    )
    targets = spark.createDataFrame([("k", t) for t in "abcd"] + [("j", "a"), ("k", "c")], "k string, target string")
    got = {(r["k"], r["target"]): (r["rank"], r["width"], r["wins"]) for r in metrics.target_rank(scores, targets, "k").collect()}
    assert got == {("k", "a"): (1, 4, 3.0), ("k", "b"): (2, 4, 1.5), ("k", "c"): (3, 4, 1.5), ("k", "d"): (4, 4, 0.0), ("j", "a"): (1, 1, 0.0)}


def test_stemmed_search_among_candidates(spark):
    import math

    texts = {1: "running shoes for runners", 2: "a shoe to run in, run and run", 3: "leather boots", 4: "été running", 5: None, 6: "runs"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    index = retrieval.text_index(docs, "doc_id", "text", stem=True)
    asked = spark.createDataFrame([("q", ["running", "shoes"]), ("r", ["boot"]), ("s", ["nothing"])], "query_id string, tokens array<string>")
    stemmed = asked.select("query_id", F.transform("tokens", lambda w: w).alias("tokens")).select("query_id", F.explode("tokens").alias("w"))
    stemmed = stemmed.select("query_id", retrieval.stems(F.col("w")).alias("w")).groupBy("query_id").agg(F.collect_set("w").alias("tokens"))
    allowed = [("q", 1), ("q", 2), ("q", 3), ("q", 5), ("r", 3), ("r", 1), ("s", 1), ("q", 2)]
    candidates = spark.createDataFrame(allowed, "query_id string, id int")
    found = retrieval.bm25_search(stemmed, *index, candidates, 10).collect()
    words = {k: [fold_and_stem(w) for w in (t or "").replace(",", "").split()] for k, t in texts.items()}
    # A text that is missing counts as a document but has no length.
    n, average = len(texts), sum(map(len, words.values())) / 5

    def score(query, k):
        total = 0.0
        for term in {fold_and_stem(w) for w in query}:
            df, tf = sum(term in w for w in words.values()), words[k].count(term)
            part = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
            total += part * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[k]) / average)) if tf else 0.0
        return total

    want = {}
    for q, tokens in (("q", ["running", "shoes"]), ("r", ["boot"])):
        hits = sorted(((-score(tokens, k), k) for a, k in set(allowed) if a == q and score(tokens, k)), key=lambda x: (round(x[0], 9), x[1]))
        want |= {(q, rank): (k, round(-s, 6)) for rank, (s, k) in enumerate(hits, 1)}
    assert {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 6)) for r in found} == want
    # Without candidates every document may be found.
    assert {r["id"] for r in retrieval.bm25_search(stemmed, *index).collect() if r["query_id"] == "q"} == {1, 2, 4, 6}


def test_fixed_negatives_skip_a_states_ties_before_the_cut(spark):
    products = spark.createDataFrame([(f"p{k:02d}", "c", "train") for k in range(30)] + [("x", "c", "test"), ("y", "d", "train")], "parent_asin string, category string, split string")
    items = spark.createDataFrame([(f"p{k:02d}", [f"f{k // 10}", f"g{k % 3}"]) for k in range(30)] + [("x", []), ("y", ["f0"])], "parent_asin string, features array<string>")
    pool = D.product_fixed_pool(products, items, 20)
    ordered = {}
    for r in pool.orderBy("target", "rank").collect():
        ordered.setdefault(r["target"], []).append(r["parent_asin"])
    assert set(ordered) == {f"p{k:02d}" for k in range(30)} and all(len(v) == 20 for v in ordered.values())
    states = spark.createDataFrame([("s1", "p00", ["f0"]), ("s2", "p00", []), ("s3", "p15", ["g0"]), ("s4", "y", ["f0"])], "state_id string, target string, known array<string>")
    evidence = items.select("parent_asin", F.col("features").alias("evidence"))
    tied = {"s1": {f"p{k:02d}" for k in range(10)}, "s2": {f"p{k:02d}" for k in range(30)}, "s3": {f"p{k:02d}" for k in range(0, 30, 3)}}
    target = {"s1": "p00", "s2": "p00", "s3": "p15"}
    got = {}
    for r in D.product_fixed_negatives(pool, states, evidence, "skip_ties", 6).orderBy("state_id", "place").collect():
        got.setdefault(r["state_id"], []).append(r["parent_asin"])
    want = {s: [p for p in ordered[target[s]] if p not in ties][:6] for s, ties in tied.items()}
    assert got == {s: v for s, v in want.items() if v} and len(got["s1"]) == 6
    kept = D.product_fixed_negatives(pool, states, evidence, "downweight_ties", 6)
    assert {r["parent_asin"] for r in kept.where("state_id = 's2'").collect()} == set(ordered["p00"][:6])
    assert kept.where("tie").count() > 0


def test_late_and_repeated_turns(spark, tmp_path):
    from facetloom.streaming.turns import dedup_late_turns

    lots = [
        [(1, 1, "2024-01-01 00:00:00"), (1, 1, "2024-01-01 00:00:00"), (1, 2, "2024-01-01 02:00:00"), (2, 9, None)],
        [(1, 1, "2024-01-01 00:00:00"), (1, 3, "2024-01-02 00:00:00")],
        [(1, 4, "2024-01-01 19:00:00"), (1, 3, "2024-01-02 00:00:00"), (1, 6, "2024-01-03 00:00:00")],
        [(1, 5, "2024-01-01 01:00:00"), (1, 7, "2024-01-02 20:00:00"), (1, 7, "2024-01-02 20:00:00")],
    ]
    schema = "session_id int, turn int, ts timestamp"
    got = []
    for number, lot in enumerate(lots):
        rows = spark.createDataFrame(lot, "session_id int, turn int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run = (
            dedup_late_turns(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("append")
            .foreachBatch(lambda batch, k: got.extend(r["turn"] for r in batch.collect()))
            .option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
        )
        run.awaitTermination()
    # Turn 4 is an hour inside the delay, turn 5 two days late, turn 9 has no time.
    assert sorted(got) == [1, 2, 3, 4, 6, 7]


def test_mentions_of_dictionaries(spark):
    texts = {
        1: "black or white black white tie, extra-black", 2: "road runner roadrunner road runners", 3: "", 4: None,
        5: "a-b a.b 'black' $black black9 9black", 6: "running shoes running shoe", 7: "x " * 300 + "black",
    }
    messages = spark.createDataFrame(list(texts.items()), "message_id int, norm string")
    words = {"black": "B", "white": "W", "black white": "BW", "road runner": "R", "road runners": "RS", "running": "run", "running shoes": "shoes", "shoe": "shoe", "a.b": "ab"}
    found = {r["message_id"]: [(m["value"], m["start"], m["stop"]) for m in r["seen"]] for r in U.alias_mentions(messages, {"seen": words, "other": {"zzz": "z"}}).collect()}

    def plain(text):
        spots = []
        for place, (phrase, label) in enumerate(words.items()):
            for k in range(len(text or "") - len(phrase) + 1):
                around = (text[k - 1 : k] if k else "") + text[k + len(phrase) : k + len(phrase) + 1]
                if text[k : k + len(phrase)] == phrase and not any(c.isalnum() for c in around):
                    spots.append((-len(phrase), place, k, label))
        kept = []
        for size, _, k, label in sorted(spots):
            if all(k - size <= a or b <= k for _, a, b in kept):
                kept.append((label, k, k - size))
        return sorted(kept, key=lambda m: m[1])

    assert found == {k: plain(t) for k, t in texts.items()}
    assert found[7] == [("B", 600, 605)] and ("BW", 15, 26) in found[1]


def test_brands_with_signs(spark):
    brands = spark.createDataFrame([("$uper",), ("A.B.",), ("north face",), ("brand-7",)], "brand string")
    rows = {1: "$uper x", 2: "x$uper", 3: "x $uper", 4: "a.b. yes", 5: "a.b.c", 6: "the north face jacket", 7: "north  face", 8: "brand-7 brand-77", 9: "a.b", 10: "1 $$uper"}
    messages = spark.createDataFrame(list(rows.items()), "message_id int, norm string")
    got = {r["message_id"]: [(m["value"], m["start"], m["stop"]) for m in r["brand_spans"]] for r in U.brand_mentions(messages, brands).collect()}
    assert got == {
        1: [("$uper", 0, 5)], 2: [], 3: [("$uper", 2, 7)], 4: [("A.B.", 0, 4)], 5: [], 6: [("north face", 4, 14)], 7: [], 8: [("brand-7", 0, 7)], 9: [],
        10: [("$uper", 3, 8)],
    }


def test_values_fold_alike_in_any_script(spark):
    bridge = spark.createDataFrame([("Straße", "A"), ("Mode > Straße", "B"), ("Plain", "C")], "full_path string, parent_asin string")
    nodes = X.with_normalized(
        spark.createDataFrame([("Straße", "Straße"), ("Straße", "Mode > Straße"), ("Plain", "Plain")], "name string, full_path string"),
        "name", "normalized_name",
    )
    targets = spark.createDataFrame(
        [("any", ["Straße", " "], []), ("below", ["STRASSE"], ["MODE", "straße"]), ("none", ["Plain"], ["x"])],
        "label string, names array<string>, terms array<string>",
    )
    from facetloom.operators.facets import category_name_products

    got = {(r["label"], r["parent_asin"]) for r in category_name_products(bridge, nodes, targets).collect()}
    assert got == {("any", "A"), ("any", "B"), ("below", "B")}
    known = spark.createDataFrame([([("color", "STRASSE"), ("color", "Straße."), ("brand", "ÉTÉ"), ("brand", None)],)], "k array<struct<attribute:string,display:string>>")
    names = known.select(features.context_names(F.lit("Ｓchuhe"), F.lit("buying"), F.lit(1), F.lit(False), F.col("k")).alias("n")).first()["n"]
    assert names[0] == "ctx:category=schuhe" and names[4:] == ["ctx:brand=été", "ctx:color=strasse"]


def test_ranges_and_neighbours(spark):
    rows = spark.createDataFrame([("item:color=" + f"{i:05d}",) for i in range(3000)], "name string")
    numbers = ordering.numbered(ordering.ranged(rows, ["name"]), [], [F.col("name")], F.col("range"), "n")
    assert all(int(r["name"][-5:]) == r["n"] - 1 for r in numbers.collect())
    rng = random.Random(3)
    values = {(g, i): rng.choice([None, i]) for g in "ab" for i in range(200)}
    df = spark.createDataFrame([(g, i, v) for (g, i), v in values.items()], "g string, i int, v int")
    for back in (False, True):
        got = ordering.following(df, ["g"], "i", ordering.int_block(F.col("i"), 16), {"near": F.col("v")}, back)
        for r in got.collect():
            order = range(r["i"] - 1, -1, -1) if back else range(r["i"] + 1, 200)
            assert r["near"] == next((values[r["g"], k] for k in order if values[r["g"], k] is not None), None)


def spoken_state(rows):
    """Plain in-order fold of edits, prices, budgets and categories."""
    state, ceiling, category, roles = {}, None, None, {"set": "required", "alternatives": "alternative"}
    for _, op, attribute, value in sorted(rows):
        if op in ("clear", "new_category"):
            state, ceiling = {}, None
        if op in ("category", "new_category"):
            category = value
        elif op == "remove":
            state.pop(attribute, None)
            ceiling = None if attribute == "budget" else ceiling
        elif op == "exclude":
            positive, out = state.setdefault(attribute, ({}, set()))
            positive.pop(value, None)
            out.add(value)
        elif op != "clear":
            field, shown = (attribute, value) if op in roles else ("budget", value if op == "budget" else f"maximum ${value}")
            positive, out = state.setdefault(field, ({}, set()))
            positive.clear()
            positive[shown] = roles.get(op, "stated")
            out.discard(shown)
            ceiling = value if op == "price" else ceiling
    rows = {(a, v, r) for a, (p, x) in state.items() for v, r in [*p.items(), *[(v, "excluded") for v in x]]}
    return rows | ({("maximum_price", ceiling, "ceiling")} if ceiling else set()) | ({("category", category, "category")} if category else set())


def test_preference_history_is_the_state_after_every_edit(spark):
    rng = random.Random(8)
    ops = ("set", "alternatives", "exclude", "remove", "clear", "price", "budget", "category", "new_category")
    fields = ("color", "size", "budget")
    sessions = {
        s: [(i, rng.choices(ops, (6, 4, 8, 2, 1, 3, 2, 2, 1))[0], rng.choice(fields), rng.choice("12")) for i in range(rng.choice((1, 6, 40)))]
        for s in range(40)
    }
    rows = [(s, *r) for s, edits in sessions.items() for r in edits]
    empty = [(None, 1, "set", "color", "1"), (3, None, "set", "color", "1"), (3, 99, "set", None, "1"), (3, 99, "price", None, None), (3, 99, None, "color", "1"), (3, 99, "other", "color", "1")]
    edits = spark.createDataFrame(rows + rows[:50] + empty, "session_id long, seq long, op string, attribute string, value string")
    got = N.preference_history(edits).collect()
    of = {}
    for r in got:
        of.setdefault(r["session_id"], []).append(r)
    assert set(of) <= set(sessions)
    for s, own in sessions.items():
        for k in range(len(own)):
            held = [(r["attribute"], r["value"], r["role"]) for r in of.get(s, []) if r["since"] <= k and (r["until"] is None or k < r["until"])]
            assert len(held) == len(set(held)) and set(held) == spoken_state(own[: k + 1])
    assert N.preference_history(edits.limit(0)).count() == 0


def test_preference_history_of_one_message(spark):
    edits = spark.createDataFrame(
        [(1, 0, "set", "color", "red"), (1, 0, "set", "color", "blue"), (1, 0, "exclude", "color", "blue"), (1, 0, "clear", None, None),
         (1, 5, "exclude", "color", "blue"), (1, 5, "remove", "color", None)],
        "session_id long, seq long, op string, attribute string, value string",
    )
    got = {tuple(r) for r in N.preference_history(edits).collect()}
    assert got == {(1, "color", "red", "required", 0, 5), (1, "color", "blue", "excluded", 0, 5), (1, "color", "blue", "excluded", 5, None)}


def test_history_of_parsed_messages(spark):
    said = [
        (1, "black or white shirt under $50"), (2, "not black, leather shirt"), (3, "any color is fine, cheap boots"), (4, "zzz"),
    ]
    messages = spark.createDataFrame(said, "message_id long, text string")
    brands = spark.createDataFrame([("Zed",)], "brand string")
    parsed = U.parse_messages(messages, brands).withColumnRenamed("message_id", "seq").withColumn("session_id", F.lit(7))
    got = {(r["attribute"], r["value"], r["role"], r["since"], r["until"]) for r in N.preference_history(N.edits_of_messages(parsed)).collect()}
    print(sorted(got, key=str))
    assert got >= {
        ("color", "black", "alternative", 1, 2), ("color", "white", "alternative", 1, 3), ("color", "black", "excluded", 2, 3),
        ("material", "leather", "required", 2, None), ("maximum_price", "50", "ceiling", 1, None), ("budget", "maximum $50", "stated", 1, 3),
        ("budget", "affordable", "stated", 3, None),
    }
    # Not a word of the last message is known, and no interval is empty.
    assert not any(4 in (g[3], g[4]) or g[3] == g[4] for g in got)


def test_files_that_look_small_are_not_broadcast(spark, tmp_path):
    # Half a megabyte of files, but over 30 MB as rows.
    spark.range(300_000).select("id", F.lit("x" * 100).alias("text")).write.parquet(str(tmp_path / "t"))
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    own.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    QUERIES["weighted_mean"](own, "/root/testdata/sf0.001")
    table = own.read.parquet(str(tmp_path / "t"))
    joined = table.join(table.withColumnRenamed("text", "other"), "id")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert own.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "10m"
    small = own.range(10).join(own.createDataFrame([(3,)], "id long"), "id")
    small.collect()
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_plain_values_are_spread_over_tasks(spark):
    own = spark.newSession()
    for key, value in (("autoBroadcastJoinThreshold", "-1"), ("adaptive.coalescePartitions.enabled", "false"), ("shuffle.partitions", "8")):
        own.conf.set(f"spark.sql.{key}", value)
    # One value of another script, so that the join stays.
    rows = own.range(4000).select("id", F.when(F.col("id") == 0, "Rød").otherwise("Red").alias("v"))
    got = X.with_normalized(rows, "v", "n").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.collect_set("n").alias("v")).collect()
    assert sum(r["n"] for r in got) == 4000 and max(r["n"] for r in got) < 1000 and {v for r in got for v in r["v"]} == {"red", "rød"}
