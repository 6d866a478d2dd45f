"""What sessions, states and products share is worked out once."""

import pytest
from pyspark.sql import functions as F

from facetloom.operators import dataset as D
from facetloom.operators import metrics, questions, retrieval, scoring
from facetloom.operators import utterances as U
from facetloom.plans import ranking_queries as R
from facetloom.sources.tables import Tables


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def test_names_are_found_once_per_situation(t):
    turns, found = t.states.count(), R.context_situations(t)
    assert found.count() == found.select("kind", "scenario", "turn").distinct().count() < turns
    assert R.context_rows(t).count() == turns
    assert not {"names", "known", "wanted"} & set(R.context_rows(t).columns)


def test_lists_hold_no_more_than_targets(t):
    assert R.recommendations(t).groupBy("session_id", "turn").count().where("count > 1").isEmpty()


def test_kinds_count_every_product(t):
    every = R.pairs(t).groupBy("context_key").agg(F.count("*").alias("n"))
    assert R.kind_pairs(t).groupBy("context_key").agg(F.sum("n").alias("n")).exceptAll(every).isEmpty()


def test_a_product_has_an_attribute_once(spark):
    candidates = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "c")], "key string, parent_asin string")
    facts = spark.createDataFrame(
        [("a", "color", "red"), ("a", "color", "blue"), ("b", "color", "red")],
        "parent_asin string, attribute string, normalized_value string",
    )
    found = {r.attribute: r.bucket for r in questions.largest_bucket(candidates, facts, "key").collect()}
    assert found["color"] == 2 and found["size"] == 3


def test_buckets_are_found_per_state(t):
    assert "state_key" in questions.largest_bucket(R.survivors(t), t.facts, "state_key").columns
    assert R.buckets(t).count() == 9 * R.raw_contexts(t).count()


def test_scores_are_found_per_model(t):
    models = R.modelled_survivors(t)
    assert models.count() == R.survivors(t).count()
    assert R.scored(t).count() == R.pairs(t).count()
    assert R.model_items(t).count() == models.select("model").distinct().count()


def test_a_repeated_message_is_read_once(spark, monkeypatch):
    read = []
    mentions = U.brand_mentions
    monkeypatch.setattr(U, "brand_mentions", lambda messages, brands: read.append(messages.count()) or mentions(messages, brands))
    texts = ["red shoes, no leather", "Red  shoes, no leather", None, "red shoes, no leather", None, ""]
    messages = spark.createDataFrame(list(enumerate(texts)), "message_id long, text string")
    found = {r.message_id: r for r in U.parse_messages(messages, spark.createDataFrame([("Acme",)], "brand string")).collect()}
    assert read == [3] and sorted(found) == list(range(6))
    assert found[0][1:] == found[1][1:] == found[3][1:] and found[2][1:] == found[4][1:]
    assert found[2].norm is None and found[5].norm == "" and found[0].required


def test_pools_of_states_are_lists(spark):
    pool = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("t", "c", 3)], "target string, parent_asin string, rank int")
    states = spark.createDataFrame([("s", "t", ["x", "y"]), ("u", "t", ["y"])], "state_id string, target string, known array<string>")
    evidence = spark.createDataFrame(
        [("t", ["x", "y"]), ("a", ["x", "y"]), ("b", ["x"]), ("c", [])], "parent_asin string, evidence array<string>"
    )
    found = D.product_fixed_negatives(pool, states, evidence)
    assert {(r.state_id, r.parent_asin, r.place) for r in found.collect()} == {("s", "b", 1), ("s", "c", 2), ("u", "b", 1), ("u", "c", 2)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join Inner, ((state_id" not in plan


def test_words_are_searched_once_per_state(t, monkeypatch):
    asked = []
    search = retrieval.bm25_search
    monkeypatch.setattr(retrieval, "bm25_search", lambda queries, *rest: asked.append(queries.count()) or search(queries, *rest))
    hits = R.product_hits(t, stem=False)
    assert asked == [R.raw_contexts(t).select("state_key").distinct().count()]
    assert hits.select("query_id").distinct().join(R.raw_contexts(t), F.col("query_id") == F.col("context_key"), "left_anti").isEmpty()


def test_vectors_of_a_group_meet_in_tiles(spark):
    import random

    draw = random.Random(7)
    rows = [(k, [draw.choice((-1.0, 0.5, 2.0, 0.1)) for _ in range(5)], k % 3) for k in range(90)]
    rows += [(200 + k, [1.0, 0.0, 0.0, 0.0, 0.3], 1) for k in range(30)]
    rows += [(300, [0.0] * 5, 1), (301, None, 1), (302, [float("nan")] * 5, 2), (303, [1.0] * 5, None), (304, [1.0] * 5, 9)]
    rows += [(305, [0.0] * 5, 8), (306, None, 8), (307, [1.0, 2.0], 2), (308, [1.0, None, 0.0, 0.0, 0.0], 0), (309, [2.0, 1.0], 2)]
    rows += [(310, [], 7), (311, [1.0], 7)]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>, label int")
    queries = vectors.withColumnRenamed("id", "query_id")
    given = queries.select("query_id", "label").join(vectors.select("id", "label"), "label").where("id <> query_id")
    told = lambda df: {(r.query_id, r.id, repr(r.score), r.rank) for r in df.collect()}
    want = told(retrieval.cosine_pairs(queries, vectors, given.select("query_id", "id"), 4))
    for tile in (7, 4096):
        assert told(retrieval.cosine_within(queries, vectors, "label", 4, tile)) == want


def test_models_rank_like_products(spark, monkeypatch):
    """Ranks, best lists and shares found per model are those of all products, also where several models share a score."""
    t = Tables(spark, "/root/testdata/./sf0.001")
    few = F.filter("features", lambda f: f.startswith("item:category") | f.startswith("item:material") | f.startswith("item:price"))
    own = R.items
    monkeypatch.setattr(R, "items", lambda t: own(t).withColumn("features", few).withColumn(
        "base", F.size("features").cast("double")).withColumn("linear", F.col("base")).withColumn("vector", F.array_repeat(F.lit(0.5), 16)))
    scores = R.model_scores(t)
    blunt = scores.withColumn("score", F.round(F.col("score") / 4))
    assert blunt.groupBy("context_key", "score").agg(F.count("*").alias("m")).where("m > 1").count() > 0
    monkeypatch.setattr(R, "model_scores", lambda t: blunt)
    pairs = R.scored(t)
    assert pairs.count() == R.pairs(t).count() > scores.count()
    goals = R.context_rows(t).select("context_key", "target")
    names = ["context_key", "target", "rank", "width", "wins", "rank_percentile", "pairwise_accuracy"]
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(R.target_ranks(t).select(names)) == told(metrics.target_rank(pairs, goals, "context_key").select(names))
    columns = ["context_key", "parent_asin", "rank"]
    for k in (1, 3, 20):
        assert told(R.best_products(t, blunt, k).select(columns)) == told(metrics.rank_candidates(pairs, "context_key", k).select(columns))
    near = lambda df: told(df.select("context_key", "parent_asin", F.round("p", 9)))
    assert near(R.of_models(t, R.model_posterior(t))) == near(questions.posterior(pairs, "context_key", 0.5))


def test_only_models_that_may_lead_are_written_out(spark):
    scores = spark.createDataFrame(
        [("k", "a", 3, 2.0), ("k", "b", 1, 1.0), ("k", "c", 1, 1.0), ("k", "d", 5, 0.0)], "key string, model string, n long, score double"
    )
    kept = lambda k: {r.model for r in metrics.leading(scores, "key", k).collect()}
    assert kept(3) == {"a"} and kept(4) == {"a", "b", "c"} == kept(5) and kept(6) == {"a", "b", "c", "d"}


def test_crosses_are_looked_up_once_per_set_of_features(spark):
    contexts = spark.createDataFrame([("x", ["ctx:color=red", "ctx:turn=early"]), ("y", ["ctx:turn=late", "ctx:color=red"])], "context_key string, features array<string>")
    crosses = spark.createDataFrame([("ctx:color=red", "item:size=1", 0.5), ("ctx:size=9", "item:size=1", 9.0)], "context_feature string, item_feature string, weight double")
    items = spark.createDataFrame([("p", ["item:size=1"]), ("q", ["item:size=1"])], "parent_asin string, features array<string>")
    pairs = spark.createDataFrame([("x", "p"), ("y", "p")], "context_key string, parent_asin string")
    sets = scoring.crossing_sets(contexts, crosses)
    rows = scoring.crossing_features(pairs, sets)
    assert rows.count() == 1
    # No weight is summed for a feature or a product that no pair brings together.
    weights = scoring.product_crosses(items, crosses, rows.select("context_feature", "parent_asin").distinct())
    assert [tuple(r) for r in weights.collect()] == [("ctx:color=red", "p", 0.5)]
    found = scoring.cross_weight_join(pairs, contexts, items, crosses)
    assert {tuple(r) for r in found.select("context_key", "parent_asin", "cross_score").collect()} == {("x", "p", 0.5), ("y", "p", 0.5)}


def test_goals_are_counted_per_model(t):
    assert R.model_goals(t).agg(F.sum("n")).first()[0] == R.context_rows(t).count()
    assert abs(R.model_goals(t).agg(F.sum("weight")).first()[0] - t.session_profiles.count()) < 1e-6
    assert R.alike_survivors(t).agg(F.sum("n")).first()[0] == R.survivors(t).count()


def test_ring_blocks_hold_what_follows(spark):
    """Rings shorter than a block, of several blocks and with a last block shorter than a pool give the same lists as one block."""
    rows = [(f"P{size:03d}{i:05d}", f"c{size}", "train") for size in (1, 2, 7, 8, 9, 15, 17, 23, 33) for i in range(size)]
    products = spark.createDataFrame(rows, "parent_asin string, category string, split string")
    items = spark.createDataFrame(
        [(p, [f"f{j}" for j in range(int(p[-2:]) % 4)]) for p, _, _ in rows if not p.endswith("6")], "parent_asin string, features array<string>"
    )
    told = lambda block: sorted(
        (r.target, e.parent_asin, e.shared, n) for r in D.fixed_lists(products, items, 7, block=block).collect() for n, e in enumerate(r.pool)
    )
    whole = told(1024)
    assert whole == told(8) == told(7)
    assert max(n for *_, n in whole) == 6 and not any(x.endswith("6") for row in whole for x in row[:2])


def test_negatives_of_lists_are_those_of_rows(spark):
    lists = spark.createDataFrame(
        [("t", (["x", "y"], [("s", ["x", "y"]), ("u", ["y", "y"])]), [(f"a{i}", ["x", "y"] if i % 3 else ["x"]) for i in range(9)])],
        "target string, own struct<evidence:array<string>,states:array<struct<state_id:string,known:array<string>>>>, "
        "pool array<struct<parent_asin:string,evidence:array<string>>>",
    )
    pool = lists.select("target", F.posexplode("pool").alias("rank", "p")).select("target", "p.parent_asin", "rank")
    evidence = lists.select(F.inline("pool")).unionByName(lists.select(F.col("target").alias("parent_asin"), "own.evidence"))
    states = lists.select("target", F.inline("own.states"))
    told = lambda df: sorted((r.state_id, r.parent_asin, r.place, r.tie) for r in df.collect())
    for policy in D.POLICIES:
        for n in (1, 3, 16):
            assert told(D.fixed_negatives_of_lists(lists, policy, n)) == told(D.product_fixed_negatives(pool, states, evidence, policy, n))


def test_an_item_is_copied_once_per_tile(spark):
    import random

    draw = random.Random(3)
    rows = [(k, [draw.choice((-1.0, 0.5, 2.0, 0.1)) for _ in range(4)]) for k in range(600)] + [(900, [0.0] * 4), (901, [float("nan")] * 4)]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>")
    queries = vectors.withColumnRenamed("id", "query_id")
    told = lambda **sizes: sorted((r.query_id, r.id, round(r.score, 9), r.rank) for r in retrieval.cosine_topk(queries, vectors.where("id < 900"), 5, **sizes).collect())
    whole = told()
    assert len(whole) == 5 * 602 and whole == told(block=7, pack=50, tile=64)
    assert [(r[1], r[2]) for r in whole if r[0] == 900] == [(k, 0.0) for k in range(5)]
    # 602 queries are one tile: no item is copied.
    plan = retrieval.cosine_topk(queries, vectors, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "[0]" in plan


def test_queries_of_a_group_share_its_candidates(spark):
    nan = float("nan")
    queries = spark.createDataFrame(
        [("a", [1.0, 0.5], "g"), ("b", [0.0, 0.0], "g"), ("c", [nan, 1.0], "g"), ("d", [2.0, 1.0], "h"), ("e", [1.0, 1.0], "g")],
        "query_id string, vector array<float>, g string",
    )
    candidates = spark.createDataFrame(
        [("g", 1, [1.0, 0.0]), ("g", 2, None), ("g", 3, [0.0, 1.0]), ("g", 4, [1.0, 0.0]), ("h", 2, None), ("h", 5, None)],
        "g string, id long, vector array<float>",
    )
    pairs = queries.select("query_id", "g").join(candidates, "g").select("query_id", "id")
    told = lambda df: sorted((r.query_id, r.rank, r.id, r.score) for r in df.collect())
    vectors = candidates.where("vector is not null").select("id", "vector")
    for k in (1, 2, 9):
        assert told(retrieval.cosine_shared(queries, candidates, "g", k)) == told(retrieval.cosine_pairs(queries.drop("g"), vectors, pairs, k))
    plan = retrieval.cosine_shared(queries, candidates, "g", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "query_id" not in plan[plan.index("Join"):].split("\n")[0]
