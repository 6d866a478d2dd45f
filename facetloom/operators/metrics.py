"""Ranking evaluation: ranks, weighted summaries, session outcomes, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom.functions import scalars as S
from facetloom.functions import vocab as V
from facetloom.operators.ordering import int_block, numbered, running_sum, top_k
from facetloom.session import spread_join


def rank_candidates(scores: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Best ``k`` products per key: score descending, id ascending."""
    return top_k(scores, [key], [F.desc("score"), F.asc("parent_asin")], k)


def target_rank(scores: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Rank, percentile, pairwise accuracy and width of every (key, target).

    Each key's products are numbered once, best score first and ties by id, and
    all its targets look their number up: linear in products and in targets.
    Equal scores are counted before they are walked, and the walk goes block by
    block along the key's range of scores.
    """
    per_score = scores.groupBy(key, "score").agg(F.count("*").alias("n"))
    span = per_score.groupBy(key).agg(
        F.max("score").alias("top"), F.min("score").alias("low"), F.sum("n").alias("width")
    )
    reach = F.col("top") - F.col("low")
    block = F.when(reach > 0, F.floor((F.col("top") - F.col("score")) / reach * 255)).otherwise(F.lit(0))
    walked = running_sum(per_score.join(span, key), [key], [F.desc("score")], block, F.col("n"), "upto")
    tied = numbered(
        scores.select(key, "score", "parent_asin"), [key, "score"], [F.col("parent_asin")],
        F.substring("parent_asin", 1, 7), "place",
    )
    goal = targets.select(key, F.col("target").alias("parent_asin")).distinct()
    found = tied.join(goal, [key, "parent_asin"]).join(walked.select(key, "score", "n", "upto", "width"), [key, "score"])
    return ranked(found.withColumnsRenamed({"parent_asin": "target", "n": "tied"})).select(
        key, "target", "rank", "width", "wins", "rank_percentile", "pairwise_accuracy"
    )


def ranked(rows: DataFrame) -> DataFrame:
    """Add rank, wins, percentile and pairwise accuracy to rows of (place, tied, upto, width).

    ``tied`` products have the target's score, it has ``place`` among them; ``upto`` are not below it.
    """
    return rows.select(
        "*", (F.col("upto") - F.col("tied") + F.col("place")).alias("rank"),
        (F.col("width") - F.col("upto") + 0.5 * (F.col("tied") - 1)).alias("wins"),
    ).withColumn(
        "rank_percentile", (F.col("rank") - 1) / F.greatest(F.lit(1), F.col("width") - 1)
    ).withColumn(
        "pairwise_accuracy",
        F.when(F.col("width") == 1, F.lit(1.0)).otherwise(F.col("wins") / (F.col("width") - 1)),
    ).drop("place", "tied", "upto")


def placed(products: DataFrame, keys: list[str]) -> DataFrame:
    """Number the products of a group by id, block by block, as ``place``."""
    return numbered(products, keys, [F.col("parent_asin")], F.substring("parent_asin", 1, 7), "place")


def standing(scores: DataFrame, key: str) -> DataFrame:
    """Where each row of (key, ..., n products, score) stands: products ``tied`` with it, ``models`` (rows) of them, products ``upto`` its score and ``width`` of all.

    Equal scores are counted before they are walked, block by block along the key's range of scores.
    """
    per_score = scores.groupBy(key, "score").agg(F.sum("n").alias("tied"), F.count("*").alias("models"))
    span = per_score.groupBy(key).agg(
        F.max("score").alias("top"), F.min("score").alias("low"), F.sum("tied").alias("width")
    )
    reach = F.col("top") - F.col("low")
    block = F.when(reach > 0, F.floor((F.col("top") - F.col("score")) / reach * 255)).otherwise(F.lit(0))
    walked = running_sum(per_score.join(span, key), [key], [F.desc("score")], block, F.col("tied"), "upto")
    return scores.join(walked.drop("top", "low"), [key, "score"])


def leading(scores: DataFrame, key: str, k: int) -> DataFrame:
    """Rows of (key, ..., n products, score) that fewer than ``k`` better products of the key precede.

    A row holds a product at least, so the rank of rows limits them before the shuffle too.
    """
    order = Window.partitionBy(key).orderBy(F.desc("score"))
    near = scores.withColumn("_r", F.rank().over(order)).filter(F.col("_r") <= k).drop("_r")
    own = Window.partitionBy(key, "score")
    before = F.sum("n").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("n").over(own)
    return near.withColumn("_before", before).filter(F.col("_before") < k).drop("_before")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: weighted mean, 0 for no rows or no weight."""
    total = F.sum(F.when(value.isNotNull(), weight))
    return F.when(total > 0, F.sum(value * weight) / total).otherwise(F.lit(0.0))


def counted_mean(value: Column, n: Column) -> Column:
    """Aggregate: mean of values that stand for ``n`` rows each, null for none."""
    return F.sum(value * n) / F.sum(F.when(value.isNotNull(), n))


def weighted_median(df: DataFrame, value: str, weight: str, groups: list[str]) -> DataFrame:
    """First value whose cumulative weight reaches half of the group's total.

    Equal values are summed before anything is ordered.
    """
    per_value = df.groupBy(*groups, value).agg(F.sum(weight).alias("_w"))
    totals = per_value.groupBy(*groups).agg(F.sum("_w").alias("_total"))
    walked = running_sum(
        per_value, groups, [F.col(value)], int_block(F.col(value)), F.col("_w"), "_cum"
    )
    return (
        walked.join(totals, groups)
        # Sums taken in another order may differ in the last bits.
        .filter(F.col("_cum") >= F.col("_total") / 2 - F.col("_total") * 1e-12)
        .groupBy(*groups)
        .agg(F.min(value).alias("median"))
    )


def sliced(df: DataFrame, slices: list[str]) -> DataFrame:
    """Repeat each row under ``all`` and under its value of every slice column."""
    pairs = [F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value"))] + [
        F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices
    ]
    return df.withColumn("_s", F.explode(F.array(*pairs))).select(
        F.col("_s.slice").alias("slice"), F.col("_s.value").alias("value"),
        *[c for c in df.columns],
    )


def ranking_metrics(ranks: DataFrame, slices: list[str], count: str | None = None) -> DataFrame:
    """Weighted ranking summary over all states and every slice.

    ``ranks``: rank, width, rank_percentile, pairwise_accuracy, weight and the
    slice columns.  Informative hit@10 only looks at states with more than ten
    products, and is null when there are none.  A row may stand for ``count``
    states, whose weight it has.
    """
    rows = sliced(ranks.withColumn("_n", F.col(count) if count else F.lit(1)), slices)
    n = F.col("_n")
    w, rank, width = F.col("weight"), F.col("rank"), F.col("width")
    mean = lambda c: weighted_mean(c, w)
    hit = lambda k: (rank <= k).cast("double")
    wide = F.when(width > 10, hit(10))
    keys = ["slice", "value"]
    result = rows.groupBy(*keys).agg(
        F.sum(n).alias("state_count"),
        mean(1.0 / rank).alias("mrr"),
        mean(hit(1)).alias("hit_rate_at_1"),
        mean(hit(5)).alias("hit_rate_at_5"),
        F.when(F.count(wide) > 0, mean(wide)).alias("hit_rate_at_10"),
        F.coalesce(F.sum(F.when(wide.isNotNull(), n)), F.lit(0)).alias("informative_state_count"),
        mean(hit(10)).alias("hit_rate_at_10_raw"),
        mean(rank.cast("double")).alias("mean_rank"),
        mean(F.col("rank_percentile")).alias("mean_rank_percentile"),
        mean(width.cast("double")).alias("mean_candidate_width"),
        mean(F.col("pairwise_accuracy")).alias("pairwise_accuracy"),
        counted_mean(1.0 / rank, n).alias("micro_mrr"),
        counted_mean(wide, n).alias("micro_hit_rate_at_10"),
        counted_mean(hit(10), n).alias("micro_hit_rate_at_10_raw"),
    )
    for column, name in (("rank", "median_rank"), ("width", "median_candidate_width")):
        median = weighted_median(rows, column, "weight", keys).withColumnRenamed("median", name)
        result = result.join(median, keys, "left")
    return result


def temperature_grid(
    scores: DataFrame, targets: DataFrame, key: str, temperatures=V.TEMPERATURES, count: str | None = None
) -> DataFrame:
    """Weighted negative log likelihood of the target per temperature.

    ``targets``: (key, target, weight), several targets per key allowed.  The
    grid is five aggregate columns of a single pass over the scores; ``best``
    marks the smallest loss, the first one on ties.  A row of scores may stand
    for ``count`` products.
    """
    n = F.col(count) if count else F.lit(1)
    peaks = scores.groupBy(key).agg(F.max("score").alias("peak"))
    shifted = F.col("score") - F.col("peak")
    masses = spread_join(scores, peaks, [key], ["parent_asin"]).groupBy(key).agg(
        F.any_value("peak").alias("peak"),
        *[F.sum(n * F.exp(shifted / t)).alias(f"z{i}") for i, t in enumerate(temperatures)],
    )
    goal = scores.join(
        targets.withColumnRenamed("target", "parent_asin"), [key, "parent_asin"]
    ).select(key, "parent_asin", F.col("score").alias("target_score"), "weight")
    per_state = spread_join(goal, masses, [key], ["parent_asin"]).withColumn(
        "target_shift", F.col("target_score") - F.col("peak")
    )
    losses = per_state.agg(
        *[
            weighted_mean(F.log(f"z{i}") - F.col("target_shift") / t, F.col("weight")).alias(f"l{i}")
            for i, t in enumerate(temperatures)
        ]
    )
    table = F.array(
        *[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"l{i}").alias("loss")) for i, t in enumerate(temperatures)]
    )
    return losses.withColumn("low", F.least(*[F.col(f"l{i}") for i in range(len(temperatures))])).withColumn(
        "first", F.array_position(F.array(*[F.col(f"l{i}") for i in range(len(temperatures))]), F.col("low"))
    ).select("first", F.posexplode(table).alias("i", "g")).select(
        F.col("g.temperature").alias("temperature"), F.col("g.loss").alias("loss"),
        (F.col("i") + 1 == F.col("first")).alias("best"),
    )


def normalize_recommendations(recs: DataFrame, catalog: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` distinct catalog products of each list, ranked anew.

    ``recs``: (session_id, turn, position, parent_asin).
    """
    cleaned = recs.withColumn("parent_asin", F.trim("parent_asin")).filter(F.col("parent_asin") != "")
    firsts = cleaned.groupBy("session_id", "turn", "parent_asin").agg(F.min("position").alias("position"))
    valid = firsts.join(catalog.select("parent_asin"), "parent_asin", "left_semi")
    return top_k(valid, ["session_id", "turn"], [F.asc("position")], k).select(
        "session_id", "turn", "rank", "parent_asin"
    )


def first_hit_turn(recs: DataFrame, truth: DataFrame) -> DataFrame:
    """First eligible turn whose list holds the target, with its rank.

    ``truth``: (session_id, scenario, target, eligible_turn).
    """
    hits = (
        recs.join(truth.select("session_id", F.col("target").alias("parent_asin"), "eligible_turn"), ["session_id", "parent_asin"])
        .filter(F.col("turn") >= F.col("eligible_turn"))
        .groupBy("session_id")
        .agg(F.min(F.struct("turn", "rank")).alias("h"))
    )
    return truth.select("session_id", "scenario").join(hits, "session_id", "left").select(
        "session_id", "scenario",
        F.col("h").isNotNull().alias("hit"),
        F.col("h.turn").alias("first_hit_turn"),
        F.col("h.rank").alias("best_rank"),
        F.coalesce(1.0 / F.col("h.rank"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def session_metrics(outcomes: DataFrame) -> DataFrame:
    """Hit rate, MRR, turns to conversion, efficiency and score, per scenario and overall.

    A miss counts as one turn more than allowed; the score uses the rounded
    rates.  No sessions give a row of zeros with a null turn count.
    """
    turns = F.coalesce("first_hit_turn", F.lit(V.MAX_TURNS + 1))
    sums = ("n", "hits", "reciprocal", "turns")
    per = outcomes.groupBy("scenario").agg(
        F.count("*").alias("n"), F.sum(F.col("hit").cast("double")).alias("hits"),
        F.sum("reciprocal_rank").alias("reciprocal"), F.sum(turns).alias("turns"),
    )
    # Totals come from the handful of scenario rows; no session still gives one row.
    every = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).select(F.lit("all").alias("scenario"), *sums)
    summed = per.unionByName(every)
    mean = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    rate = F.round(F.coalesce(mean("hits"), F.lit(0.0)), 6)
    mrr = F.round(F.coalesce(mean("reciprocal"), F.lit(0.0)), 6)
    mttc = F.round(mean("turns"), 6)
    efficiency = F.when(mttc.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (11.0 - mttc) / 10.0)))
    return summed.select(
        "scenario", "n", rate.alias("hit_rate_at_10"), mrr.alias("mrr"), mttc.alias("mttc"),
        F.round(efficiency, 6).alias("efficiency"),
        F.round(0.5 * rate + 0.3 * mrr + 0.2 * efficiency, 6).alias("score"),
    )


def state_weights(states: DataFrame, trajectory: str) -> DataFrame:
    """Weight of each state: one over its trajectory's number of states."""
    sizes = states.groupBy(trajectory).agg((1.0 / F.count("*")).alias("weight"))
    return states.join(sizes, trajectory)


def dataset_manifest(states: DataFrame) -> DataFrame:
    """Counts per dimension and width statistics as (section, key, value).

    ``states``: trajectory, split, scenario, scenario_state, turn, width, weight,
    has_other, extended.
    """
    dims = {
        "split": F.col("split"),
        "scenario": F.col("scenario"),
        "observed_scenario": F.col("scenario_state"),
        "split_scenario": F.concat_ws("/", "split", "scenario"),
        "turn_bucket": S.turn_bucket(F.col("turn")),
        "survivor_width": S.width_bucket(F.col("width")),
        "other": F.when(F.col("has_other"), "with_other").otherwise("without_other"),
    }
    state_pairs = F.array(*[F.struct(F.lit(f"states_by_{n}").alias("section"), c.alias("key")) for n, c in dims.items()])
    counts = (
        states.select(F.explode(state_pairs).alias("p")).groupBy("p.section", "p.key")
        .agg(F.count("*").cast("double").alias("value"))
    )
    trajectories = states.groupBy("trajectory").agg(
        F.any_value("split").alias("split"), F.any_value("scenario").alias("scenario"),
        F.bool_or("extended").alias("extended"), F.abs(F.sum("weight") - 1.0).alias("error"),
        F.count("*").alias("n"), F.sum("width").alias("width"),
    )
    trajectory_pairs = F.array(
        F.struct(F.lit("trajectories_by_split").alias("section"), F.col("split").alias("key")),
        F.struct(F.lit("trajectories_by_scenario").alias("section"), F.col("scenario").alias("key")),
        F.struct(F.lit("trajectories_by_split_scenario").alias("section"), F.concat_ws("/", "split", "scenario").alias("key")),
    )
    per_trajectory = (
        trajectories.select(F.explode(trajectory_pairs).alias("p")).groupBy("p.section", "p.key")
        .agg(F.count("*").cast("double").alias("value"))
    )
    totals = trajectories.agg(
        F.count("*").cast("double").alias("trajectory_count"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("state_count"),
        F.coalesce(F.sum("width"), F.lit(0)).cast("double").alias("survivor_count"),
        F.count_if("extended").cast("double").alias("extended_trajectories"),
        F.coalesce(F.round(F.max("error"), 9), F.lit(0.0)).alias("weight_sum_error"),
    )
    names = totals.columns
    flat = totals.select(
        F.explode(F.array(*[F.struct(F.lit("totals").alias("section"), F.lit(n).alias("key"), F.col(n).alias("value")) for n in names])).alias("p")
    ).select("p.section", "p.key", "p.value")
    widths = states.groupBy("width").agg(F.count("*").alias("n"))
    stats = widths.agg(
        F.min("width").cast("double").alias("minimum"),
        (F.sum(F.col("width") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("width", F.lit(0.5), F.col("n")).alias("median"),
        F.max("width").cast("double").alias("maximum"),
    )
    flat_widths = stats.select(
        F.explode(F.array(*[F.struct(F.lit("width").alias("section"), F.lit(n).alias("key"), F.coalesce(F.round(n, 6), F.lit(0.0)).alias("value")) for n in stats.columns])).alias("p")
    ).select("p.section", "p.key", "p.value")
    return counts.unionByName(per_trajectory).unionByName(flat).unionByName(flat_widths)
