"""Which attribute to ask next: posteriors, predicted replies, entropy, stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.functions import vocab as V
from facetloom.session import spread_join


def posterior(scores: DataFrame, key: str, temperature: float = 1.0, count: str | None = None) -> DataFrame:
    """Softmax of the scores per key; uniform where it is not a number.

    Peak and total are combined map-side and joined back, so a key with very
    many products is never gathered in one task.  A row may stand for ``count``
    products of one score; ``p`` is the share of each.
    """
    t = max(float(temperature), 1e-6)
    n = F.col(count) if count else F.lit(1)
    peaks = scores.groupBy(key).agg(F.max("score").alias("_peak"), F.sum(n).alias("_n"))
    scaled = spread_join(scores.withColumn("_one", n), peaks, [key], ["parent_asin"]).withColumn(
        "_e", F.exp((F.col("score") - F.col("_peak")) / t)
    )
    totals = scaled.groupBy(key).agg(F.sum(F.col("_one") * F.col("_e")).alias("_z"))
    finite = F.col("_z").isNotNull() & ~F.isnan("_z") & (F.col("_z") > 0) & (F.col("_z") < float("inf"))
    return spread_join(scaled, totals, [key], ["parent_asin"]).select(
        key, "parent_asin", F.when(finite, F.col("_e") / F.col("_z")).otherwise(1.0 / F.col("_n")).alias("p")
    )


def predicted_reply(constraints: Column, attribute: str, disclosed: Column, distinct: bool = False) -> Column:
    """First two undisclosed values of an attribute (``other``: of any), joined by NUL.

    ``<no-answer>`` if there are none.  ``distinct`` drops repeated values first.
    """
    fits = F.filter(
        constraints,
        lambda c: ~F.array_contains(disclosed, c["value"])
        & (F.lit(attribute == "other") | (c["attribute"] == attribute)),
    )
    values = F.transform(fits, lambda c: c["value"])
    if distinct:
        values = F.array_distinct(values)
    return F.when(F.size(values) > 0, F.array_join(F.slice(values, 1, 2), "\x00")).otherwise(V.NO_ANSWER)


def replies(
    rows: DataFrame, profile: DataFrame, states: DataFrame, key: str, distinct: bool = False
) -> DataFrame:
    """(rows..., attribute, reply) for every remaining attribute of the key.

    ``states``: (key, disclosed, remaining), one row per key.
    """
    joined = spread_join(
        rows.join(profile.select("parent_asin", "constraints"), "parent_asin"),
        states.select(key, "disclosed", "remaining"), [key], ["parent_asin"],
    )
    options = F.array(
        *[
            F.struct(
                F.lit(a).alias("attribute"),
                predicted_reply(F.col("constraints"), a, F.col("disclosed"), distinct).alias("reply"),
            )
            for a in V.QUESTIONS
        ]
    )
    asked = F.filter(options, lambda o: F.array_contains("remaining", o["attribute"]))
    return joined.select(*rows.columns, F.explode(asked).alias("o")).select(
        *rows.columns, F.col("o.attribute").alias("attribute"), F.col("o.reply").alias("reply")
    )


def roadmap_position(attribute: Column) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in V.QUESTIONS]), attribute)


def stage_of(attribute: Column) -> Column:
    result = F.when(F.lit(False), 0)
    for i, stage in enumerate(V.STAGES):
        result = result.when(attribute.isin(*stage), i)
    return result


def question_entropy(answers: DataFrame, key: str, digits: int = 9) -> DataFrame:
    """Entropy of the predicted answers and the attribute to ask.

    ``answers``: (key, parent_asin, p, attribute, reply).  Values equal to
    ``digits`` decimals count as tied; ties go to the likelier answer, then to
    the earlier attribute.
    """
    mass = answers.groupBy(key, "attribute", "reply").agg(F.sum("p").alias("m"))
    m = F.col("m")
    summed = mass.groupBy(key, "attribute").agg(
        (-F.sum(F.when(m > 0, m * F.log(m)).otherwise(0.0)) + 0.0).alias("entropy"),
        (1.0 - F.sum(F.when(F.col("reply") == V.NO_ANSWER, m).otherwise(0.0))).alias("p_answer"),
    )
    best = summed.groupBy(key).agg(
        F.max_by(
            "attribute",
            F.struct(F.round("entropy", digits), F.round("p_answer", digits), -roadmap_position(F.col("attribute"))),
        ).alias("chosen")
    )
    return summed.join(best, key)


def largest_bucket(candidates: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """(key, attribute, bucket): how many candidates a worst-case answer leaves.

    The larger of the biggest value and the products without the attribute.
    """
    wanted = facts.filter(F.col("attribute").isin(*V.QUESTIONS))
    per_product = wanted.groupBy("parent_asin").agg(
        F.collect_list(F.struct("attribute", "normalized_value")).alias("facts")
    )
    # A product counts once for having an attribute: at the attribute's first fact.
    names = F.transform("facts", lambda f: f["attribute"])
    per_product = per_product.select("parent_asin", F.transform(
        "facts",
        lambda f, i: F.struct(
            f["attribute"].alias("attribute"), f["normalized_value"].alias("normalized_value"),
            (F.array_position(names, f["attribute"]) == i + 1).cast("int").alias("first"),
        ),
    ).alias("facts"))
    rows = candidates.join(per_product, "parent_asin")
    total = candidates.groupBy(key).agg(F.count("*").alias("n"))
    values = (
        rows.select(key, F.inline("facts"))
        .groupBy(key, "attribute", "normalized_value").agg(F.count("*").alias("size"), F.sum("first").alias("having"))
        .groupBy(key, "attribute").agg(F.max("size").alias("size"), F.sum("having").alias("having"))
    )
    every = total.select(key, "n", F.explode(F.array(*[F.lit(a) for a in V.QUESTIONS])).alias("attribute"))
    return (
        every.join(values, [key, "attribute"], "left")
        .select(
            key, "attribute",
            F.greatest(F.coalesce("size", F.lit(0)), F.col("n") - F.coalesce("having", F.lit(0))).alias("bucket"),
        )
    )


def stage_question(buckets: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """First roadmap stage with something left; inside it the smallest bucket."""
    open_rows = buckets.join(
        states.select(key, F.explode("remaining").alias("attribute")), [key, "attribute"]
    )
    order = F.struct(stage_of(F.col("attribute")).alias("s"), "bucket", roadmap_position(F.col("attribute")).alias("o"))
    return open_rows.groupBy(key).agg(F.min_by("attribute", order).alias("attribute"))


def informative_attributes(answers: DataFrame, key: str) -> DataFrame:
    """Attributes whose predicted replies differ, of the earliest stage that has any."""
    varied = (
        answers.groupBy(key, "attribute")
        .agg(F.min("reply").alias("lo"), F.max("reply").alias("hi"))
        .filter(F.col("lo") != F.col("hi"))
        .withColumn("stage", stage_of(F.col("attribute")))
    )
    # A key has a handful of attributes: gathered, the answers are walked once.
    gathered = varied.groupBy(key).agg(F.collect_list(F.struct("attribute", "stage")).alias("v"), F.min("stage").alias("low"))
    return gathered.select(key, F.inline(F.filter("v", lambda a: a["stage"] == F.col("low"))))


