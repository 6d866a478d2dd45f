"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule allows or blocks teach two variable-order Markov models, one of
accepted and one of rejected characters. Orders are blended by Witten-Bell
smoothing. A URL's score is its log-likelihood difference divided by its length;
the threshold lies between the held-out means of both classes, in units of their
deviations. Everything is a join or an aggregate of character grams.

Null URLs and those without ``://`` have an empty host and path and are judged
like any other (their closing mark is all they have). Repeated URLs get equal
rows. Without examples of both classes the method allows everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import store

RULES = (
    ("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
)
ORDER = 4
ALPHABET = 256
HOLD_OUT = 5  # one URL in five calibrates, the rest teach

START, END = "\x02", "\x03"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; null where none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        site, slash, below = text.partition("/")
        fits = ((host == site) | F.endswith(host, F.lit(f".{site}"))) & F.startswith(path, F.lit(slash + below))
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """(h1, h2, gram, n): grams of ``order + 1`` characters of each distinct text."""
    padded = F.concat(F.lit(START * order), F.col("scored"), F.lit(END))
    grams = F.transform(
        F.sequence(F.lit(1), F.length(padded) - order), lambda i: F.substring(padded, i, F.lit(order + 1))
    )
    return texts.select("h1", "h2", "teach", F.explode(grams).alias("gram"))


def gram_scores(counts: DataFrame, order: int, alphabet: int = ALPHABET) -> DataFrame:
    """(gram, ratio): smoothed log P(accepted) - log P(rejected) of the last character.

    ``counts`` has each gram of the corpus once, with its count in both classes,
    so every lower order is an aggregate of it.
    """
    below = None
    for k in range(order + 1):
        grams = counts.groupBy(F.expr(f"right(gram, {k + 1})").alias("g")).agg(
            F.sum("accepted").alias("na"), F.sum("rejected").alias("nr")
        )
        grams = grams.withColumn("c", F.expr(f"left(g, {k})"))
        contexts = grams.groupBy("c").agg(
            F.sum("na").alias("ca"), F.sum("nr").alias("cr"),
            F.count_if(F.col("na") > 0).alias("ta"), F.count_if(F.col("nr") > 0).alias("tr"),
        )
        level = grams.join(contexts, "c")
        if below is None:
            level = level.withColumns({"qa": F.lit(1.0 / alphabet), "qr": F.lit(1.0 / alphabet)})
        else:
            shorter = below.select(F.col("g").alias("s"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
            level = level.join(shorter, F.expr(f"right(g, {k})") == F.col("s"))

        def blend(n, seen, kinds, q):
            return F.when(seen > 0, (n + kinds * q) / (seen + kinds)).otherwise(q)

        below = level.select(
            "g", blend(F.col("na"), F.col("ca"), F.col("ta"), F.col("qa")).alias("pa"),
            blend(F.col("nr"), F.col("cr"), F.col("tr"), F.col("qr")).alias("pr"),
        )
    return below.select(F.col("g").alias("gram"), (F.log("pa") - F.log("pr")).alias("ratio"))


def judge(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, score and verdict."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = url_parts(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    scored = F.concat("host", "path")
    rows = rows.select(
        "page_id", "host", "path", rule.alias("rule"), action.alias("action"), scored.alias("scored"),
        F.xxhash64(scored).alias("h1"), F.xxhash64(F.lit("second"), scored).alias("h2"),
    )
    texts = rows.groupBy("h1", "h2").agg(
        F.first("scored").alias("scored"), F.first("action").alias("action"), F.count("*").alias("n")
    )
    fold = F.pmod("h2", F.lit(HOLD_OUT)) == 0
    texts = texts.withColumn("teach", F.when(~fold, F.col("action")))
    grams = gram_counts(texts, order)
    counts = grams.groupBy("gram").agg(
        F.count_if(F.col("teach") == "allow").alias("accepted"), F.count_if(F.col("teach") == "block").alias("rejected")
    )
    model = store(gram_scores(store(counts, "url-grams"), order), "url-model")
    # Every gram has its row in the model; hot grams meet one row each, and such a join can be split.
    scores = store(
        grams.join(model, "gram").groupBy("h1", "h2").agg((F.sum("ratio") / F.count("*")).alias("score")), "url-scores"
    )
    held = scores.join(texts.where(fold & F.col("action").isNotNull()).select("h1", "h2", "action"), ["h1", "h2"])

    def over(action, f):
        return f(F.when(F.col("action") == action, F.col("score")))

    a, r, sa, sr = held.agg(
        over("allow", F.avg), over("block", F.avg), over("allow", F.stddev_pop), over("block", F.stddev_pop)
    ).first()
    if a is None or r is None:
        threshold = float("-inf")
    else:
        threshold = (a * (sr + 1e-9) + r * (sa + 1e-9)) / (sa + sr + 2e-9)
    method = F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block")
    return rows.join(scores, ["h1", "h2"], "left").select(
        "page_id", "host", "path", "rule", "score", F.coalesce("action", method).alias("verdict")
    )
