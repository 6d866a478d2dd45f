"""Slots of free-form shopping messages, as expressions over whole message tables.

Spans are (value, start, stop) with zero-based character positions in the
normalised text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom.functions import text as X
from facetloom.functions import vocab as V
from facetloom.operators.sessions import cue_intent, is_override

SPANS = "array<struct<value:string,start:int,stop:int>>"
DICTIONARIES = {
    "a_category": V.CATEGORY_ALIASES, "a_color": V.COLOR_ALIASES, "a_material": {m: m for m in V.MESSAGE_MATERIALS},
    "a_use_case": V.USE_CASE_ALIASES, "a_feature": V.FEATURE_ALIASES,
}
FIELDS = ("category", "color", "material", "brand", "use_case", "feature")


def span(value: Column, start: Column, stop: Column) -> Column:
    return F.struct(value.alias("value"), start.cast("int").alias("start"), stop.cast("int").alias("stop"))


def word_grams(messages: DataFrame, longest: int) -> DataFrame:
    """(message_id, core, start, stop, i, before, after, ends): sequences of up to ``longest`` words.

    ``messages``: (message_id, norm).  ``core`` runs from a word's first to another's
    last letter or digit; ``before`` and ``after`` are what stands around it up to the
    next words, ``ends`` tells the last word.  Places are sums over the words before,
    and a sequence grows by the next word: linear in the text.
    """
    word, gap = r"([a-z0-9]+)", "[a-z0-9]+"
    words, gaps = F.regexp_extract_all("norm", F.lit(word)), F.split("norm", gap)
    parts = F.arrays_zip(
        words.alias("word"), F.slice(gaps, F.lit(1), F.size(words)).alias("before"), F.slice(gaps, F.lit(2), F.size(words)).alias("after")
    )
    rows = messages.where("norm IS NOT NULL").select("message_id", F.posexplode(parts).alias("i", "p")).select(
        "message_id", "i", F.col("p.word").alias("word"), F.col("p.before").alias("before"), F.col("p.after").alias("after")
    )
    along = Window.partitionBy("message_id").orderBy("i")
    passed = F.sum(F.char_length("before") + F.char_length("word")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("start", (passed - F.char_length("word")).cast("int"))
    sequences, text = [], None
    for k in range(max(1, longest)):
        next_word, next_gap = F.lead("word", k).over(along), F.lead("after", k).over(along)
        text = next_word if text is None else F.concat(text, F.lead("after", k - 1).over(along), next_word)
        ends = F.lead("i", k + 1).over(along).isNull()
        sequences.append(F.struct(text.alias("core"), next_gap.alias("after"), ends.alias("ends")))
    grown = rows.select("message_id", "i", "start", "before", F.array(*sequences).alias("s"))
    return grown.select("message_id", "i", "start", "before", F.inline("s")).where("core IS NOT NULL").withColumn(
        "stop", F.col("start") + F.char_length("core")
    )


def drop_overlaps(found: Column) -> Column:
    """Keep the longest phrases first, then order by position.

    ``found``: array of (size, order, span); earlier ``order`` wins equal sizes.
    """
    ranked = F.array_sort(
        F.transform(found, lambda f: F.struct((-f["size"]).alias("a"), f["order"].alias("b"), f["span"]["start"].alias("c"), f["span"].alias("s")))
    )
    kept = F.aggregate(
        ranked, F.array().cast(SPANS),
        lambda acc, f: F.when(
            F.exists(acc, lambda k: (f["s"]["start"] < k["stop"]) & (k["start"] < f["s"]["stop"])), acc
        ).otherwise(F.concat(acc, F.array(f["s"]))),
    )
    by_start = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s.alias("s"))))
    return F.transform(by_start, lambda x: x["s"])


def alias_mentions(messages: DataFrame, dictionaries: dict[str, dict[str, str]]) -> DataFrame:
    """Add to ``messages`` (message_id, norm) the mentions of each dictionary, in text order.

    A dictionary maps phrases, which begin and end with a letter or digit, to
    labels.  Word sequences meet all phrases in one equi join; where mentions
    overlap the longest stay, then the ones listed first.
    """
    rows = [
        (kind, phrase, label, place)
        for kind, aliases in dictionaries.items() for place, (phrase, label) in enumerate(aliases.items())
    ]
    table = messages.sparkSession.createDataFrame(rows, "kind string, core string, label string, place int")
    longest = max(len(re.findall("[a-z0-9]+", phrase)) for _, phrase, _, _ in rows)
    hits = word_grams(messages, longest).join(table, "core")
    told = F.struct(
        F.char_length("core").alias("size"), F.col("place").alias("order"), span(F.col("label"), F.col("start"), F.col("stop")).alias("span")
    )
    found = hits.groupBy("message_id").agg(
        *[F.collect_list(F.when(F.col("kind") == kind, told)).alias(f"_{kind}") for kind in dictionaries]
    )
    joined = messages.join(found, "message_id", "left")
    none = F.array().cast(SPANS)
    kept = {kind: F.coalesce(drop_overlaps(F.col(f"_{kind}")), none) for kind in dictionaries}
    return joined.withColumns(kept).drop(*[f"_{kind}" for kind in dictionaries])


def brand_mentions(messages: DataFrame, brands: DataFrame) -> DataFrame:
    """Add ``brand_spans`` from a mined dictionary of any size.

    ``messages``: (message_id, norm); ``brands``: (brand).  Word sequences of a
    message, as long as the longest brand, meet the dictionary in an equi join;
    brands under three characters and everyday words are left out.  Signs around
    a brand's words have to be there too.
    """
    named = (
        brands.select("brand", X.normalize_utterance(F.col("brand")).alias("phrase"))
        .filter((F.char_length("phrase") >= 3) & ~F.col("phrase").isin(*sorted(V.BRAND_STOPWORDS)))
        .groupBy("phrase").agg(F.min("brand").alias("brand"))
        .withColumn("core", F.regexp_replace("phrase", r"^[^a-z0-9]+|[^a-z0-9]+$", ""))
        .filter(F.col("core") != "")
        .withColumn("lead", F.regexp_extract("phrase", "^[^a-z0-9]*", 0))
        .withColumn("tail", F.regexp_extract("phrase", "[^a-z0-9]*$", 0))
    )
    # One number: the words of the longest brand.
    longest = named.agg(F.max(F.size(F.regexp_extract_all("core", F.lit(r"([a-z0-9]+)"))))).first()[0] or 1
    # Signs that touch the word before or after belong to that word too.
    fits = lambda gap, sign, outer: (sign == "") | ((F.char_length(gap) > F.char_length(sign)) | outer)
    hits = word_grams(messages, longest).join(named, "core").where(
        F.col("before").endswith(F.col("lead")) & fits(F.col("before"), F.col("lead"), F.col("i") == 0)
        & F.col("after").startswith(F.col("tail")) & fits(F.col("after"), F.col("tail"), F.col("ends"))
    ).withColumn("start", F.col("start") - F.char_length("lead"))
    spans = hits.groupBy("message_id").agg(
        F.collect_set(
            F.struct(
                F.char_length("brand").alias("size"), F.col("phrase").alias("order"),
                span(F.col("brand"), F.col("start"), F.col("start") + F.char_length("phrase")).alias("span"),
            )
        ).alias("found")
    ).select("message_id", drop_overlaps(F.col("found")).alias("brand_spans"))
    return messages.join(spans, "message_id", "left").withColumn(
        "brand_spans", F.coalesce("brand_spans", F.array().cast(SPANS))
    )


def inside(m: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] <= m["start"]) & (m["stop"] <= s["stop"]))


def unprotected_colors(text: Column, mentions: Column) -> Column:
    """Drop colours that open an idiom such as "black tie"."""
    rest = lambda m: F.substring(text, m["start"] + 1, F.char_length(text))
    idiom = lambda m: F.regexp_extract(rest(m), V.COLOR_IDIOMS, 0)
    return F.filter(mentions, lambda m: F.char_length(idiom(m)) < m["stop"] - m["start"] + 1)


def unprotected_materials(text: Column, mentions: Column) -> Column:
    """Drop imitations: after "faux", "vegan"; before "-like", "look"."""
    def before(m: Column) -> Column:
        low = F.greatest(F.lit(0), m["start"] - 16)
        return F.substring(text, low + 1, m["start"] - low)

    return F.filter(
        mentions,
        lambda m: ~before(m).rlike(V.MATERIAL_BEFORE)
        & ~F.substring(text, m["stop"] + 1, F.lit(12)).rlike(V.MATERIAL_AFTER),
    )


def negation_flags(text: Column, mentions: Column) -> Column:
    """Add ``negated``: said in a negation, or listed after one with and/or."""
    def said(m: Column) -> Column:
        surface = F.concat(F.lit(r"\Q"), F.substring(text, m["start"] + 1, m["stop"] - m["start"]), F.lit(r"\E"))
        pattern = None
        for form in V.NEGATIONS:
            head, tail = form.split("{0}")
            piece = F.concat(F.lit(head), surface, F.lit(tail))
            pattern = piece if pattern is None else F.concat(pattern, F.lit("|"), piece)
        return F.regexp_like(text, pattern)

    flagged = F.transform(
        mentions,
        lambda m: F.struct(m["value"].alias("value"), m["start"].alias("start"), m["stop"].alias("stop"), said(m).alias("negated")),
    )

    def carry(acc: Column, m: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        between = F.substring(text, last["stop"] + 1, m["start"] - last["stop"])
        carried = F.coalesce(last["negated"] & between.rlike(V.NEGATION_CARRIER), F.lit(False))
        item = F.struct(
            m["value"].alias("value"), m["start"].alias("start"), m["stop"].alias("stop"),
            (m["negated"] | carried).alias("negated"),
        )
        return F.concat(acc, F.array(item))

    empty = F.array().cast("array<struct<value:string,start:int,stop:int,negated:boolean>>")
    return F.aggregate(flagged, empty, carry)


def uses_or(text: Column, mentions: Column) -> Column:
    """The mentions are alternatives: or, either, works too."""
    first, last = F.try_element_at(mentions, F.lit(1)), F.try_element_at(mentions, F.lit(-1))
    between = F.substring(text, first["start"] + 1, last["stop"] - first["start"])
    return (F.size(mentions) >= 2) & (
        between.rlike(r"\bor\b")
        | F.substring(text, F.lit(1), first["start"] + 1).rlike(r"\beither\b")
        | F.substring(text, first["start"] + 1, F.char_length(text)).rlike(r"\bworks?\s+too\b")
    )


def removed_attributes(text: Column) -> Column:
    """Attributes the message takes back, in a fixed order."""
    arms = []
    for attribute, words in V.REMOVABLE.items():
        pattern = "|".join(p.format(words) for p in V.REMOVAL_PATTERNS)
        hit = text.rlike(pattern)
        if attribute == "budget":
            hit = hit | text.rlike(V.NO_BUDGET)
        arms.append(F.when(hit, F.lit(attribute)))
    return F.array_compact(F.array(*arms))


def price_ceiling_parse(text: Column) -> Column:
    """(max_price, inclusive) of the first pattern that matches, or null."""
    result = None
    for pattern, inclusive in V.PRICE_PATTERNS:
        found = F.struct(
            F.regexp_extract(text, pattern, 1).try_cast("double").alias("max_price"), F.lit(inclusive).alias("inclusive")
        )
        result = F.when(text.rlike(pattern), found) if result is None else result.when(text.rlike(pattern), found)
    return result


def size_parse(text: Column) -> Column:
    """Sizes named after the word size: none, one, or two alternatives."""
    parts = F.array(F.regexp_extract(text, V.SIZE_PATTERN, 1), F.regexp_extract(text, V.SIZE_PATTERN, 2))
    return F.filter(parts, lambda p: p != "")


def parse_messages(messages: DataFrame, brands: DataFrame, unicode: bool = True) -> DataFrame:
    """All slots of free-form messages.

    ``messages``: (message_id, text).  Result: message_id, norm, removed,
    category, required / alternatives / excluded (arrays of (attribute, values)),
    max_price, inclusive, qualitative_budget, intent.
    """
    # Customers repeat themselves: each different message is read once.
    norm = X.normalize_utterance(F.col("text"), unicode)
    said = messages.select("message_id", norm.alias("norm")).withColumn("_said", F.unhex(F.sha2(F.to_json(F.struct("norm")), 256)))
    different = said.groupBy(F.col("_said").alias("message_id")).agg(F.first("norm").alias("norm"))
    read = parse_different(different, brands).withColumnRenamed("message_id", "_said")
    return said.select("message_id", "_said").join(read, "_said").drop("_said")


def parse_different(messages: DataFrame, brands: DataFrame) -> DataFrame:
    """``parse_messages`` of (message_id, norm)."""
    base = alias_mentions(brand_mentions(messages, brands), DICTIONARIES)
    text, own = F.col("norm"), F.col("brand_spans")
    free = lambda spans: F.filter(spans, lambda m: ~inside(m, own))
    df = (
        base.withColumn("removed", removed_attributes(text))
        .withColumn("m_category", negation_flags(text, free(F.col("a_category"))))
        .withColumn("m_color", negation_flags(text, unprotected_colors(text, free(F.col("a_color")))))
        .withColumn("m_material", negation_flags(text, unprotected_materials(text, free(F.col("a_material")))))
        .withColumn("m_brand", negation_flags(text, own))
        .withColumn("m_use_case", free(F.col("a_use_case")))
        .withColumn(
            "m_use_case",
            negation_flags(text, F.filter("m_use_case", lambda m: ~inside(m, F.filter("m_category", lambda c: c["negated"])))),
        )
        .withColumn("m_feature", negation_flags(text, free(F.col("a_feature"))))
    )

    def slot(name: str) -> Column:
        m = F.col(f"m_{name}")
        values = lambda kept: F.array_distinct(F.transform(kept, lambda x: x["value"]))
        positive = values(F.filter(m, lambda x: ~x["negated"]))
        among = (
            F.filter(m, lambda x: ~x["negated"]) if name == "category"
            else F.filter(m, lambda x: F.array_contains(positive, x["value"]))
        )
        told = F.struct(
            F.lit(name).alias("attribute"), positive.alias("positive"),
            values(F.filter(m, lambda x: x["negated"])).alias("negative"), uses_or(text, among).alias("either"),
        )
        if name == "category":
            return told
        return F.when(~F.array_contains("removed", name), told)

    sizes = F.when(
        ~F.array_contains("removed", "size"),
        F.struct(
            F.lit("size").alias("attribute"), size_parse(text).alias("positive"),
            F.array().cast("array<string>").alias("negative"), (F.size(size_parse(text)) > 1).alias("either"),
        ),
    )
    df = df.withColumn("slots", F.array_compact(F.array(*[slot(f) for f in FIELDS], sizes)))
    pick = lambda which, keep: F.transform(
        F.filter("slots", keep), lambda s: F.struct(s["attribute"].alias("attribute"), s[which].alias("values"))
    )
    df = (
        df.withColumn("required", pick("positive", lambda s: ~s["either"] & (F.size(s["positive"]) > 0) & (s["attribute"] != "category")))
        .withColumn("alternatives", pick("positive", lambda s: s["either"]))
        .withColumn("excluded", pick("negative", lambda s: F.size(s["negative"]) > 0))
        .withColumn("_c", F.get(F.filter("slots", lambda s: (s["attribute"] == "category") & ~s["either"]), F.lit(0))["positive"])
        .withColumn("_specific", F.get(F.filter("_c", lambda v: v != "shoes"), F.lit(0)))
        .withColumn("category", F.coalesce("_specific", F.get("_c", F.lit(0))))
        .withColumn(
            "_uses",
            F.flatten(F.transform(F.filter(F.concat("required", "alternatives"), lambda s: s["attribute"] == "use_case"), lambda s: s["values"])),
        )
        .withColumn(
            "category",
            F.when(
                F.col("category").isNull() | (F.col("category") == "shoes"),
                F.when(F.array_contains("_uses", "running"), "running shoes")
                .when(F.array_contains("_uses", "walking"), "walking shoes").otherwise(F.col("category")),
            ).otherwise(F.col("category")),
        )
        .withColumn("_price", F.when(~F.array_contains("removed", "budget"), price_ceiling_parse(text)))
        .withColumn("max_price", F.col("_price.max_price"))
        .withColumn("inclusive", F.coalesce("_price.inclusive", F.lit(False)))
        .withColumn(
            "qualitative_budget", F.when(F.col("max_price").isNull() & text.rlike(V.CHEAP_WORDS), "affordable")
        )
    )
    has = (
        (F.size("required") + F.size("alternatives") + F.size("excluded") > 0)
        | F.col("max_price").isNotNull() | F.col("qualitative_budget").isNotNull()
    )
    no_price = F.col("max_price").isNull() | (F.col("max_price") == 0)
    browsing = (
        text.rlike(V.STRONG_BROWSING) | (text.rlike(r"\bshow me\b") & ~has)
        | (text.contains("beach") & F.col("category").isNull() & no_price)
    )
    return df.withColumn("has_constraints", has).withColumn(
        "intent", F.when(browsing, "browsing").when(has, "buying").otherwise("unknown")
    ).drop("slots", "_c", "_specific", "_uses", "_price", *DICTIONARIES)


def partial_similarity(text: Column, cue: str) -> Column:
    """Best similarity (0-100) of the cue with any window of its length.

    100 * (1 - edits / length), an approximation of the usual partial ratio.
    """
    n = len(cue)
    windows = F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))
    )
    edits = F.array_min(F.transform(windows, lambda w: F.levenshtein(w, F.lit(cue))))
    return F.lit(100.0) * (1.0 - edits / float(n))


def opening_intent(text: Column) -> Column:
    """Intent of an opening: exact cues first, then near ones, else unknown."""
    words = X.intent_text(text)
    near = lambda name, floor: partial_similarity(words, X.intent_words(V.INTENT_CUES[name])) >= floor
    exact = cue_intent(text)
    return F.when(exact.isNotNull(), exact).when(near("buying", 80.0), "buying").when(
        near("browsing", 85.0), "exploring_unknown"
    ).when(near("boundary", 85.0), "boundary").otherwise("unknown")


def template_extract(text: Column, scenario: Column | None = None) -> Column:
    """(scenario, category, value) of a template opening."""
    message = F.trim(text)
    body = F.regexp_replace(message, V.OPENING_PREFIX, "")
    intent = cue_intent(message) if scenario is None else scenario
    key = r"(?is)^(.*?)\.\s*a\s+key\s+requirement\s+is\s*:\s*(.*)$"
    has_key = body.rlike(key)
    upto = lambda pattern: F.trim(F.get(F.split(body, pattern, 2), F.lit(0)))
    named = lambda c: F.when(c == "", V.DEFAULT_CATEGORY).otherwise(c)
    after_colon = F.when(body.contains(":"), X.clean_text(F.substring_index(body, ":", -1), None))
    dot = F.locate(".", body)
    before_dot = F.trim(F.substring(body, F.lit(1), F.greatest(dot - 1, F.lit(0))))
    provisional = X.clean_text(F.substring(body, dot + 1, F.char_length(body)), None)
    made = lambda s, c, v=None: F.struct(
        F.lit(s).alias("scenario"), c.alias("category"), (F.lit(None).cast("string") if v is None else v).alias("value")
    )
    return (
        F.when((intent == "buying") & has_key, made("buying", F.trim(F.regexp_extract(body, key, 1)), X.clean_text(F.regexp_extract(body, key, 2), None)))
        .when(intent == "buying", made("buying", named(upto("[.,]")), after_colon))
        .when(intent == "exploring_unknown", made("exploring_unknown", upto(r"(?i),|\bbut\b")))
        .when(intent == "boundary", made("boundary", named(upto("[.,]"))))
        .when(intent == "intent_override", made("intent_override", named(upto("[.,]"))))
        .when((dot > 0) & (before_dot != "") & (provisional != ""), made("provisional_override", before_dot, provisional))
        .otherwise(made("unknown", named(F.btrim(F.get(F.split(body, r"\.", 2), F.lit(0)), F.lit(" ,.")))))
    )


def override_replacement(text: Column) -> Column:
    """Replacement text of an override, empty if incomplete, null if none."""
    wish = F.regexp_extract(text, r"(?i)\b(?:need|want|instead)\b\s+(?:is\s+)?(.+)$", 1)
    new = F.when(text.contains(":"), F.substring_index(text, ":", -1)).otherwise(wish)
    return F.when(is_override(text), X.clean_text(new, None))


def answer_payload(text: Column) -> Column:
    """What follows the answer template, or null."""
    said = F.ltrim(text)
    return F.when(
        said.startswith(V.ANSWER_PREFIX), F.substring(said, F.lit(len(V.ANSWER_PREFIX) + 1), F.char_length(said))
    )


def contextual_answer(replies: DataFrame, facts: DataFrame) -> DataFrame:
    """Read a short reply through the attribute just asked for.

    ``replies``: (session_id, turn, asked, text), already known to carry no slot
    of their own.  Result adds ``outcome``: remove, max_price, value or null, and
    ``answer``.
    """
    payload = X.clean_text(F.col("text"), None)
    rows = X.with_normalized(replies.withColumn("payload", payload), "payload", "normalized_value")
    brands = facts.filter(F.col("attribute") == "brand").select("normalized_value", F.lit(True).alias("known")).distinct()
    rows = rows.join(brands, "normalized_value", "left")
    money = F.regexp_replace(F.regexp_extract("payload", V.MONEY_REPLY, 1), ",", "")
    size = F.lower(F.regexp_extract("payload", V.SIZE_REPLY, 1))
    free = F.col("asked").isin("use_case", "feature", "style", "other") & F.col("payload").rlike("[A-Za-z]")
    made = lambda o, a: F.struct(F.lit(o).alias("outcome"), a.alias("answer"))
    result = (
        F.when(F.col("asked").isNull() | (F.col("payload") == ""), None)
        .when(F.col("payload").rlike(V.NO_PREFERENCE_REPLY), made("remove", F.col("asked")))
        .when((F.col("asked") == "budget") & (money != ""), made("max_price", money))
        .when((F.col("asked") == "size") & (size != ""), made("value", size))
        .when((F.col("asked") == "brand") & F.col("known"), made("value", F.col("payload")))
        .when(free, made("value", F.col("payload")))
    )
    return rows.withColumn("_r", result).select(
        "session_id", "turn", "asked", "text", F.col("_r.outcome").alias("outcome"), F.col("_r.answer").alias("answer")
    )
