"""Message parsing and session state."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetloom.functions import text as X
from facetloom.functions import vocab as V
from facetloom.operators import catalog as C
from facetloom.operators import ordering
from facetloom.operators import sessions as N
from facetloom.operators import utterances as U
from facetloom.plans import oracle as O
from facetloom.plans.registry import ORACLES, query
from facetloom.session import scratch_path
from facetloom.sources.tables import Tables
from facetloom.streaming import edits as stream
from facetloom.streaming import turns as stream_turns


def esc(pattern: str) -> str:
    return pattern.replace("'", "''")


NORM_SQL = "trim(regexp_replace(regexp_replace(replace(lower(text), '’', ''''), '(\\d),(\\d{3}\\b)', '\\1\\2', 'g'), '[^a-z0-9$.''-]+', ' ', 'g'))"
FREE_SQL = f", nm AS MATERIALIZED (SELECT message_id, {NORM_SQL} AS norm FROM free)"


def normalized(t: Tables):
    return t.free_texts.select("message_id", X.normalize_utterance(F.col("text")).alias("norm"))


@query("normalize_utterance", O.with_views("free", f"{FREE_SQL} SELECT message_id, norm FROM nm"))
def q_normalize_utterance(t: Tables):
    return normalized(t)


def brands(t: Tables):
    return C.brand_dictionary(t.facts).select("brand")


def spelled(spans):
    return F.array_join(
        F.transform(spans, lambda m: F.concat_ws(":", m["value"], m["start"].cast("string"), m["stop"].cast("string"))), "|"
    )


def said(t: Tables):
    """(message_id, norm): every different message, wishes and turns of conversations, normalised."""
    texts = t.free_texts.select("text").unionByName(t.table("conversations").select("text"))
    norm = X.normalize_utterance(F.col("text"))
    return texts.select(norm.alias("norm")).where("norm IS NOT NULL").distinct().select(F.sha2("norm", 256).alias("message_id"), "norm")


ALIAS_ROWS = ", ".join(
    f"('{kind}', '{esc(phrase)}', '{esc(label)}', {place})"
    for kind, aliases in U.DICTIONARIES.items() for place, (phrase, label) in enumerate(aliases.items())
)
SAID_SQL = f"""nm AS MATERIALIZED (SELECT DISTINCT {NORM_SQL.replace('lower(text)', "replace(lower(text), 'ß', 'ss')")} AS norm FROM (SELECT text FROM free UNION ALL SELECT text FROM conversations) WHERE text IS NOT NULL),
di AS (SELECT * FROM (VALUES {ALIAS_ROWS}) AS v(kind, phrase, label, place)),
oc AS (SELECT norm, kind, phrase, label, place, length(phrase) AS size, unnest(range(0, length(norm) - length(phrase) + 1)) AS i FROM nm JOIN di ON contains(norm, phrase)),
hi AS (SELECT * FROM oc WHERE substr(norm, (i + 1)::BIGINT, size) = phrase AND (i = 0 OR NOT regexp_matches(substr(norm, i::BIGINT, 1), '[a-z0-9]'))
  AND NOT regexp_matches(substr(norm, (i + size + 1)::BIGINT, 1), '[a-z0-9]')),
so AS (SELECT norm, kind, list({{'s': i, 'e': i + size, 'v': label}} ORDER BY size DESC, place, i) AS l FROM hi GROUP BY 1, 2),
me AS MATERIALIZED (SELECT norm, kind, list_sort(list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda k: k.s < x[1].e AND x[1].s < k.e)) > 0 THEN a ELSE list_concat(a, x) END)) AS l FROM so)"""


def spelled_sql(kind: str, name: str, keep: str = "true") -> str:
    kept = f"list_filter(l, lambda m: {keep})"
    told = f"array_to_string(list_transform({kept}, lambda m: concat_ws(':', m.v, m.s, m.e)), '|')"
    return f"coalesce((SELECT {told} FROM me WHERE me.norm = nm.norm AND kind = '{kind}'), '') AS {name}"


@query(
    "alias_mentions",
    O.with_views(
        "free",
        f""", {SAID_SQL} SELECT sha256(norm) AS message_id, {spelled_sql('a_category', 'categories')}, {spelled_sql('a_color', 'colors')},
  {spelled_sql('a_use_case', 'use_cases')}, {spelled_sql('a_feature', 'features')} FROM nm""",
    ),
)
def q_alias_mentions(t: Tables):
    names = {"categories": "a_category", "colors": "a_color", "use_cases": "a_use_case", "features": "a_feature"}
    found = U.alias_mentions(said(t), {kind: U.DICTIONARIES[kind] for kind in names.values()})
    return found.select("message_id", *[spelled(F.col(kind)).alias(name) for name, kind in names.items()])


@query(
    "brand_mentions",
    O.with_views(
        "free facts",
        f"""{FREE_SQL}, b AS (SELECT min(display_value) AS brand FROM facts WHERE attribute = 'brand' GROUP BY normalized_value HAVING count(*) >= 2),
bn AS (SELECT brand, trim(regexp_replace(lower(brand), '[^a-z0-9$.''-]+', ' ', 'g')) AS phrase FROM b)
SELECT message_id, brand, position(phrase IN norm) - 1 AS start FROM nm JOIN bn ON regexp_matches(norm, '(^|[^a-z0-9])' || phrase || '([^a-z0-9]|$)')""",
    ),
)
def q_brand_mentions(t: Tables):
    found = U.brand_mentions(normalized(t), brands(t))
    return found.select("message_id", F.explode("brand_spans").alias("m")).select(
        "message_id", F.col("m.value").alias("brand"), F.col("m.start").alias("start")
    )


def parsed(t: Tables):
    return t.keep("parsed", lambda: U.parse_messages(t.free_texts, brands(t)))


@query(
    "protected_spans",
    O.with_views(
        "free",
        f""", {SAID_SQL} SELECT sha256(norm) AS message_id,
  {spelled_sql('a_color', 'colors', f"length(regexp_extract(substr(norm, (m.s + 1)::BIGINT), '{esc(V.COLOR_IDIOMS)}')) < m.e - m.s + 1")},
  {spelled_sql('a_material', 'materials', f"NOT regexp_matches(substr(norm, (greatest(0, m.s - 16) + 1)::BIGINT, (m.s - greatest(0, m.s - 16))::BIGINT), '{esc(V.MATERIAL_BEFORE)}') AND NOT regexp_matches(substr(norm, (m.e + 1)::BIGINT, 12), '{esc(V.MATERIAL_AFTER)}')")}
FROM nm""",
    ),
)
def q_protected_spans(t: Tables):
    text = F.col("norm")
    found = U.alias_mentions(said(t), {kind: U.DICTIONARIES[kind] for kind in ("a_color", "a_material")})
    return found.select(
        "message_id", spelled(U.unprotected_colors(text, F.col("a_color"))).alias("colors"),
        spelled(U.unprotected_materials(text, F.col("a_material"))).alias("materials"),
    )


@query("negation_flags")
def q_negation_flags(t: Tables):
    rows = parsed(t).select("message_id", F.explode(F.concat("m_color", "m_material", "m_brand", "m_use_case", "m_feature")).alias("m"))
    return rows.select("message_id", F.col("m.value").alias("value"), F.col("m.start").alias("start"), F.col("m.negated").alias("negated"))


@query("slot_polarity")
def q_slot_polarity(t: Tables):
    def role(name):
        return F.transform(
            name, lambda s: F.struct(s["attribute"].alias("attribute"), F.lit(name).alias("role"), F.array_join(s["values"], "|").alias("values"))
        )

    rows = parsed(t).select("message_id", F.explode(F.concat(role("required"), role("alternatives"), role("excluded"))).alias("s"))
    return rows.select("message_id", "s.attribute", "s.role", "s.values")


REMOVED_SQL = ", ".join(
    "CASE WHEN regexp_matches(norm, '" + esc("|".join(p.format(w) for p in V.REMOVAL_PATTERNS) + ("|" + V.NO_BUDGET if a == "budget" else "")) + f"') THEN '{a}' END"
    for a, w in V.REMOVABLE.items()
)


@query("removed_attributes", O.with_views("free", f"{FREE_SQL} SELECT message_id, concat_ws('|', {REMOVED_SQL}) AS removed FROM nm"))
def q_removed_attributes(t: Tables):
    return normalized(t).select("message_id", F.array_join(U.removed_attributes(F.col("norm")), "|").alias("removed"))


PRICE_SQL = " ".join(f"WHEN regexp_matches(norm, '{esc(p)}') THEN regexp_extract(norm, '{esc(p)}', 1)::DOUBLE" for p, _ in V.PRICE_PATTERNS)
INCLUSIVE_SQL = " ".join(f"WHEN regexp_matches(norm, '{esc(p)}') THEN {str(i).lower()}" for p, i in V.PRICE_PATTERNS)


@query("price_ceiling_parse", O.with_views("free", f"{FREE_SQL} SELECT message_id, CASE {PRICE_SQL} END AS max_price, CASE {INCLUSIVE_SQL} END AS inclusive FROM nm"))
def q_price_ceiling_parse(t: Tables):
    found = U.price_ceiling_parse(F.col("norm"))
    return normalized(t).withColumn("p", found).select("message_id", "p.max_price", "p.inclusive")


@query(
    "size_parse",
    O.with_views("free", f"{FREE_SQL} SELECT message_id, concat_ws('|', nullif(regexp_extract(norm, '{esc(V.SIZE_PATTERN)}', 1), ''), nullif(regexp_extract(norm, '{esc(V.SIZE_PATTERN)}', 2), '')) AS sizes FROM nm"),
)
def q_size_parse(t: Tables):
    return normalized(t).select("message_id", F.array_join(U.size_parse(F.col("norm")), "|").alias("sizes"))


@query("utterance_intent")
def q_utterance_intent(t: Tables):
    return parsed(t).select("message_id", "category", "intent", "has_constraints", "qualitative_budget")


WORDS_SQL = "trim(regexp_replace(replace(lower(text), '’', ''''), '[^a-z0-9]+', ' ', 'g'))"
CUE_SQL = (
    "CASE WHEN "
    + " OR ".join(f"contains(w, '{X.intent_words(c)}')" for c in V.OVERRIDE_CUES)
    + f" THEN 'intent_override' WHEN contains(w, '{X.intent_words(V.INTENT_CUES['browsing'])}') THEN 'exploring_unknown'"
    + f" WHEN contains(w, '{X.intent_words(V.INTENT_CUES['boundary'])}') THEN 'boundary'"
    + f" WHEN contains(w, '{X.intent_words(V.INTENT_CUES['buying'])}') THEN 'buying' END"
)


@query("opening_intent", O.with_views("messages", f", w AS (SELECT session_id, turn, {WORDS_SQL} AS w FROM messages) SELECT session_id, turn, {CUE_SQL} AS intent FROM w"))
def q_opening_intent(t: Tables):
    return t.messages.select("session_id", "turn", N.cue_intent(F.col("text")).alias("intent"))


@query("opening_intent_fuzzy")
def q_opening_intent_fuzzy(t: Tables):
    return t.messages.filter(F.col("turn") == 1).select("session_id", U.opening_intent(F.col("text")).alias("intent"))


@query(
    "template_extract",
    O.with_views(
        "messages",
        f""", w AS (SELECT session_id, turn, text, {WORDS_SQL} AS w, regexp_replace(trim(text), '^\\s*I(''m| am) looking for\\s+', '') AS body FROM messages),
i AS (SELECT *, coalesce({CUE_SQL}, 'unknown') AS intent FROM w),
e AS (SELECT *, CASE WHEN intent = 'unknown' AND contains(body, '.') AND trim(split_part(body, '.', 1)) <> '' AND {O.clean("substr(body, instr(body, '.') + 1)", None)} <> '' THEN 'provisional_override' ELSE intent END AS scenario FROM i)
SELECT session_id, turn, scenario, CASE scenario WHEN 'buying' THEN trim(regexp_extract(body, '^(.*?)\\.\\s*A key requirement is\\s*:', 1)) WHEN 'exploring_unknown' THEN trim(regexp_split_to_array(body, ',|\\bbut\\b')[1])
  WHEN 'provisional_override' THEN trim(split_part(body, '.', 1)) WHEN 'unknown' THEN trim(split_part(body, '.', 1), ' ,.') ELSE trim(regexp_split_to_array(body, '[.,]')[1]) END AS category,
  CASE scenario WHEN 'buying' THEN {O.clean("split_part(body, 'A key requirement is:', 2)", None)} WHEN 'provisional_override' THEN {O.clean("substr(body, instr(body, '.') + 1)", None)} END AS value,
  CASE WHEN intent = 'intent_override' THEN {O.clean("string_split(text, ':')[-1]", None)} END AS replacement,
  CASE WHEN starts_with(text, 'For that, what matters is:') THEN substr(text, 27) END AS payload FROM e""",
    ),
)
def q_template_extract(t: Tables):
    found = t.messages.withColumn("e", U.template_extract(F.col("text")))
    return found.select(
        "session_id", "turn", "e.scenario", "e.category", "e.value",
        U.override_replacement(F.col("text")).alias("replacement"), U.answer_payload(F.col("text")).alias("payload"),
    )


@query("contextual_answer")
def q_contextual_answer(t: Tables):
    asked = F.element_at(F.array(*[F.lit(a) for a in V.QUESTIONS]), (F.pmod("session_id", F.lit(9)) + 1).cast("int"))
    said = F.element_at(
        F.array(F.lit("no preference"), F.lit("about $1,250"), F.lit("size 10"), F.lit("XL"), F.get(F.col("constraints"), F.lit(0))["display"],
                F.element_at("constraints", -1)["display"], F.lit("Brand#7")),
        (F.pmod("session_id", F.lit(7)) + 1).cast("int"),
    )
    replies = t.session_profiles.select("session_id", F.lit(2).alias("turn"), asked.alias("asked"), said.alias("text"))
    return U.contextual_answer(replies, t.facts)


# --- session state -----------------------------------------------------------


def flagged(t: Tables):
    return t.messages.select("session_id", "turn", "text", N.is_override(F.col("text")).alias("is_override"))


OVERRIDE_SQL = " OR ".join(f"contains(lower(text), '{esc(c)}')" for c in V.OVERRIDE_CUES)


@query(
    "intent_epoch",
    O.with_views(
        "messages",
        f""", e AS (SELECT session_id, turn, sum(({OVERRIDE_SQL})::INT) OVER (PARTITION BY session_id ORDER BY turn)::BIGINT AS epoch FROM messages)
SELECT session_id, turn, epoch, epoch < max(epoch) OVER (PARTITION BY session_id) AS obsolete FROM e""",
    ),
)
def q_intent_epoch(t: Tables):
    return N.intent_epoch(flagged(t), F.col("is_override")).select("session_id", "turn", "epoch", "obsolete")


@query(
    "recent_fragments",
    O.with_views(
        "messages",
        f""", f AS (SELECT session_id, turn, CASE WHEN length(text) >= 3 AND NOT regexp_matches(text, '{esc(V.SEMANTIC_OPERATORS)}') THEN text END AS fragment, {OVERRIDE_SQL} AS clears FROM messages),
s AS (SELECT session_id, coalesce(max(turn) FILTER (clears), -1) AS start FROM f GROUP BY 1),
u AS (SELECT session_id, min(turn) AS turn, arg_min(fragment, turn) AS fragment FROM f JOIN s USING (session_id) WHERE turn >= start AND fragment IS NOT NULL GROUP BY session_id, lower(fragment)),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM u)
SELECT session_id, string_agg(fragment, '|' ORDER BY turn) AS fragments FROM k WHERE rn <= 3 GROUP BY 1""",
    ),
)
def q_recent_fragments(t: Tables):
    turns = t.messages.select(
        "session_id", "turn", X.semantic_fragment(F.col("text")).alias("fragment"), N.is_override(F.col("text")).alias("clears")
    )
    return N.recent_fragments(turns).select("session_id", F.array_join("fragments", "|").alias("fragments"))


@query(
    "ordered_dedup",
    """SELECT user_id, k AS value, row_number() OVER (PARTITION BY user_id ORDER BY first_id, k) AS position FROM
(SELECT user_id, json_extract_string(props, '$.k') AS k, min(event_id) AS first_id FROM events GROUP BY 1, 2)""",
)
def q_ordered_dedup(t: Tables):
    rows = t.table("events").select("user_id", F.get_json_object("props", "$.k").alias("value"), "event_id")
    return ordering.ordered_dedup(rows, "user_id", "value", "event_id").select("user_id", "value", "position")


def sequenced_edits(t: Tables):
    """Edits with one sortable number per event: microseconds, then the whole event id."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(19,0)")
    seq = (micros * F.lit("9223372036854775808").cast("decimal(19,0)") + F.col("event_id")).cast("decimal(38,0)")
    return t.edits.select("session_id", seq.alias("seq"), "op", "attribute", "value")


@query(
    "fold_edits_batch",
    O.with_views(
        "edits",
        """, s AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS seq FROM edits),
r AS (SELECT session_id, attribute, max(seq) FILTER (op = 'remove') AS removed FROM s WHERE op <> 'clear' GROUP BY 1, 2),
z AS (SELECT r.session_id, r.attribute, greatest(coalesce(removed, -1), coalesce((SELECT max(seq) FROM s WHERE op = 'clear' AND s.session_id = r.session_id), -1)) AS reset_at FROM r),
live AS (SELECT s.* FROM s JOIN z USING (session_id, attribute) WHERE seq > reset_at AND op <> 'clear'),
p AS (SELECT session_id, attribute, arg_max(value, seq) AS value, arg_max(op, seq) AS op, max(seq) AS seq FROM live WHERE op IN ('set', 'alternatives') GROUP BY 1, 2),
x AS (SELECT session_id, attribute, value, max(seq) FILTER (op = 'exclude') AS ex, max(seq) FILTER (op IN ('set', 'alternatives')) AS pt FROM live GROUP BY 1, 2, 3)
SELECT session_id, attribute, value, 'excluded' AS role FROM x WHERE ex > coalesce(pt, -1)
UNION ALL SELECT p.session_id, p.attribute, p.value, CASE WHEN op = 'set' THEN 'required' ELSE 'alternative' END FROM p
  LEFT JOIN x ON x.session_id = p.session_id AND x.attribute = p.attribute AND x.value = p.value WHERE coalesce(ex, -1) < p.seq""",
    ),
)
def q_fold_edits_batch(t: Tables):
    return N.fold_edits_batch(sequenced_edits(t))


SPOKEN_FIELDS = ("material", "color", "size", "style", "brand", "price", "budget", "category")


def spoken_edits(t: Tables):
    """Edits of attributes, prices, budgets and categories, numbered within their session."""
    kind = F.element_at(F.array(*[F.lit(a) for a in SPOKEN_FIELDS]), (F.pmod(F.floor("value"), F.lit(8)) + 1).cast("int"))
    event, said = F.col("event_type"), F.col("kind")
    op = (
        F.when(event == "signup", "clear").when(event == "error", "exclude").when(event == "purchase", "remove")
        .when((said == "category") & (event == "click"), "new_category").when(said.isin("price", "budget", "category"), said)
        .when(event == "view", "set").otherwise("alternatives")
    )
    rows = t.table("events").withColumn("kind", kind).select(
        F.col("user_id").alias("session_id"), "ts", "event_id", op.alias("op"),
        F.when(said == "price", "budget").otherwise(said).alias("attribute"),
        F.when(said == "price", F.floor("value").cast("string")).otherwise(F.concat(F.lit("v"), F.get_json_object("props", "$.k"))).alias("value"),
    )
    line = ordering.ranged(rows, ["session_id", "ts", "event_id"])
    return ordering.numbered(line, ["session_id"], [F.col("ts"), F.col("event_id")], F.col("range"), "seq")


@query(
    "preference_history",
    f"""WITH k AS (SELECT *, ([{', '.join(f"'{a}'" for a in SPOKEN_FIELDS)}])[(floor(value)::BIGINT % 8) + 1] AS said FROM events),
e AS MATERIALIZED (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  CASE WHEN event_type = 'signup' THEN 'clear' WHEN event_type = 'error' THEN 'exclude' WHEN event_type = 'purchase' THEN 'remove'
    WHEN said = 'category' AND event_type = 'click' THEN 'new_category' WHEN said IN ('price', 'budget', 'category') THEN said
    WHEN event_type = 'view' THEN 'set' ELSE 'alternatives' END AS op,
  CASE said WHEN 'price' THEN 'budget' ELSE said END AS attribute,
  CASE said WHEN 'price' THEN floor(value)::BIGINT::VARCHAR ELSE 'v' || json_extract_string(props, '$.k') END AS value FROM k),
w AS (SELECT session_id, seq, attribute, value, 'put' AS kind, CASE op WHEN 'set' THEN 'required' ELSE 'alternative' END AS role FROM e WHERE op IN ('set', 'alternatives')
  UNION ALL SELECT session_id, seq, attribute, value, 'exclude', 'excluded' FROM e WHERE op = 'exclude'
  UNION ALL SELECT session_id, seq, unnest(CASE attribute WHEN 'budget' THEN ['budget', 'maximum_price'] ELSE [attribute] END), NULL, 'reset', NULL FROM e WHERE op = 'remove'
  UNION ALL SELECT session_id, seq, 'budget', CASE op WHEN 'price' THEN 'maximum $' || value ELSE value END, 'put', 'stated' FROM e WHERE op IN ('price', 'budget')
  UNION ALL SELECT session_id, seq, 'maximum_price', value, 'put', 'ceiling' FROM e WHERE op = 'price'
  UNION ALL SELECT session_id, seq, 'category', value, 'put', 'category' FROM e WHERE op IN ('category', 'new_category')),
v AS MATERIALIZED (SELECT * FROM w WHERE kind = 'reset' OR value IS NOT NULL
  UNION ALL SELECT e.session_id, seq, f.attribute, NULL, 'reset', NULL FROM e JOIN (SELECT DISTINCT session_id, attribute FROM w WHERE attribute <> 'category') f USING (session_id) WHERE op IN ('clear', 'new_category')),
ends AS MATERIALIZED (SELECT p.session_id, p.attribute, p.value, p.kind, p.role, p.seq AS since, min(x.seq) AS until FROM v p
  LEFT JOIN v x ON x.session_id = p.session_id AND x.attribute = p.attribute AND x.seq > p.seq
    AND (x.kind = 'reset' OR (p.kind = 'put' AND x.kind = 'put') OR (x.kind <> p.kind AND x.value = p.value))
  WHERE p.kind <> 'reset' GROUP BY ALL),
again AS (SELECT *, lag(until) OVER o AS till, lag(since) OVER o AS was FROM ends WHERE kind = 'exclude' WINDOW o AS (PARTITION BY session_id, attribute, value ORDER BY since))
SELECT session_id, attribute, value, role, since, until FROM ends WHERE kind = 'put'
UNION ALL SELECT session_id, attribute, value, role, since, until FROM again WHERE was IS NULL OR till <= since""",
)
def q_preference_history(t: Tables):
    return N.preference_history(spoken_edits(t))


@query("customer_history")
def q_customer_history(t: Tables):
    """Wishes of a customer, one per order, parsed, turned into edits and folded: the state after each wish."""
    owner = t.table("orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("session_id"))
    wishes = parsed(t).withColumnRenamed("message_id", "seq").join(owner, "seq")
    return N.preference_history(N.edits_of_messages(wishes))


@query("fold_edits_stream", ORACLES["fold_edits_batch"])
def q_fold_edits_stream(t: Tables):
    """The edits replayed as a file stream; the last emission per session."""
    spark = t.spark
    source, sink = scratch_path(spark, "edits-in"), scratch_path(spark, "edits-out")
    sequenced_edits(t).repartition(4, "seq").write.parquet(source)
    edits = (
        spark.readStream.schema("session_id bigint, seq decimal(38,0), op string, attribute string, value string")
        .option("maxFilesPerTrigger", 2).parquet(source)
    )

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    run = (
        stream.fold_edits_stream(edits, idle_minutes=None).writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", scratch_path(spark, "edits-checkpoint"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    out = spark.read.parquet(f"{sink}/batch=*")
    last = out.groupBy("session_id").agg(F.max("batch").alias("batch"))
    return out.join(last, ["session_id", "batch"]).filter(F.col("role") != "none").select(
        "session_id", "attribute", "value", "role"
    )


ARRIVALS = 6
ARRIVAL_SQL = f"""(SELECT *, ((epoch_us(ts) - min(epoch_us(ts)) OVER ()) * {ARRIVALS} // (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1)) AS slot FROM events)"""


def arriving_turns(t: Tables):
    """(session_id, turn, ts, arrival): events as turns, a fifth of them twice, some far too late."""
    events = t.table("events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), "ts")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = events.agg(F.min(us).alias("first"), F.max(us).alias("last"))
    # One row of bounds.
    slotted = events.crossJoin(F.broadcast(ends)).withColumn(
        "slot", F.expr(f"(unix_micros(cast(ts AS timestamp)) - first) * {ARRIVALS} DIV (last - first + 1)")
    )
    held = (F.pmod("turn", F.lit(97)) == 0) & (F.col("slot") < 2)
    once = slotted.withColumn("arrival", F.when(held, F.col("slot") + 4).otherwise(F.col("slot")))
    again = once.where(F.pmod("turn", F.lit(5)) == 0).withColumn("arrival", F.least(F.col("arrival") + 1, F.lit(ARRIVALS - 1)))
    return once.unionByName(again).select("session_id", "turn", F.col("ts").cast("timestamp").alias("ts"), "arrival")


@query(
    "dedup_late_turns",
    f"SELECT user_id AS session_id, event_id AS turn, count(*)::BIGINT AS n, event_id % 97 = 0 AND slot < 2 AS late FROM {ARRIVAL_SQL} GROUP BY ALL",
)
def q_dedup_late_turns(t: Tables):
    """Turns as the stream keeps them: each once (``n``), or dropped as late."""
    spark = t.spark
    source, sink, progress = (scratch_path(spark, f"turns-{x}") for x in ("in", "out", "checkpoint"))
    arriving = t.keep("arriving_turns", lambda: arriving_turns(t))
    schema = "session_id bigint, turn bigint, ts timestamp"

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    for arrival in range(ARRIVALS):
        # What has come so far is worked off before the next lot lands; the checkpoint carries the state.
        arriving.where(F.col("arrival") == arrival).drop("arrival").write.mode("append").parquet(source)
        run = (
            stream_turns.dedup_late_turns(spark.readStream.schema(schema).parquet(source))
            .writeStream.outputMode("append").foreachBatch(keep)
            .option("checkpointLocation", progress).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    kept = spark.read.schema(schema).parquet(f"{sink}/batch=*").groupBy("session_id", "turn").agg(F.count("*").alias("n"))
    every = arriving.select("session_id", "turn").distinct()
    return every.join(kept, ["session_id", "turn"], "left").select(
        "session_id", "turn", F.coalesce("n", F.lit(1)).alias("n"), F.col("n").isNull().alias("late")
    )


def asked_turns(t: Tables):
    """Every turn asks the attribute its message answers; buying openings advance."""
    asked = F.get(F.col("known"), F.col("turn") - 1)["attribute"]
    return t.states.select(
        "session_id", "turn", asked.alias("asked"),
        ((F.col("scenario") == "buying") & (F.col("turn") == 1)).alias("advances"),
    )


@query(
    "session_turn_progress",
    O.with_views(
        "states",
        f""", a AS (SELECT session_id, turn, known[turn].attribute AS asked, scenario = 'buying' AND turn = 1 AS advances FROM states),
q AS (SELECT unnest([{O.quoted(V.QUESTIONS)}]) AS name, unnest([0, 1, 1, 1, 2, 2, 2, 3, 4]) AS stage, unnest(generate_series(1, 9)) AS pos),
g AS (SELECT a.session_id, q.name, min(turn) AS gone_at FROM a LEFT JOIN q AS own ON own.name = a.asked JOIN q ON q.name = a.asked OR (a.advances AND own.stage >= q.stage) GROUP BY 1, 2)
SELECT a.session_id, a.turn, coalesce(string_agg(q.name, '|' ORDER BY q.pos) FILTER (gone_at <= a.turn), '') AS exhausted,
  coalesce(string_agg(q.name, '|' ORDER BY q.pos) FILTER (gone_at IS NULL OR gone_at > a.turn), '') AS remaining,
  coalesce(min(q.stage) FILTER (gone_at IS NULL OR gone_at > a.turn), 5) AS stage
FROM a CROSS JOIN q LEFT JOIN g ON g.session_id = a.session_id AND g.name = q.name GROUP BY 1, 2""",
    ),
)
def q_session_turn_progress(t: Tables):
    found = N.session_turn_progress(asked_turns(t))
    return found.select(
        "session_id", "turn", F.array_join("exhausted", "|").alias("exhausted"),
        F.array_join("remaining", "|").alias("remaining"), "stage",
    )


@query(
    "scenario_transitions",
    O.with_views(
        "messages",
        f""", w AS (SELECT session_id, turn, {WORDS_SQL} AS w, {OVERRIDE_SQL} AS ov FROM messages),
c AS (SELECT session_id, turn, ov, {CUE_SQL} AS cue FROM w),
o AS (SELECT session_id, coalesce(cue, 'provisional_override') AS opening FROM c WHERE turn = 1),
v AS (SELECT session_id, min(turn) AS at FROM c WHERE ov AND turn > 1 GROUP BY 1),
b AS (SELECT session_id, min(turn) AS at, arg_min(coalesce(cue = 'boundary', false), turn) AS bd FROM c WHERE turn > 1 AND NOT ov GROUP BY 1)
SELECT c.session_id, c.turn, CASE WHEN v.at <= c.turn THEN 'intent_override' WHEN opening = 'exploring_unknown' AND b.at <= c.turn THEN CASE WHEN bd THEN 'boundary' ELSE 'browsing' END ELSE opening END AS scenario_state
FROM c JOIN o USING (session_id) LEFT JOIN v ON v.session_id = c.session_id LEFT JOIN b ON b.session_id = c.session_id""",
    ),
)
def q_scenario_transitions(t: Tables):
    cue = N.cue_intent(F.col("text"))
    turns = t.messages.select(
        "session_id", "turn", F.coalesce(cue, F.lit("provisional_override")).alias("opening"),
        N.is_override(F.col("text")).alias("is_override"), F.coalesce(cue == "boundary", F.lit(False)).alias("is_boundary"),
    )
    return N.scenario_transitions(turns)
