"""Session state as batch jobs: epochs, edits, fragments, progress, scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.functions import text as X
from facetloom.functions import vocab as V
from facetloom.operators.ordering import following, int_block, numbered, ranged, running_sum
from facetloom.session import spread_join


def intent_epoch(turns: DataFrame, is_override: Column, block: int = 1024) -> DataFrame:
    """Add ``epoch`` (overrides so far) and ``obsolete`` (before the latest one)."""
    marked = running_sum(
        turns, ["session_id"], [F.col("turn")], int_block(F.col("turn"), block),
        is_override.cast("long"), "epoch",
    )
    latest = marked.groupBy("session_id").agg(F.max("epoch").alias("_latest"))
    return spread_join(marked, latest, ["session_id"], ["turn"]).withColumn(
        "obsolete", F.col("epoch") < F.col("_latest")
    ).drop("_latest")


def recent_fragments(turns: DataFrame, keep: int = 3) -> DataFrame:
    """Last ``keep`` distinct safe texts per session since its last clear.

    ``turns``: (session_id, turn, fragment, clears).  A repeat (ignoring case)
    of a text still held is not appended again, which makes this an ordered
    fold.  It runs over rows sorted inside partitions and holds ``keep`` texts
    at a time, so no session is ever gathered in memory.
    """
    start = turns.groupBy("session_id").agg(
        F.coalesce(F.max(F.when(F.col("clears"), F.col("turn"))), F.lit(-1)).alias("_start")
    )
    current = (
        spread_join(turns, start, ["session_id"], ["turn"])
        .filter((F.col("turn") >= F.col("_start")) & F.col("fragment").isNotNull())
        .select("session_id", "turn", "fragment")
        .repartition("session_id")
        .sortWithinPartitions("session_id", "turn")
    )

    def fold(batches):
        import pandas as pd

        session, held = None, []
        for batch in batches:
            done = []
            for sid, text in zip(batch["session_id"], batch["fragment"]):
                if session is not None and sid != session:
                    done.append((session, held))
                    held = []
                session = sid
                if text.casefold() not in [h.casefold() for h in held]:
                    held = [*held, text][-keep:]
            if done:
                yield pd.DataFrame(done, columns=["session_id", "fragments"])
        if session is not None:
            yield pd.DataFrame([(session, held)], columns=["session_id", "fragments"])

    key_type = turns.schema["session_id"].dataType.simpleString()
    return current.mapInPandas(fold, f"session_id {key_type}, fragments array<string>")


EDIT_RANK = ("clear", "remove", "set", "alternatives", "exclude")


def fold_edits_batch(edits: DataFrame) -> DataFrame:
    """Current preferences per session and attribute from ordered edits.

    ``edits``: (session_id, seq, op, attribute, value), ops as in ``EDIT_RANK``.
    ``set`` and ``alternatives`` replace the positive values of a field and lift
    the exclusion of the value; ``exclude`` adds an exclusion and takes the value
    out of the positives; ``remove`` empties the field; ``clear`` the session.

    Nothing is replayed in order: for each (session, attribute) the last reset,
    and after it the last positive edit and the last exclusion per value, decide
    the outcome, and all are maxima that combine map-side.
    """
    cleared = edits.filter(F.col("op") == "clear").groupBy("session_id").agg(F.max("seq").alias("cleared_at"))
    field_keys = ["session_id", "attribute"]
    typed = edits.filter(F.col("op") != "clear")
    per_value = typed.groupBy(*field_keys, "value").agg(
        F.max(F.when(F.col("op") == "remove", F.col("seq"))).alias("removed"),
        F.max(F.when(F.col("op").isin("set", "alternatives"), F.struct("seq", "op"))).alias("put"),
        F.max(F.when(F.col("op") == "exclude", F.col("seq"))).alias("excluded"),
    )
    per_field = per_value.groupBy(*field_keys).agg(
        F.max("removed").alias("removed_at"), F.max("put.seq").alias("put_at"),
    )
    resets = per_field.join(cleared, "session_id", "left").select(
        *field_keys, "put_at",
        F.greatest(F.coalesce("removed_at", F.lit(-1)), F.coalesce("cleared_at", F.lit(-1))).alias("reset_at"),
    )
    rows = spread_join(per_value, resets, field_keys, ["value"])
    live_put = (F.col("put.seq") == F.col("put_at")) & (F.col("put.seq") > F.col("reset_at"))
    excluded_last = F.coalesce(F.col("excluded") > F.coalesce(F.col("put.seq"), F.lit(-1)), F.lit(False))
    # The field's current positive is the value of its last positive edit,
    # unless that very value was excluded afterwards.
    positive = F.coalesce(live_put, F.lit(False)) & ~excluded_last
    exclusion = excluded_last & (F.col("excluded") > F.col("reset_at"))
    role = (
        F.when(positive & (F.col("put.op") == "set"), "required")
        .when(positive, "alternative").when(exclusion, "excluded")
    )
    return rows.withColumn("role", role).filter(F.col("role").isNotNull()).select(*field_keys, "value", "role")


def field_events(edits: DataFrame) -> DataFrame:
    """(session_id, seq, attribute, value, kind, role): what each edit does to which field.

    A ``price`` states the budget in words and sets the ceiling; a ``budget`` in words leaves the
    ceiling alone, and removing the budget lifts both.  A ``category`` refines the search, a
    ``new_category`` clears all preferences first; no clear touches the category itself.  An edit
    without session, field or needed value does nothing.
    """
    op, attribute, value = F.col("op"), F.col("attribute"), F.col("value")
    does = lambda a, v, kind, role: F.struct(
        a.alias("attribute"), v.alias("value"), F.lit(kind).alias("kind"), F.lit(role).cast("string").alias("role")
    )
    none, budget, ceiling = F.lit(None).cast("string"), F.lit("budget"), F.lit("maximum_price")
    items = (
        F.when(op == "set", F.array(does(attribute, value, "put", "required")))
        .when(op == "alternatives", F.array(does(attribute, value, "put", "alternative")))
        .when(op == "exclude", F.array(does(attribute, value, "exclude", "excluded")))
        .when((op == "remove") & (attribute == "budget"), F.array(does(attribute, none, "reset", None), does(ceiling, none, "reset", None)))
        .when(op == "remove", F.array(does(attribute, none, "reset", None)))
        .when(op == "price", F.array(does(budget, F.concat(F.lit("maximum $"), value), "put", "stated"), does(ceiling, value, "put", "ceiling")))
        .when(op == "budget", F.array(does(budget, value, "put", "stated")))
        .when(op.isin("category", "new_category"), F.array(does(F.lit("category"), value, "put", "category")))
    )
    events = edits.select("session_id", "seq", F.explode(items).alias("e")).select("session_id", "seq", "e.*")
    events = events.filter(
        F.col("session_id").isNotNull() & F.col("seq").isNotNull() & F.col("attribute").isNotNull()
        & ((F.col("kind") == "reset") | F.col("value").isNotNull())
    )
    clears = edits.filter(op.isin("clear", "new_category") & F.col("seq").isNotNull()).select("session_id", "seq").distinct()
    fields = events.filter(F.col("attribute") != "category").select("session_id", "attribute").distinct()
    cleared = spread_join(clears, fields, ["session_id"], ["seq"]).select(
        "session_id", "seq", "attribute", none.alias("value"), F.lit("reset").alias("kind"), none.alias("role")
    )
    return events.unionByName(cleared)


def preference_history(edits: DataFrame) -> DataFrame:
    """(session_id, attribute, value, role, since, until): the state after every edit, as intervals.

    ``edits``: (session_id, seq, op, attribute, value), ops as in ``field_events``.  A row holds after
    every edit of a number from ``since`` to below ``until`` (null: to the end), so the table grows with
    the edits, not with edits times preferences.  Edits of one number act together: resets first, then
    positive ones, then exclusions.  Repeated edits are one; an exclusion said again goes on.

    An interval ends at the nearest later edit of a kind, which is found range by range, so a
    session that holds a third of all edits is no task of its own.
    """
    events = field_events(edits)
    field = ["session_id", "attribute"]
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("seq")))
    line = ranged(events.groupBy(*field, "seq").agg(at("put").alias("put"), at("reset").alias("reset")), [*field, "seq"])
    ahead = following(line, field, "seq", F.col("range"), {"next_put": F.col("put"), "next_reset": F.col("reset")})
    behind = following(line, field, "seq", F.col("range"), {"last_reset": F.col("reset")}, back=True)
    resets = ahead.select(*field, "seq", "next_put", "next_reset").join(
        behind.select(*field, "seq", F.coalesce("reset", "last_reset").alias("last_reset")), [*field, "seq"]
    )
    said = events.filter(F.col("kind") != "reset").groupBy(*field, "value", "seq").agg(
        at("put").alias("put"), at("exclude").alias("excluded"),
        F.min(F.when(F.col("kind") == "put", F.col("role"))).alias("role"),
    )
    said = ranged(said, [*field, "value", "seq"])
    key = [*field, "value"]
    later = following(said, key, "seq", F.col("range"), {"next_same": F.col("put"), "next_exclude": F.col("excluded")})
    before = F.struct("seq", F.col("excluded").isNotNull().alias("out"))
    earlier = following(said, key, "seq", F.col("range"), {"before": before}, back=True).select(*key, "seq", "before")
    rows = later.join(earlier, [*key, "seq"]).join(resets, [*field, "seq"])
    goes_on = F.col("before.out") & F.coalesce(F.col("last_reset") <= F.col("before.seq"), F.lit(True)) & F.col("put").isNull()
    holds = (
        F.when(
            F.col("excluded").isNotNull() & ~F.coalesce(goes_on, F.lit(False)),
            F.struct(F.lit("excluded").alias("role"), F.least("next_reset", "next_same").alias("until")),
        )
        .when(
            F.col("excluded").isNull(),
            F.struct(F.col("role"), F.least("next_put", "next_reset", "next_exclude").alias("until")),
        )
    )
    return rows.withColumn("h", holds).filter(F.col("h").isNotNull()).select(
        *key, F.col("h.role").alias("role"), F.col("seq").alias("since"), F.col("h.until").alias("until")
    )


def edits_of_messages(parsed: DataFrame) -> DataFrame:
    """(session_id, seq, op, attribute, value): the edits that parsed messages make.

    ``parsed``: session_id, seq and the slots of ``parse_messages``.  Values of one message share its
    number.  Alternative or excluded categories are a field of their own, ``categories``, beside the
    one category that a message may name.
    """
    field = lambda a: F.when(a == "category", "categories").otherwise(a)
    edit = lambda op, a, v: F.struct(F.lit(op).alias("op"), a.cast("string").alias("attribute"), v.cast("string").alias("value"))
    none = F.lit(None).cast("string")

    def each(column: str, op: str):
        return F.flatten(F.transform(column, lambda s: F.transform(s["values"], lambda v: edit(op, field(s["attribute"]), v))))

    slots = [each("required", "set"), each("alternatives", "alternatives"), each("excluded", "exclude")]
    one = lambda op, c: F.when(c.isNotNull(), F.array(edit(op, none, c)))
    price = F.regexp_replace(F.col("max_price").cast("decimal(18,2)").cast("string"), r"\.?0+$", "")
    parts = [
        F.transform("removed", lambda a: edit("remove", a, none)), *slots,
        one("price", price), one("budget", F.col("qualitative_budget")), one("category", F.col("category")),
    ]
    empty = F.array().cast("array<struct<op:string,attribute:string,value:string>>")
    return parsed.select("session_id", "seq", F.inline(F.concat(*[F.coalesce(p, empty) for p in parts])))


def attribute_stage(attribute: Column) -> Column:
    result = F.when(F.lit(False), 0)
    for i, stage in enumerate(V.STAGES):
        result = result.when(attribute.isin(*stage), i)
    return result


def session_turn_progress(turns: DataFrame) -> DataFrame:
    """Remaining and exhausted attributes, and the stage, after every turn.

    ``turns``: (session_id, turn, asked, advances); an asked attribute is
    exhausted, an advancing one also exhausts all of its and earlier stages.
    There are nine attributes, so a turn's exhausted set is nine first-exhausted
    turns compared with it: one aggregate row per session.
    """
    stage = attribute_stage(F.col("asked"))
    firsts = []
    for i, names in enumerate(V.STAGES):
        for name in names:
            gone = (F.col("asked") == name) | (F.col("advances") & (stage >= i))
            firsts.append(F.min(F.when(gone, F.col("turn"))).alias(f"x_{name}"))
    per_session = turns.groupBy("session_id").agg(*firsts)
    rows = spread_join(turns, per_session, ["session_id"], ["turn"])
    gone_by = lambda a: F.coalesce(F.col(f"x_{a}") <= F.col("turn"), F.lit(False))
    exhausted = F.array_compact(F.array(*[F.when(gone_by(a), F.lit(a)) for a in V.QUESTIONS]))
    remaining = F.array_compact(F.array(*[F.when(~gone_by(a), F.lit(a)) for a in V.QUESTIONS]))
    first_left = F.get(remaining, F.lit(0))
    return rows.select(
        "session_id", "turn", exhausted.alias("exhausted"), remaining.alias("remaining"),
        F.coalesce(attribute_stage(first_left), F.lit(len(V.STAGES))).alias("stage"),
    )


def scenario_transitions(turns: DataFrame) -> DataFrame:
    """Scenario after every turn of a template session.

    ``turns``: (session_id, turn, opening, is_override, is_boundary).  The first
    turn's ``opening`` holds until an override; an exploring session becomes
    boundary or browsing at its first reply that is not an override.
    """
    per_session = turns.groupBy("session_id").agg(
        F.min_by("opening", "turn").alias("first_opening"), F.min("turn").alias("first_turn"),
        F.min(F.when(F.col("is_override"), F.col("turn"))).alias("override_at"),
    )
    replies = spread_join(turns, per_session, ["session_id"], ["turn"])
    resolving = (F.col("turn") > F.col("first_turn")) & ~F.col("is_override")
    resolved = replies.groupBy("session_id").agg(
        F.min(F.when(resolving, F.struct("turn", "is_boundary"))).alias("r")
    )
    rows = spread_join(replies, resolved, ["session_id"], ["turn"])
    overridden = F.coalesce(
        (F.col("override_at") <= F.col("turn")) & (F.col("override_at") > F.col("first_turn")), F.lit(False)
    )
    settled = F.coalesce(F.col("r.turn") <= F.col("turn"), F.lit(False))
    scenario = (
        F.when(overridden, "intent_override")
        .when(
            (F.col("first_opening") == "exploring_unknown") & settled,
            F.when(F.col("r.is_boundary"), "boundary").otherwise("browsing"),
        )
        .otherwise(F.col("first_opening"))
    )
    return rows.select("session_id", "turn", scenario.alias("scenario_state"))


def is_override(text: Column) -> Column:
    low = F.lower(text)
    result = F.lit(False)
    for cue in V.OVERRIDE_CUES:
        result = result | low.contains(cue)
    return result


def cue_intent(text: Column) -> Column:
    """Opening intent by exact wording; null when no cue is present."""
    words = X.intent_text(text)
    has = lambda cue: words.contains(X.intent_words(cue))
    override = F.lit(False)
    for cue in V.OVERRIDE_CUES:
        override = override | has(cue)
    return (
        F.when(override, "intent_override")
        .when(has(V.INTENT_CUES["browsing"]), "exploring_unknown")
        .when(has(V.INTENT_CUES["boundary"]), "boundary")
        .when(has(V.INTENT_CUES["buying"]), "buying")
    )


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Number a session's messages when only their order is given."""
    return numbered(turns, ["session_id"], [F.col("seq")], int_block(F.col("seq"), 1 << 20), "turn")
