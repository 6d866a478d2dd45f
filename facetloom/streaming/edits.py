"""The preference fold over a stream of edits.

The state of a session is a set of maxima (last clear, last removal and last
positive edit per field, last put and last exclusion per value), so edits may
arrive in any order and the outcome equals the batch fold.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

OUTPUT = "session_id bigint, attribute string, value string, role string"
STATE = "folded string"


def merge(state: dict, rows) -> dict:
    """Fold (seq, op, attribute, value) rows into ``state`` (plain maxima)."""
    fields = state.setdefault("fields", {})
    for seq, op, attribute, value in rows:
        if op == "clear":
            state["cleared"] = max(state.get("cleared", -1), seq)
            continue
        f = fields.setdefault(attribute, {"removed": -1, "values": {}})
        if op == "remove":
            f["removed"] = max(f["removed"], seq)
            continue
        put, kind, excluded = f["values"].get(value, (-1, "", -1))
        if op == "exclude":
            excluded = max(excluded, seq)
        elif seq > put:
            put, kind = seq, op
        f["values"][value] = (put, kind, excluded)
    for f in fields.values():
        reset = max(f["removed"], state.get("cleared", -1))
        f["values"] = {v: x for v, x in f["values"].items() if max(x[0], x[2]) > reset}
    return state


def current(state: dict):
    """(attribute, value, role) rows of a folded session."""
    for attribute, f in state.get("fields", {}).items():
        reset = max(f["removed"], state.get("cleared", -1))
        last = max((x[0] for x in f["values"].values()), default=-1)
        for value, (put, kind, excluded) in f["values"].items():
            if excluded > put:
                if excluded > reset:
                    yield attribute, value, "excluded"
            elif put == last and put > reset:
                yield attribute, value, "required" if kind == "set" else "alternative"


def fold_edits_stream(edits: DataFrame, idle_minutes: int | None = 24 * 60) -> DataFrame:
    """Current preferences of every session touched by a micro-batch.

    ``edits``: streaming (session_id, seq, op, attribute, value).  A session that
    stays silent for ``idle_minutes`` is forgotten (never, if None: a bounded
    replay must not wait for timers).  Write with output mode
    ``update``; each emission replaces the session's earlier rows, and a session
    left without preferences emits one row of role ``none``.
    """

    def step(key, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        folded = json.loads(state.get[0]) if state.exists else {}
        for batch in batches:
            rows = zip(map(int, batch["seq"]), batch["op"], batch["attribute"], batch["value"])
            folded = merge(folded, rows)
        state.update((json.dumps(folded),))
        if idle_minutes is not None:
            state.setTimeoutDuration(idle_minutes * 60 * 1000)
        rows = [(key[0], *row) for row in current(folded)] or [(key[0], None, None, "none")]
        yield pd.DataFrame(rows, columns=["session_id", "attribute", "value", "role"])

    return edits.groupBy("session_id").applyInPandasWithState(
        step, OUTPUT, STATE, "update", "NoTimeout" if idle_minutes is None else "ProcessingTimeTimeout"
    )
