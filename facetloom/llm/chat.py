"""Chat formatting: a finite-state machine over roles and a declarative template.

A template says how each role's text is opened and closed, which roles may
follow which, and whose text carries loss. Turns of a conversation stream
through the machine in order; each comes out as one formatted chunk with its
segments, (text, loss) in turn, and whether its role was allowed here. Control
strings inside texts are escaped so that the chunk can be read back exactly.

Conversations are dealt by id and sorted inside the partition; a task holds one
turn at a time, so a very long conversation needs no memory, though its turns
follow one another. Null texts and roles are empty ones. Roles that the template
doesn't know get a generic marker and are never allowed. Turns with equal
numbers are ordered by role, then text; null numbers come first; repeated rows
are turns of their own. A null conversation id is a conversation like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import arrow_map


@dataclass(frozen=True)
class Template:
    """What surrounds texts, which roles follow which, and where loss is taken.

    Control strings start with ``<`` or ``[``, hold neither of them further on,
    and contain no escape character, so none can straddle a text's edge.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"),
    })
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    loss: frozenset[str] = frozenset({"assistant"})
    after: dict[str, frozenset[str]] = field(default_factory=lambda: {
        "": frozenset({"system", "user"}), "system": frozenset({"user"}),
        "user": frozenset({"assistant"}), "assistant": frozenset({"user"}),
    })
    escape: str = "\\"

    def __post_init__(self) -> None:
        for c in self.controls():
            if c[0] not in "<[" or set(c[1:]) & set("<[") or self.escape in c or len(c) < 2:
                raise ValueError(f"control string {c!r} could straddle a text's edge")

    def controls(self) -> list[str]:
        return sorted({c for pair in self.marks.values() for c in pair} | set(self.other))

    def hide(self, text: str) -> str:
        """The text without control strings in it; ``show`` undoes it."""
        e = self.escape
        text = text.replace(e, e + e)
        return _controls(self).sub(lambda m: m[0][0] + e + m[0][1:], text) if "<" in text or "[" in text else text

    def show(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(" + re.escape(self.escape) + "?)", lambda m: m[1], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) pieces of one turn."""
        if role in self.marks:
            start, end = self.marks[role]
            return [(start, False), (self.hide(text), role in self.loss), (end, False)]
        start, middle, end = self.other
        return [(start, False), (self.hide(role), False), (middle, False), (self.hide(text), False), (end, False)]

    def read(self, chunk: str) -> list[tuple[str, str]]:
        """(role, text) of the turns in a formatted string."""
        by_start = {start: role for role, (start, _) in self.marks.items()}
        pieces = _controls(self).split(chunk)
        turns, at = [], 1
        while at < len(pieces):
            if pieces[at] in by_start:
                turns.append((by_start[pieces[at]], self.show(pieces[at + 1])))
                at += 4
            else:
                turns.append((self.show(pieces[at + 1]), self.show(pieces[at + 3])))
                at += 6
        return turns


_PATTERNS: dict[tuple[str, ...], re.Pattern] = {}


def _controls(template: Template) -> re.Pattern:
    names = tuple(template.controls())
    if names not in _PATTERNS:
        _PATTERNS[names] = re.compile("(" + "|".join(map(re.escape, names)) + ")")
    return _PATTERNS[names]


class Machine:
    """The last role seen is the state; a role that may not follow is reported and taken."""

    def __init__(self, template: Template) -> None:
        self.after, self.state = template.after, ""

    def take(self, role: str) -> bool:
        allowed = role in self.after.get(self.state, frozenset())
        self.state = role
        return allowed


CHUNKS = (
    "conv_id long, position long, role string, allowed boolean, chunk string,"
    " segments array<struct<text:string,loss:boolean>>"
)


def format_turns(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One formatted chunk per row of ``turns`` (conv_id, turn, role, text).

    Within a partition conversations follow one another and their chunks are in
    order, so the formatted text of a conversation is its chunks joined.
    """
    template = template or Template()
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine, position = object(), None, 0
        segment = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids, roles, texts = (batch.column(k).to_pylist() for k in (0, 2, 3))
                out = []
                for conv, role, text in zip(ids, roles, texts, strict=True):
                    if conv != now:
                        now, machine, position = conv, Machine(template), 0
                    parts = template.segments(role, text)
                    out.append((
                        position, machine.take(role), "".join(t for t, _ in parts),
                        [{"text": t, "loss": flag} for t, flag in parts],
                    ))
                    position += 1
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(cols[0], pa.int64()), batch.column(2), pa.array(cols[1], pa.bool_()),
                        pa.array(cols[2], pa.string()), pa.array(cols[3], segment),
                    ],
                    ["conv_id", "position", "role", "allowed", "chunk", "segments"],
                )

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").transform(arrow_map, run, CHUNKS)


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
    " formatted_chars long, n_refused long"
)


def read_back(chunks: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, from its formatted chunks: turns and loss text as digests and lengths."""
    from hashlib import sha256

    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            ids, allowed, texts, parts = (batch.column(k).to_pylist() for k in (0, 3, 4, 5))
            for conv, ok, chunk, segments in zip(ids, allowed, texts, parts, strict=True):
                if now is None or conv != now[0]:
                    if now is not None:
                        out.append(now)
                    now = [conv, 0, sha256(), 0, sha256(), 0, 0]
                for role, text in template.read(chunk):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for s in segments:
                    if s["loss"]:
                        text = template.show(s["text"])
                        now[3] += len(text)
                        now[4].update(text.encode())
                now[5] += len(chunk)
                now[6] += not ok
                if len(out) >= 4096:
                    yield rows(out)
                    out = []
        yield rows(out + ([now] if now is not None else []))

    def rows(found) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        plain = [[r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5], r[6]] for r in found]
        names = [f.split()[0] for f in DIGESTS.split(", ")]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in plain], kind) for k, kind in enumerate(kinds)], names
        )

    return chunks.transform(arrow_map, run, DIGESTS)
