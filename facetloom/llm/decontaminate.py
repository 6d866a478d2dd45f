"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised words of all items form one automaton; documents stream through
it word by word while it tracks the longest run of words ending here that also
stands in some item. Where that run is as long as a window, the words of the
window are hit and the state names the items.

Items are taken in blocks of bounded size, each with an automaton of its own; a
registered benchmark fits in one. Texts are processed whole. Null and empty
texts have no words; items without words match nothing; items without an id hit
but aren't named; repeated items are named once; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import arrow_map, free_name, row_type

WINDOW = 13
# Bytes of item text in one automaton; a larger benchmark takes more passes.
BLOCK_BYTES = 4 << 20

_UPPER = range(0x41, 0x5B)
_APART = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
FOLD = bytes(0x20 if b in _APART else b + 32 if b in _UPPER else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """ASCII-folded words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a whole text."""
    return [w for w in (text or "").encode().translate(FOLD).split(b" ") if w]


class ItemAutomaton:
    """Suffix automaton over the words of many items.

    ``hits`` maps a state to the windows its longest string ends with: (length,
    items). Only states that can end a window are in it.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        items = [(i, w) for i, w in items if w]
        self.shortest = min([min(len(w), window) for _, w in items], default=0)
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocabulary[w] for w in ws]) for i, ws in items]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        ends: dict[int, dict[int, set[int]]] = {}
        for item, ws in coded:
            size = min(len(ws), window)
            state = matched = 0
            for w in ws:
                state, matched = self.step(state, matched, w)
                if matched > size:
                    state, matched = self._shorten(state, size)
                if matched == size:
                    ends.setdefault(state, {}).setdefault(size, set()).add(item)
        # A state also ends every window that a state on its suffix path ends.
        self.hits: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            above = self.hits[self.link[state]] if state else ()
            own = tuple((n, frozenset(s)) for n, s in sorted(ends.get(state, {}).items()))
            self.hits[state] = above + own

    def _shorten(self, state: int, size: int) -> tuple[int, int]:
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state, size

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, w)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        nxt, link, length = self.next, self.link, self.length
        while state and w not in nxt[state]:
            state = link[state]
            matched = length[state]
        to = nxt[state].get(w)
        return (to, matched + 1) if to is not None else (0, 0)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs [start, end) of hit words and the items that hit them."""
        runs: list[tuple[int, int]] = []
        items: set[int] = set()
        if not self.shortest or len(words) < self.shortest:
            return runs, items
        get, hits = self.vocabulary.get, self.hits
        state = matched = 0
        for at, w in enumerate(map(get, words)):
            if w is None:
                state = matched = 0
                continue
            state, matched = self.step(state, matched, w)
            if matched < self.shortest or not hits[state]:
                continue
            longest = 0
            for size, who in hits[state]:
                if size <= matched:
                    longest = size
                    items |= who
            if longest:
                start = at + 1 - longest
                while runs and runs[-1][1] >= start:
                    start = min(start, runs.pop()[0])
                runs.append((start, at + 1))
        return runs, items


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[list[tuple[int, list[bytes]]]]:
    """Items (item_id, text) in blocks of about ``block_bytes`` of text.

    An item is never cut, so one longer than a block makes a block of its own.
    """
    texts = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    found = []
    for k in range(count):
        rows = texts.where(block == k).collect() if count > 1 else texts.collect()
        found.append([(i, words_of(t)) for i, t in rows])
    return found


HITS = "struct<n_words:bigint,runs:array<struct<start:bigint,end:bigint>>,items:array<bigint>>"


def find_hits(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, into: str = "hits"
) -> DataFrame:
    """``docs`` (any columns with ``text``) and their hits: n_words, runs of hit words, item ids.

    The three are in a struct ``into``, replacing a column of that name.
    """
    blocks = item_blocks(items, block_bytes)
    spark = docs.sparkSession
    rows = docs.drop(into)
    shared = [spark.sparkContext.broadcast(b) for b in blocks]
    names = rows.columns
    at = names.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [ItemAutomaton(b.value, window) for b in shared]
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            n_words, runs, named = [], [], []
            for text in batch.column(at).to_pylist():
                words = words_of(text)
                spans, who = automata[0].scan(words)
                for other in automata[1:]:
                    more, also = other.scan(words)
                    spans, who = merged(spans + more), who | also
                n_words.append(len(words))
                runs.append([{"start": s, "end": e} for s, e in spans])
                named.append(sorted(who - {None}))
            hits = pa.StructArray.from_arrays(
                [pa.array(n_words, pa.int64()), pa.array(runs, run_type), pa.array(named, pa.list_(pa.int64()))],
                ["n_words", "runs", "items"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, hits], [*names, into])

    return rows.transform(arrow_map, scan, f"{row_type(rows)}, `{into}` {HITS}")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, touching ones joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, max_share: float = 0.05
) -> DataFrame:
    """``docs`` without test items.

    A document whose hit words reach ``max_share`` of its words goes. In the
    others every span of hit words is cut from the text, from the first
    character of its first word to the last of its last; ``n_chars`` follows.
    """
    into = free_name(docs.columns, "hits")
    found = find_hits(docs, items, window, into=into)
    hit = hit_words(into)
    kept = found.where(~((hit > 0) & (hit >= F.lit(max_share) * F.col(f"{into}.n_words"))))
    names = kept.columns
    at, runs_at = names.index("text"), names.index(into)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(runs_at).field("runs").to_pylist()
            texts = batch.column(at)
            if any(runs):
                texts = pa.array(
                    [without_words(t, r) if r else t for t, r in zip(texts.to_pylist(), runs, strict=True)], texts.type
                )
            arrays = [texts if k == at else c for k, c in enumerate(batch.columns) if k != runs_at]
            yield pa.RecordBatch.from_arrays(arrays, [c for c in names if c != into])

    clean = kept.transform(arrow_map, cut, row_type(kept, without=into))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def hit_words(into: str = "hits") -> Column:
    """Number of hit words of a row of ``find_hits``."""
    return F.aggregate(f"{into}.runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])


def without_words(text: str, runs: list[dict]) -> str:
    """The text without the words in ``runs``, and what stands between them."""
    data = text.encode()
    folded = data.translate(FOLD)
    # Byte places where words begin and end.
    inside = np.frombuffer(folded, np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    out, last = [], 0
    for r in runs:
        out.append(data[last : begins[r["start"]]])
        last = ends[r["end"] - 1]
    out.append(data[last:])
    return b"".join(out).decode()
