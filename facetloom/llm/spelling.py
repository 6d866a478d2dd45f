"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

An edit moves a word's vector of letter counts by two at most: a replaced letter lowers
one count by one and raises another, an inserted one raises one count. So the words near
a word lie in a small box around its vector. Words are dealt by length; for each length a
tree over a sample of its words gives the cells, and a word is sent to its own cell and,
as a question, to every cell of its own and the next length that its box touches. Within a
cell a tree with tight boxes over all words there prunes again, letter counts are compared,
and letter order decides what is left. The sample decides only how even cells are.

Words of ``LAST_LENGTH`` letters or more share one length class, so there are few trees.

A null text has no words, a null id counts as an empty one. Repeated rows count each time.
Ties for a form go to the smallest word. Texts without words and no documents give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import arrow_map, store

LETTERS = 26 + 64  # a to z, then the code points C0 to FF
SHORTEST = 7
LAST_LENGTH = 64
CELL = 32_768  # words wanted in a cell
SAMPLE = 4_096  # words of each length that a tree is built from
BUCKET = 32
COUNTED = 200_000  # different words a task holds before it hands counts on
ASKED = 1_024  # questions compared with a bucket at a time

#: How far a question's counts may exceed a word's, and fall short of them.
SAME, LONGER = (1, 1), (0, 1)


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts, a row per word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.int64)
    letters = np.where(codes >= 0xC0, codes - 0xC0 + 26, codes - 97)
    rows = np.repeat(np.arange(len(words)), sizes)
    counts = np.bincount(rows * LETTERS + letters, minlength=len(words) * LETTERS)
    return counts.reshape(-1, LETTERS).astype(np.int32 if sizes.max(initial=0) > 100 else np.int8)


class LetterTree:
    """A k-d tree over letter counts; its leaves are cells or buckets of points."""

    def __init__(self, points: np.ndarray, bucket: int, tight: bool) -> None:
        self.low, self.high, self.children, self.leaves = [], [], [], []
        self.leaf_of: dict[int, int] = {}
        wide = np.full(LETTERS, np.iinfo(points.dtype).max, points.dtype)
        none = np.zeros(LETTERS, points.dtype)
        work = [(np.arange(len(points)), none, wide, -1)]
        while work:
            own, low, high, parent = work.pop()
            values = points[own]
            if tight and len(own):
                low, high = values.min(0), values.max(0)
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            spread = values.var(axis=0, dtype=np.float32) if len(own) > bucket else none
            letter = int(spread.argmax())
            if not spread[letter]:
                self.leaf_of[node] = len(self.leaves)
                self.leaves.append(own)
                continue
            edge = int(np.median(values[:, letter]))
            if edge == values[:, letter].max():
                edge -= 1
            below = values[:, letter] <= edge
            left, right = high.copy(), low.copy()
            left[letter], right[letter] = edge, edge + 1
            work += [(own[below], low, left, node), (own[~below], right, high, node)]

    def touched(self, asked: np.ndarray, over: int, under: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``asked`` whose box touches it)."""
        work = [(0, np.arange(len(asked)))]
        while work:
            node, rows = work.pop()
            q = asked[rows]
            # Counts of one word add up to no more than the wider type holds.
            kind = np.promote_types(q.dtype, self.low[node].dtype)
            above = (np.maximum(q, self.high[node]) - self.high[node]).sum(1, dtype=kind) <= over
            below = (self.low[node] - np.minimum(q, self.low[node])).sum(1, dtype=kind) <= under
            rows = rows[above & below]
            if not len(rows):
                continue
            if node in self.leaf_of:
                yield self.leaf_of[node], rows
            work += [(child, rows) for child in self.children[node]]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter parts two words."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) > len(a) + 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def letter_rows(words: list[str], size: int) -> np.ndarray:
    """Letters of words of one length, a row per word."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), size)


def edited(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows where words of ``a`` become those of ``b``, as long or one letter longer, by one edit."""
    size = a.shape[1]
    head = a == b[:, :size]
    if b.shape[1] == size:
        return head.sum(1) == size - 1
    # Equal up to some place, and from there on with one letter left out.
    tail = (a == b[:, 1:])[:, ::-1]
    lead = np.where(head.all(1), size, head.argmin(1))
    trail = np.where(tail.all(1), size, tail.argmin(1))
    return lead + trail >= size


def near_in_cell(points: list[str], asked: list[str], reach: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asked, point) places of words one edit apart, some at a time."""
    if not points or not asked:
        return
    own, other = vectors(points), vectors(asked)
    kind = np.promote_types(own.dtype, other.dtype)
    used = own.any(0)
    # Letters that no point has count against a question at once.
    fit = np.flatnonzero(other[:, ~used].sum(1) <= reach[0])
    own, other = own[:, used].astype(kind), other[:, used].astype(kind)
    lengths = {len(w) for w in points}, {len(asked[k]) for k in fit}
    even = all(len(x) == 1 for x in lengths) and max(*lengths[0], *lengths[1]) < LAST_LENGTH
    if even:
        rows_own = letter_rows(points, *lengths[0])
        rows_asked = letter_rows([asked[k] for k in fit], *lengths[1])
    tree = LetterTree(own, BUCKET, tight=True)
    for leaf, rows in tree.touched(other[fit], *reach):
        # Words with equal counts cannot be parted by the tree, so a leaf may be long.
        for begin in range(0, len(tree.leaves[leaf]), ASKED):
            places = tree.leaves[leaf][begin : begin + ASKED]
            step = max(1, ASKED * BUCKET // len(places))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                apart = other[fit[part]][:, None] - own[places][None]
                # Of words of one length each, what one count has less another has more.
                close = np.maximum(apart, 0).sum(2, dtype=kind) <= reach[0]
                if not even:
                    close &= np.maximum(-apart, 0).sum(2, dtype=kind) <= reach[1]
                i, j = np.nonzero(close)
                i, j = part[i], places[j]
                if even:
                    holds = edited(rows_asked[i], rows_own[j])
                else:
                    holds = np.array([one_edit(asked[fit[x]], points[y]) for x, y in zip(i, j)], bool)
                if holds.any():
                    yield fit[i[holds]], j[holds]


def word_counts(docs: DataFrame, least: int = 2, shortest: int = SHORTEST, noise: int = 31) -> DataFrame:
    """(word, n), stored, of ``docs`` (doc_id, text): letter runs, ASCII capitals folded.

    A run whose checksum with its document's id is divisible by ``noise`` loses one letter.
    """
    # A run that loses a letter still has to have ``shortest`` ones; shorter runs never count.
    runs = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def handed_on():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for k in range(batch.num_rows):
                text, doc_id = batch.column(1)[k].as_py(), batch.column(0)[k].as_py()
                if not text:
                    continue
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run in runs(text.encode().lower().decode()):
                    h = crc32(run.encode(), start)
                    if h % noise == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < shortest:
                            continue
                    found[run] += 1
                if len(found) > COUNTED:
                    yield handed_on()
                    found.clear()
        if found:
            yield handed_on()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = rows.transform(arrow_map, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return store(counted.where(F.col("n") >= least), "words")


def sampled_trees(words: DataFrame) -> dict[int, LetterTree]:
    """A tree per length class, its leaves about ``CELL`` words each.

    About ``SAMPLE`` words of each of the few classes come to the driver, chosen by hash.
    """
    size = F.least(F.length("word"), F.lit(LAST_LENGTH))
    totals = dict(tuple(r) for r in words.groupBy(size.alias("size")).count().collect())
    if not totals:
        return {}
    # Of 2^30 equal shares of the hashes, as many as hold ``SAMPLE`` words of a length on average.
    share = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1 << 30, (SAMPLE << 30) // n))])
    drawn: dict[int, list[str]] = {}
    for row in words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share[size]).select("word").orderBy("word").collect():
        drawn.setdefault(min(len(row["word"]), LAST_LENGTH), []).append(row["word"])
    return {
        size: LetterTree(vectors(own), max(8, len(own) * CELL // totals[size]), tight=False) for size, own in drawn.items()
    }


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best) per word of ``words`` (word, n) with near words; best is (less, word)."""
    trees = words.sparkSession.sparkContext.broadcast(sampled_trees(words))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word as a point of its cell and as a question to all cells its boxes touch."""
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            counts = batch.column(1).to_numpy()
            sizes = np.minimum([len(w) for w in names], LAST_LENGTH)
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                asked = vectors(names[own].tolist())
                for other, role, reach in ((size, 0, (0, 0)), (size, 1, SAME), (size + 1, 2, LONGER)):
                    if other not in trees.value:
                        continue
                    for leaf, rows in trees.value[other].touched(asked, *reach):
                        at = own[rows]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(at), other << 32 | leaf, np.int64)), pa.array(np.full(len(at), role, np.int8)),
                                pa.array(names[at].tolist(), pa.string()), pa.array(counts[at]),
                            ],
                            ["cell", "role", "word", "n"],
                        )

    def search(table: pd.DataFrame) -> pd.DataFrame:
        points = table[table["role"] == 0]
        names, counts = points["word"].to_numpy(object), points["n"].to_numpy()
        found = []
        for role, reach in ((1, SAME), (2, LONGER)):
            asking = table[table["role"] == role]
            asked, numbers = asking["word"].to_numpy(object), asking["n"].to_numpy()
            for i, j in near_in_cell(names.tolist(), asked.tolist(), reach):
                found.append((asked[i], names[j], counts[j]))
                if role == 2:  # a question to the next length is asked one way only
                    found.append((names[j], asked[i], numbers[i]))
        if not found:
            return pd.DataFrame({"word": [], "n_near": [], "less": [], "near": []}, dtype=object)
        words, near, n = map(np.concatenate, zip(*found))
        pairs = pd.DataFrame({"word": words, "near": near, "less": -n}).sort_values(["less", "near"])
        of = pairs.groupby("word", sort=False)
        best = of.first().reset_index()
        best = best.assign(n_near=of.size().to_numpy())[["word", "n_near", "less", "near"]]
        return best.astype({"word": object, "near": object})

    placed = store(words.transform(arrow_map, place, "cell long, role tinyint, word string, n long"), "cells")
    found = placed.groupBy("cell").applyInPandas(search, "word string, n_near long, less long, near string")
    best = F.min(F.struct("less", F.col("near").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the end of each chain of forms.

    Each round doubles the steps taken; counts grow along a chain, so it ends.
    """
    reached = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = reached.join(onward, "root", "left")
        if step.where("next IS NOT NULL").isEmpty():
            return reached
        reached = store(step.select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) per counted word of ``docs`` (doc_id, text).

    ``form`` is the most frequent near word if it is ``ratio`` times as frequent.
    """
    words = word_counts(docs)
    joined = words.join(near_words(words), "word", "left")
    most = -F.col("best.less")
    is_form = most >= ratio * F.col("n")
    named = store(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, most).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(named.where("form IS NOT NULL").select("word", "form"))
    return named.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
