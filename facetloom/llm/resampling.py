"""Importance resampling of documents towards a target distribution.

Word runs are hashed into buckets; a bucket's gain is the log ratio of its smoothed
shares in the target and in the documents, an array small enough for every task. A
document's weight is the mean gain of its features, read off that array; a Gumbel
number of its id on top makes the highest scores a weighted draw without replacement.

The k highest are found without sorting all rows: a few pivot keys, random rows of the
interval that still holds the k-th key, divide it; exact counts below, at and between
the pivots say where the k-th is, until a pivot is the k-th. Keys are composite (score,
id, the other results, the row's number), so no two are equal. Only drawn rows are
sorted and ranked.

A null text has no words, so no features and weight 0. A null id is drawn like an id
written as the empty string and comes after all others on ties. Repeated rows are rows
of their own; equal ones are told apart by their place in the stored table. No documents,
or too few for one draw, give no ranks; an empty target leaves smoothing alone to decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import arrow_map, store

BUCKETS = 10_000
PIVOTS = 32
TEXTS_AT_ONCE = 64

_KEPT = "0123456789abcdefghijklmnopqrstuvwxyz".encode() + bytes(range(128, 256))
#: Bytes of words as they are, capitals small, all others a space.
WORDS = bytes(b if b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_KEY = ("lost", "no_id", "id", "less_features", "less_weight", "row")


def features(text: bytes, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each run of 1 to ``longest`` words."""
    words = text.translate(WORDS).split()
    sums = list(map(crc32, words))
    found = sums[:]
    for k in range(1, longest):
        # A run's checksum goes on from that of the run without its last word.
        sums = list(map(crc32, words[k:], map(crc32, repeat(b" "), sums)))
        found += sums
    return len(words), np.array(found, np.uint32) % buckets


def each_text(column: pa.Array) -> Iterator[bytes]:
    for at in range(0, len(column), TEXTS_AT_ONCE):
        for text in column.slice(at, TEXTS_AT_ONCE).cast(pa.binary()).to_pylist():
            yield text or b""


def bucket_counts(rows: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts of ``rows`` (text) by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in each_text(batch.column(0)):
                total += np.bincount(features(text, longest, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    texts = rows.select(F.col("text").cast("string"))
    counted = texts.transform(arrow_map, count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():  # a row per bucket at most
        found[bucket] = n
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share over the source's) per bucket."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array(
        [math.floor(1000 * math.log(((t + 1) * (s_all + n)) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def weighted(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) per row of ``docs`` (doc_id, text)."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in each_text(batch.column(1)):
                n, found = features(text, longest, buckets)
                out.append((n, len(found), int(gain[found].sum()) // len(found) if len(found) else 0))
            columns = np.array(out, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, columns)], ["doc_id", "n_words", "n_features", "weight"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.transform(arrow_map, weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u in (0, 1) from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _struct(values) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(_KEY, values)])


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS) -> tuple[int, ...]:
    """The ``k``-th smallest (from 1) of the distinct rows ``keys`` (columns ``_KEY``), by quickselect."""
    key = F.struct(*_KEY)
    low = high = None
    turn = 0
    while True:
        inside = keys
        if low is not None:
            # The first column alone lets the scan skip row groups.
            inside = inside.where((F.col(_KEY[0]) >= low[0]) & (key > _struct(low)))
        if high is not None:
            inside = inside.where((F.col(_KEY[0]) <= high[0]) & (key < _struct(high)))
        drawn = inside.orderBy(F.xxhash64(F.lit(turn), *_KEY), *_KEY).limit(pivots).collect()
        chosen = sorted(tuple(r[c] for c in _KEY) for r in drawn)
        asked = F.array(*[_struct(p) for p in chosen])
        # Slot 2i+1 is pivot i itself, slot 2i what lies between pivots i-1 and i.
        slot = 2 * F.size(F.filter(asked, lambda p: p < key)) + F.array_contains(asked, key).cast("int")
        counts = dict(tuple(r) for r in inside.groupBy(slot.alias("slot")).count().collect())
        for at in range(2 * len(chosen) + 1):
            n = counts.get(at, 0)
            if k <= n:
                break
            k -= n
        if at % 2:
            return chosen[at // 2]
        low = chosen[at // 2 - 1] if at else low
        high = chosen[at // 2] if at // 2 < len(chosen) else high
        turn += 1


def in_order(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` sorted and numbered from 1: range partitions, then offsets of their sizes."""
    placed = store(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    starts, before = [], 0
    # One row per range partition, however many rows are sorted.
    for number, n in sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect()):
        starts.append((number, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "part long, before long")
    return placed.join(F.broadcast(offsets), part == F.col("part")).withColumn(name, F.col("before") + inside + 1).drop("_at", "part", "before")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, longest: int = 2,
    buckets: int = BUCKETS, seed: int = 7,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row of ``docs`` (doc_id, text).

    ``percent`` of the documents with ``min_words`` or more are drawn towards
    ``target`` (text); ``rank`` counts the drawn from 1, best first, and is null for the rest.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = weighted(docs, gain, longest).select(
        "doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"),
        F.monotonically_increasing_id().alias("row"),
    )
    scored = store(scored, "scored")
    keyed = scored.select(
        "*", (-F.col("score")).alias("lost"), F.col("doc_id").isNull().cast("long").alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).alias("id"), (-F.col("n_features")).alias("less_features"), (-F.col("weight")).alias("less_weight"),
    )
    fit = F.col("n_words") >= min_words
    k = percent * scored.where(fit).count() // 100
    results = ["doc_id", "n_features", "weight", "score"]
    nobody = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*results, nobody)
    drawn = fit & (F.struct(*_KEY) <= _struct(kth_key(keyed.where(fit).select(*_KEY), k)))
    ranked = in_order(keyed.where(drawn), list(_KEY), "rank").select(*results, "rank")
    return ranked.unionByName(keyed.where(~drawn).select(*results, nobody))
