"""SimHash near duplicates by the generalised pigeonhole principle.

Every document gets a 64-bit fingerprint of its word shingles. Two fingerprints
within ``radius`` bits link. The 64 bits are grouped into parts so that bits that
go together share a part; a fingerprint then looks for partners part by part,
within a threshold of its own for each part. Thresholds that add up to
``radius - parts + 1`` miss no partner, and dynamic programming picks, for each
fingerprint, those with the fewest expected candidates. Candidates are verified
on all 64 bits.

Equal fingerprints are one node, so copies cost nothing. A part value that many
fingerprints share is not turned into pairs: all fingerprints that touch such a
value meet instead at every value one bit away from them, where two of them are
within two bits of each other exactly if they meet. That is 65 rows for each,
however large the crowd, and loses no link.

Whole texts count. A null text has no words and the fingerprint zero, as has a
text without words; it links like any other. Fewer words than a shingle make one
shingle. Repeated ids and rows are nodes by their fingerprint. A null id never
names a group unless the group has no other id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.llm.common import arrow_map, store, text_key

BITS = 64
SEED = 42
PARTS = 3
CHUNK = 11  # bits of a histogram; PARTS * 2 histograms of 2^11 counts describe the corpus
CROWD = 48  # part values with more fingerprints are handled without pairs
PROBE_COST = 2.0  # of looking up one value, in candidates verified


def fingerprint(text: str | None, shingle: int) -> int:
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return voted(np.frombuffer(b"".join([xxh64_digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8))


def voted(digests: np.ndarray) -> int:
    """Signed fingerprint: bits that are set in over half of the rows of eight bytes."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(digests), 1 << 14):
        count += np.unpackbits(digests[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(digests)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, text_key, fp) per row of ``docs`` (doc_id, text), stored."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                out += [fingerprint(t, shingle) for t in batch.column(2).slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["doc_id", "text_key", "fp"]
            )

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))
    return store(rows.transform(arrow_map, encode, "doc_id long, text_key long, fp long"), "fingerprints")


def correlated_parts(fps: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """Bits in ``parts`` groups of equal size, each bit beside those it goes with."""

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        for frame in frames:
            for at in range(0, len(frame), 1 << 14):
                x = bits_of(frame.fp.to_numpy()[at : at + (1 << 14)]).astype(np.float32)
                total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(BITS * BITS), "n": total.ravel()})

    cells = fps.select("fp").mapInPandas(products, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    both = np.zeros(BITS * BITS)
    for cell, n in cells.collect():  # 64 x 64 sums
        both[cell] = n
    both = both.reshape(BITS, BITS)
    ones, n = np.diag(both), max(1.0, fps.count())
    spread = np.sqrt(np.maximum(ones / n * (1 - ones / n), 1e-12))
    tied = np.abs(both / n - np.outer(ones, ones) / n**2) / np.outer(spread, spread)
    np.fill_diagonal(tied, -1)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        rest = sorted(left)
        seed = max(rest, key=lambda b: (tied[b, rest].max(), -b))
        group = [seed]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(max(rest, key=lambda b: (tied[b, group].sum(), -b)))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def bits_of(values: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, the highest first."""
    return np.unpackbits(values.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def gathered(bits: np.ndarray, columns: list[int]) -> np.ndarray:
    weights = 1 << np.arange(len(columns) - 1, -1, -1, dtype=np.int64)
    return bits[:, columns].astype(np.int64) @ weights


class Allocation:
    """Expected candidates per part and threshold, and the cheapest thresholds.

    Each part is described by histograms of its chunks, taken as independent:
    ``near[p][c][d][v]`` is the share of fingerprints whose chunk is ``d`` bits
    from ``v``.
    """

    def __init__(self, groups: list[list[int]], histograms: dict[tuple[int, int], np.ndarray], n: int, radius: int) -> None:
        self.groups, self.radius, self.n = groups, radius, n
        self.near = []
        for p, group in enumerate(groups):
            chunks = []
            for c in range(len(chunked(group))):
                share = histograms[p, c] / max(1, n)
                width = int(np.log2(len(share)))
                by_distance = [share]
                values = np.arange(len(share))
                for d in range(1, radius + 1):
                    flips = [sum(1 << b for b in f) for f in combinations(range(width), d)]
                    by_distance.append(sum(share[values ^ f] for f in flips) if flips else np.zeros_like(share))
                chunks.append(by_distance)
            self.near.append(chunks)

    def thresholds(self, bits: np.ndarray) -> np.ndarray:
        """Per row and part the threshold; -1 leaves a part out."""
        from math import comb

        rows, options = len(bits), range(-1, self.radius + 1)
        cost = np.zeros((len(self.groups), len(options), rows))
        for p, group in enumerate(self.groups):
            exact = [np.ones(rows)] + [np.zeros(rows)] * self.radius  # share at each distance
            for c, columns in enumerate(chunked(group)):
                value = gathered(bits, columns)
                own = [table[value] for table in self.near[p][c]]
                exact = [sum(exact[a] * own[d - a] for a in range(d + 1)) for d in range(self.radius + 1)]
            within, probes = np.zeros(rows), 0
            for t in range(self.radius + 1):
                within = within + exact[t]
                probes += comb(len(group), t)
                cost[p, t + 1] = probes * PROBE_COST + within * self.n
        # best[s]: cheapest way for the parts so far to use thresholds that add up to s.
        total = self.radius - len(self.groups) + 1
        best = {0: (np.zeros(rows), np.zeros((0, rows), np.int64))}
        for p in range(len(self.groups)):
            grown: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for s, (spent, chosen) in best.items():
                for k, t in enumerate(options):
                    now, with_t = spent + cost[p, k], np.vstack([chosen, np.full((1, rows), t)])
                    if s + t in grown:
                        old, kept = grown[s + t]
                        better = now < old
                        grown[s + t] = np.where(better, now, old), np.where(better, with_t, kept)
                    else:
                        grown[s + t] = now, with_t
            best = grown
        return best[total][1].T


def chunked(group: list[int]) -> list[list[int]]:
    return [group[k : k + CHUNK] for k in range(0, len(group), CHUNK)]


def corpus_allocation(fps: DataFrame, radius: int, parts: int = PARTS) -> Allocation:
    groups = correlated_parts(fps, parts)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {(p, c): np.zeros(1 << len(columns), np.int64) for p, g in enumerate(groups) for c, columns in enumerate(chunked(g))}
        for frame in frames:
            bits = bits_of(frame.fp.to_numpy())
            for p, g in enumerate(groups):
                for c, columns in enumerate(chunked(g)):
                    total[p, c] += np.bincount(gathered(bits, columns), minlength=1 << len(columns))
        for (p, c), found in total.items():
            at = np.flatnonzero(found)
            yield pd.DataFrame({"p": p, "c": c, "v": at, "n": found[at]})

    histograms = {(p, c): np.zeros(1 << len(columns)) for p, g in enumerate(groups) for c, columns in enumerate(chunked(g))}
    rows = fps.select("fp").mapInPandas(count, "p int, c int, v long, n long").groupBy("p", "c", "v").agg(F.sum("n"))
    for p, c, v, n in rows.collect():  # at most parts * 2 * 2^11 counts
        histograms[p, c][v] = n
    return Allocation(groups, histograms, int(histograms[0, 0].sum()), radius)


def part_values(fps: DataFrame, plan: Allocation) -> DataFrame:
    """(fp, key, probe): the values under which a fingerprint stands and those it looks up."""

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 1 << 13):
                fp = whole.fp.to_numpy()[at : at + (1 << 13)]
                bits = bits_of(fp)
                chosen = plan.thresholds(bits)
                for p, group in enumerate(plan.groups):
                    value = gathered(bits, group) + (p << 32)
                    yield pd.DataFrame({"fp": fp, "key": value, "probe": False})
                    for t in range(plan.radius + 1):
                        asks = chosen[:, p] >= t
                        for flips in combinations(range(len(group)), t):
                            flip = sum(1 << b for b in flips)
                            if asks.any():
                                yield pd.DataFrame({"fp": fp[asks], "key": value[asks] ^ flip, "probe": True})

    return fps.select("fp").mapInPandas(expand, "fp long, key long, probe boolean")


def links(fps: DataFrame, radius: int = 2, parts: int = PARTS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; reaching is the same as over all links."""
    if radius != 2:
        raise ValueError("crowded values are resolved by one-bit neighbours, which is radius 2")
    values = store(part_values(fps, corpus_allocation(fps, radius, parts)), "part-values")
    stands = values.where("not probe").select("key", "fp")
    size = store(stands.groupBy("key").agg(F.count("*").alias("size")), "part-sizes")
    crowded = store(size.where(F.col("size") > CROWD).select("key"), "crowded-values")
    asked = values.where("probe").select("key", F.col("fp").alias("other"))
    close = (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius) & (F.col("fp") > F.col("other"))
    few = stands.join(size.where(F.col("size") <= CROWD).select("key"), "key")
    pairs = asked.join(few, "key").where(close).select(F.col("fp").alias("a"), F.col("other").alias("b"))

    crowd = values.join(crowded, "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(BITS)])
    beside = crowd.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("at"))
    first = beside.groupBy("at").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("at", "b")
    met = beside.join(first, "at").where("fp > b").select(F.col("fp").alias("a"), "b")
    return pairs.union(met).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge: the smallest node it can reach.

    Large and small stars in turn: each round hangs the neighbours of a node
    under the smallest of them, until nothing moves. Each round is stored.
    """
    spark: SparkSession = edges.sparkSession
    now, sign = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"), None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = store(large.distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).where("a <> b")
        now = store(small.distinct(), "small-star")
        n, h = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, h) == sign:
            break
        sign = n, h
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 2) -> DataFrame:
    """(doc_id, text_key, fp, component_id, keeper_id, keeper_key, n_links) per row of ``docs``.

    ``component_id`` is the smallest id in the group, the keeper its first row by
    (id, text key), a null id last.
    """
    rows = fingerprints(docs, shingle)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    nodes = store(rows.groupBy("fp").agg(F.min(order).alias("first")), "fingerprint-nodes")
    found = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )
    rooted = store(rooted, "fingerprint-roots")
    groups = rooted.groupBy("root").agg(F.min("first").alias("first"))
    # A plain table, so that a fingerprint with very many copies can be split.
    named = store(rooted.select("fp", "root").join(groups, "root").select("fp", "first"), "fingerprint-groups")
    return rows.join(named, "fp").select(
        "doc_id", "text_key", "fp", F.col("first.doc_id").alias("component_id"),
        F.col("first.doc_id").alias("keeper_id"), F.col("first.text_key").alias("keeper_key"),
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each group: the first by (id, text key)."""
    return keep_first(docs, near_duplicates(docs, shingle, radius))


def keep_first(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``grouped`` names as keepers (keeper_id, keeper_key)."""
    keepers = grouped.select(
        F.col("keeper_id").alias("_keeper"), F.col("keeper_key").alias("_key")
    ).distinct()
    mark = "_" * (max([len(c) for c in docs.columns]) + 1)
    keepers = keepers.toDF(mark + "id", mark + "key")
    keyed = docs.withColumn(mark + "own", text_key(F.col("text").cast("string")))
    kept = keyed.join(
        keepers, keyed["doc_id"].cast("long").eqNullSafe(keepers[mark + "id"]) & (keyed[mark + "own"] == keepers[mark + "key"]), "left_semi"
    )
    # Rows that repeat id and text are one document.
    return kept.dropDuplicates(["doc_id", mark + "own"]).select(*docs.columns)
