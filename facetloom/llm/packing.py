"""Packing: concatenate all documents and cut the stream into fixed windows.

Pass one turns each partition's texts into ids and counts them; prefix sums over
the partition totals give every document its place in one long stream. Pass two
cuts the stream at window edges without moving any ids: each document knows from
its place alone which windows it touches, and leaves one boundary record, a
piece, in each.

Nothing depends on the order or size of documents: a text longer than a window
is cut like any other, a null or empty text is its closing id alone, repeated
ids and rows are packed once each, no documents give no pieces. The rest of the
stream after the last full window is cut into powers of two, largest first, so
no sequence needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import arrow_map, store
from facetloom.llm.tokens import WordIds, vocabulary_path

END_ID = 1
TEXTS_AT_ONCE = 1024

TOKENS = "part int, before long, doc_id long, n long, ids binary"


def token_table(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pass one, stored: per document its ids, their number and those before it in its part."""
    path = path or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, before = WordIds(path, end_id), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                ids, n = words.encode(batch.column(1))
                ends = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), batch.column(0), pa.array(n), ids],
                    ["part", "before", "doc_id", "n", "ids"],
                )
                before = int(ends[-1]) if len(n) else before

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return store(rows.transform(arrow_map, encode, TOKENS), "tokens")


def tail_sizes(rest: int) -> list[int]:
    """Powers of two that add up to ``rest``, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, window: int = 2048, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of ``docs`` (doc_id, text).

    ``start`` counts the document's ids before the piece, ``offset`` the ids
    before it in its sequence, ``ids`` are unsigned 32-bit little-endian.
    """
    tokens = token_table(docs, path, end_id)
    # One number per partition of the input: it grows with the partitions, not with the rows.
    totals = sorted(tuple(r) for r in tokens.groupBy("part").agg(F.sum("n")).collect())
    bases, total = [], 0
    for part, n in totals:
        bases.append((part, total))
        total += n
    full = total // window
    edges = [full * window]
    for size in tail_sizes(total - edges[0]):
        edges.append(edges[-1] + size)

    spark = docs.sparkSession
    base = spark.createDataFrame(bases, "part int, base long")
    placed = tokens.join(F.broadcast(base), "part").withColumn("at", F.col("base") + F.col("before"))
    tail = F.array(*[F.lit(e).cast("long") for e in edges])

    def sequence_of(position):
        past = F.size(F.filter(tail, lambda e: e <= position)).cast("long")
        return F.when(position < full * window, F.floor(position / window)).otherwise(full + past - 1)

    def edge(sequence):
        inside = F.get(tail, (sequence - full).cast("int"))
        return F.when(sequence < full, sequence * window).otherwise(inside)

    first, last = sequence_of(F.col("at")), sequence_of(F.col("at") + F.col("n") - 1)

    def piece(sequence):
        begin = F.greatest(edge(sequence), F.col("at"))
        length = F.least(edge(sequence + 1), F.col("at") + F.col("n")) - begin
        start = begin - F.col("at")
        return F.struct(
            start.alias("start"), length.alias("length"), sequence.alias("sequence_id"),
            (begin - edge(sequence)).alias("offset"),
            F.col("ids").substr((start * 4 + 1).cast("int"), (length * 4).cast("int")).alias("ids"),
        )

    # Pieces are built inside the row, so a long document is not copied for each of them.
    return placed.select(
        "doc_id", F.col("n").alias("doc_tokens"),
        F.explode(F.transform(F.sequence(first, last), piece)).alias("p"),
    ).select("doc_id", "p.start", "p.length", "doc_tokens", "p.sequence_id", "p.offset", "p.ids")


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """Whole sequences (sequence_id, n_ids, ids), padded to ``window`` unless a power of two long.

    A sequence holds at most ``window`` pieces, so its list is bounded.
    """
    joined = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_ids"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"),
    )
    data = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (window - F.col("n_ids")).cast("int")))
    bare = F.bit_count(F.col("n_ids")) == 1
    return joined.select("sequence_id", "n_ids", F.when(bare, data).otherwise(F.concat(data, pad)).alias("ids"))
