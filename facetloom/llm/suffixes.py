"""Suffix-array dedup: remove every byte of a long string that occurs more than once.

A string of ``length`` bytes is removed wherever it starts if it also starts
anywhere else, in the same document or another. Suffixes that cannot repeat are
never sorted:

1. Every window of ``length`` bytes is handed to its anchor, the leftmost of its
   32-byte grams with the smallest hash. Equal windows have equal anchors, so
   windows under a gram that occurs once cannot repeat. Neighbouring windows
   with one anchor form a stretch; a stretch that occurs twice as a whole is
   repeated as a whole, and one copy of it stands for the others from here on.
2. Stretches that share their gram with different ones are fetched and dealt
   into shards by gram. Each shard gets a suffix array by Larsson-Sadakane
   refinement (only groups that are still tied are sorted again, by the rank
   twice as far on) and common prefixes by Kasai's recurrence, all stretches in
   step. A window repeats if it shares ``length`` bytes with a neighbour in the
   array, or belongs to a stretch with copies. Order and prefixes are followed
   no further than ``length`` bytes, and only where a window starts.
3. A gram with very many stretches is dealt over several shards. Each sorts one
   entry for every different window under it, finds common splitters in its run
   by binary search and sends a row for each piece between two; runs of a piece
   are merged two by two, each entry of one looked up in the other by binary
   search, and a window met in two shards repeats.

No step holds more than a shard or a slice of a document, nothing but counts
reaches the driver, and no window, gram or stretch is left out: two lists of
64-bit hashes, of gram and of stretch, identify a stretch, 128 bits a window.

Null texts are empty. Texts shorter than ``length`` are kept. Repeated rows are
copies like any other, so both lose their text; spans are found once for all rows
of one id and text. Documents are told apart by id and text; a null id is an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import arrow_map, free_name, row_type, store, text_key
from facetloom.llm.decontaminate import merged

LENGTH = 200
GRAM = 32
SLICE = 1 << 20  # bytes of a document worked on at once
SHARD = 3072  # stretches in a shard, on average
WIDE = 4096  # stretches of one gram in one shard
RUN_ROWS = 500_000  # entries merged at once, at most on average


def _numbers(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers and inverse powers of one polynomial hash modulo 2^64."""
    rng = np.random.default_rng(seed)
    table = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    base = int(rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
    inverse = pow(base, -1, 1 << 64)
    n = SLICE + 4096
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return table, np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hashes:
    """Hashes of any range of a byte array, by two polynomials."""

    _KEPT: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def __init__(self, data: np.ndarray) -> None:
        if not Hashes._KEPT:
            Hashes._KEPT = [_numbers(11), _numbers(23)]
        self.sums = []
        for table, up, _ in Hashes._KEPT:
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * up[: len(data)], out=total[1:])
            self.sums.append(total)

    @staticmethod
    def forget() -> None:
        """Free the tables: workers live on and serve later stages."""
        Hashes._KEPT = []

    def of(self, which: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = self.sums[which]
        return (total[end] - total[begin]) * Hashes._KEPT[which][2][begin]

    def rolling(self, which: int, size: int) -> np.ndarray:
        total = self.sums[which]
        n = len(total) - size
        return (total[size:] - total[:-size]) * Hashes._KEPT[which][2][:n]


def stretches(data: np.ndarray, length: int, gram: int):
    """(start, n, gram hash, stretch hash) of the stretches of one slice.

    Windows ``start`` to ``start + n - 1`` share an anchor.
    """
    width = length - gram + 1
    n_windows = len(data) - length + 1
    hashes = Hashes(data)
    grams = hashes.rolling(0, gram)
    rank = (grams ^ (grams >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    rank ^= rank >> np.uint64(29)
    low = np.uint64(2 * SLICE - 1)
    rank = (rank & ~low) | np.arange(len(rank), dtype=np.uint64)
    # Sliding minimum: of the rest of a block and the start of the next.
    blocks = -(-len(rank) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(rank)] = rank
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    rest = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(rest[:n_windows], ahead[width - 1 : width - 1 + n_windows])
    anchor = (least & low).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    end = np.append(begin[1:], n_windows)
    at = anchor[begin]
    whole = hashes.of(1, begin, end - 1 + length)
    # Where the anchor stands and how long the stretch is belong to its identity.
    whole = (whole ^ ((at - begin) * 1_000_003 + (end - begin)).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return begin, end - begin, grams[at].view(np.int64), whole.view(np.int64)


STRETCHES = "doc_id long, text_key long, gram long, whole long, start long, n int"


def stretch_table(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Stretches of all documents (doc_id, text_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in STRETCHES.split(", ")]
        types = [pa.int64()] * 5 + [pa.int32()]
        for batch in batches:
            held, size = [], 0
            for doc, key, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                for at in range(0, max(0, len(data) - length + 1), SLICE - length + 1):
                    part = data[at : at + SLICE]
                    if len(part) < length:
                        break
                    start, n, grams, whole = stretches(part, length, gram)
                    held.append((doc, key, grams, whole, start + at, n))
                    size += len(start)
                if size >= 50_000:
                    yield table(held, names, types)
                    held, size = [], 0
            if held:
                yield table(held, names, types)
        Hashes.forget()

    def table(held, names, types) -> pa.RecordBatch:
        counts = [len(h[2]) for h in held]
        which = np.repeat(np.arange(len(held)), counts)
        ids = pa.array([h[0] for h in held], pa.int64()).take(pa.array(which))
        keys = pa.array([h[1] for h in held], pa.int64()).take(pa.array(which))
        rest = [pa.array(np.concatenate([h[k] for h in held]).astype(t.to_pandas_dtype())) for k, t in zip(range(2, 6), types[2:], strict=True)]
        return pa.RecordBatch.from_arrays([ids, keys, *rest], names)

    return docs.transform(arrow_map, run, STRETCHES)


def suffix_array(text: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order and ranks of all suffixes of small non-negative integers (below 2^9).

    Suffixes that share ``depth`` places or more may stay tied: they have one rank.
    """
    n = len(text)
    packed = np.zeros(n + 7, np.int64)
    packed[:n] = text
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key << 9 | packed[k : k + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    sorted_key = key[order]
    fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    places = np.arange(n)
    first = np.maximum.accumulate(np.where(fresh, places, 0))
    rank[order] = first
    # Places in the array whose group is still tied.
    tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    step = 7
    while len(tied) and step < (n if depth is None else min(n, depth)):
        suffix = order[tied]
        group = rank[suffix]
        ahead = rank[np.minimum(suffix + step, n)] + 1
        by = np.lexsort((ahead, group)) if n > 2**31 else np.argsort(group * (n + 1) + ahead, kind="stable")
        suffix, group, ahead = suffix[by], group[by], ahead[by]
        order[tied] = suffix
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))
        rank[suffix] = tied[first]
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    return order, rank[:n]


def common_prefixes(
    text: np.ndarray, order: np.ndarray, rank: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, n_starts: np.ndarray, length: int
) -> np.ndarray:
    """Per suffix the bytes, up to ``length``, it shares with the one before it in ``order``, within its stretch.

    Only the first ``n_starts`` places of a stretch are asked. Kasai's recurrence:
    one place further on, at most one byte is lost. All stretches take their next
    place together. Suffixes of one rank share ``length`` bytes and stand in any
    order, so nothing follows for the place after them.
    """
    n = len(text)
    # Every place asked, the first of all stretches before the second of any.
    lane = np.repeat(np.arange(len(offsets)), n_starts)
    step = np.arange(len(lane)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
    by = np.argsort(step, kind="stable")
    lane, at = lane[by], (offsets[lane] + step)[by]
    edges = np.searchsorted(step[by], np.arange(int(n_starts.max(initial=0)) + 1))
    before_all, tied_all = np.full(n, -1, np.int32), np.zeros(n, bool)
    before_all[order[1:]] = order[:-1]
    tied_all[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    left = np.zeros(n, np.int32)  # bytes to the end of the stretch
    for_each = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left[np.repeat(offsets, sizes) + for_each] = np.repeat(sizes, sizes) - for_each
    before, tied = before_all[at], tied_all[at]
    most = np.where(before >= 0, np.minimum(np.minimum(left[before], left[at]), length), 0)
    words = np.zeros(n + 8, np.uint64)
    padded = np.concatenate([text.astype(np.uint64) & np.uint64(255), np.zeros(8, np.uint64)])
    for k in range(8):
        words[:n] |= padded[k : k + n] << np.uint64(8 * k)
    now = np.zeros(len(offsets), np.int64)
    found = np.zeros(len(at), np.int64)
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        known = np.maximum(now[lane[s:e]] - 1, 0)
        h = np.where(tied[s:e], most[s:e], np.minimum(known, most[s:e]))
        going = np.flatnonzero(h < most[s:e])
        while len(going):
            differ = words[at[s + going] + h[going]] ^ words[before[s + going] + h[going]]
            # Equal bytes at the low end of the words: those below the lowest bit that differs.
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1))).astype(np.int64) >> 3)
            h[going] = np.minimum(h[going] + same, most[s + going])
            going = going[(same == 8) & (h[going] < most[s + going])]
        now[lane[s:e]] = np.where(tied[s:e], 0, h)
        found[s:e] = h
    shared = np.zeros(n, np.int64)
    shared[at] = found
    return shared


def repeated_windows(frame: pd.DataFrame, length: int):
    """(stretch, start in it, repeated, alone) of every window of a shard's stretches.

    ``alone`` marks a window equal to no other of the shard; of several equal
    ones only the first in the array is not ``alone`` but still reported.
    """
    sizes = frame.data.map(len).to_numpy(np.int64)
    offsets = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int((sizes + 1).sum()), np.int16)
    flat = np.frombuffer(b"".join(frame.data), np.uint8).astype(np.int16) + 1
    inside = np.ones(len(text), bool)
    inside[offsets + sizes] = False
    text[inside] = flat
    n = frame.n.to_numpy(np.int64)
    order, rank = suffix_array(text, length)
    # Kasai compares bytes; a stretch's end bounds it, so the mark after it is never read.
    shared = common_prefixes(np.where(inside, text - 1, 0), order, rank, offsets, sizes, n, length)
    with_last = shared[order] >= length
    equal = with_last | np.append(with_last[1:], False)
    which = np.repeat(np.arange(len(frame)), n)
    start = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    place = np.empty(len(text), np.int64)
    place[order] = np.arange(len(text))
    spot = place[offsets[which] + start]
    return which, start, equal[spot], ~with_last[spot]


SPANS = "doc_id long, text_key long, begin long, end long"
FOUND = f"{SPANS}, piece long, run binary"
#: A window in a run. Flags: 1, known to repeat; 2, its document's id is null.
ENTRY = np.dtype([("key", "S16"), ("doc", "<i8"), ("text", "<i8"), ("begin", "<i8"), ("flags", "u1")])


def shard_spans(fetched: DataFrame, length: int, pieces: int) -> DataFrame:
    """Per shard the repeated spans, and sorted runs of windows of grams in several shards.

    A row is a span, or the windows whose digests lie in one of ``pieces`` equal
    ranges; of equal windows a run has one.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["gram", "whole"], ignore_index=True)
        which, start, equal, first = repeated_windows(frame, length)
        copies = frame.copies.to_numpy() > 1
        begin = frame.start.to_numpy()[which] + start
        open_ = ~copies[which]  # the others are covered by their copies
        final = equal & open_
        ids, keys = frame.doc_id.astype("Int64"), frame.text_key
        done = pd.DataFrame({"which": which[final], "begin": begin[final]})
        # Neighbouring windows make one span.
        fresh = (done.which != done.which.shift()) | (done.begin != done.begin.shift() + 1)
        done = done.groupby(fresh.cumsum(), sort=False).agg(which=("which", "first"), begin=("begin", "first"), last=("begin", "last"))
        out = pd.DataFrame({
            "doc_id": ids.take(done.which).to_numpy(), "text_key": keys.take(done.which).to_numpy(),
            "begin": done.begin.to_numpy(), "end": done["last"].to_numpy() + length,
        }).astype("Int64")
        out["piece"], out["run"] = pd.array([pd.NA] * len(out), "Int64"), None
        split = (frame.parts.to_numpy() > 1)[which] & first
        if split.any():
            w = which[split]
            sent = np.zeros(len(w), ENTRY)
            both = np.stack(digests(frame.data, frame.data.map(len).to_numpy(np.int64), w, start[split], length), axis=1)
            sent["key"] = np.ascontiguousarray(both.view(np.uint64).astype(">u8")).view("S16").ravel()
            sent["doc"], sent["text"], sent["begin"] = ids.fillna(0).to_numpy(np.int64)[w], keys.to_numpy()[w], begin[split]
            sent["flags"] = (equal | copies[which])[split] + 2 * ids.isna().to_numpy()[w]
            sent = sent[np.argsort(sent["key"], kind="stable")]
            edges = np.array([(k << 64) // pieces << 64 for k in range(1, pieces)], object)
            edges = np.array([e.to_bytes(16, "big") for e in edges], "S16")
            cut = np.concatenate([[0], np.searchsorted(sent["key"], edges), [len(sent)]])
            some = np.flatnonzero(np.diff(cut))
            runs = pd.DataFrame({"piece": some, "run": [sent[cut[k] : cut[k + 1]].tobytes() for k in some]})
            out = pd.concat([out, runs.astype({"piece": "Int64"})], ignore_index=True)
        return out

    return fetched.groupBy("shard").applyInPandas(run, FOUND)


def digests(data: pd.Series, sizes: np.ndarray, which: np.ndarray, start: np.ndarray, length: int):
    """Two 64-bit hashes of windows, taken some stretches at a time."""
    d1, d2 = np.empty(len(which), np.int64), np.empty(len(which), np.int64)
    room = SLICE // int(sizes.max())
    for a in range(0, len(data), room):
        block = data.iloc[a : a + room]
        hashes = Hashes(np.frombuffer(b"".join(block), np.uint8))
        offset = np.cumsum(sizes[a : a + room]) - sizes[a : a + room]
        own = np.flatnonzero((which >= a) & (which < a + room))
        at = offset[which[own] - a] + start[own]
        d1[own] = hashes.of(0, at, at + length).view(np.int64)
        d2[own] = hashes.of(1, at, at + length).view(np.int64)
    Hashes.forget()
    return d1, d2


def merge_runs(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sorted runs of different keys as one, the places in it that both had, and what of ``other`` is in ``one``."""
    at = np.searchsorted(one["key"], other["key"])
    met = one["key"][np.minimum(at, len(one) - 1)] == other["key"]
    rest = np.flatnonzero(~met)
    # Places in ``one`` move up by what is put in before them.
    places = at[met] + np.searchsorted(at[rest], at[met], "right")
    return np.insert(one, at[rest], other[rest]), places, other[met]


def merge_shards(runs: DataFrame, length: int) -> DataFrame:
    """Spans of windows that two shards met: runs of a piece merged two by two."""

    def spans(entries: np.ndarray) -> pd.DataFrame:
        entries = entries[entries["flags"] & 1 == 0]
        doc = pd.Series(entries["doc"], dtype="Int64").mask(pd.Series(entries["flags"] & 2 > 0))
        return pd.DataFrame({"doc_id": doc, "text_key": entries["text"], "begin": entries["begin"], "end": entries["begin"] + length})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        # Of entries that met, one stays and is marked; the others are reported at once.
        left = [(np.frombuffer(r, ENTRY), np.zeros(len(r) // ENTRY.itemsize, bool)) for r in frame.run]
        out = []
        while len(left) > 1:
            ahead = [left.pop()] if len(left) % 2 else []
            for (a, met_a), (b, met_b) in zip(left[::2], left[1::2], strict=True):
                if len(a) < len(b):
                    a, met_a, b, met_b = b, met_b, a, met_a
                both, places, gone = merge_runs(a, b)
                marks = np.zeros(len(both), bool)
                marks[np.searchsorted(both["key"], a["key"][met_a])] = True
                marks[np.searchsorted(both["key"], b["key"][met_b])] = True
                marks[places] = True
                out.append(spans(gone))
                ahead.append((both, marks))
            left = ahead
        out += [spans(entries[marks]) for entries, marks in left]
        return pd.concat(out, ignore_index=True)

    return runs.select("piece", "run").groupBy("piece").applyInPandas(merge, SPANS)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, begin, end): byte spans, overlapping ones included, that repeat.

    ``docs`` has doc_id, text_key and text.
    """
    found = store(stretch_table(docs, length, gram), "stretches")
    grams = found.groupBy("gram").agg(F.count("*").alias("n_all")).where("n_all > 1").select("gram")
    # Stored first, so that a gram with very many stretches can be split in the join.
    often = store(found.join(store(grams, "grams-often"), "gram", "left_semi"), "stretches-often")
    wholes = store(
        often.groupBy("gram", "whole").agg(
            F.count("*").alias("copies"), F.min(F.struct("start", "text_key", "doc_id", "n")).alias("first")
        ), "stretches-different",
    )
    # A stretch that occurs twice as a whole.
    last = F.col("start") + F.col("n") - 1 + length
    copied = wholes.where("copies > 1").select("gram", "whole")
    copies = often.join(copied, ["gram", "whole"], "left_semi").select(
        "doc_id", "text_key", F.col("start").alias("begin"), last.alias("end")
    )

    # Grams under which some stretch has no copy: only there a window can still be undecided.
    undecided = wholes.groupBy("gram").agg(
        F.count("*").alias("kinds"), F.count_if(F.col("copies") == 1).alias("single"), F.sum("first.n").alias("windows")
    ).where("single > 0")
    undecided = store(undecided, "grams-undecided")
    parts = F.ceil(F.col("kinds") / WIDE)
    wanted = wholes.join(undecided, "gram").select(
        "gram", "whole", "copies", "first.*", parts.alias("parts"), F.pmod("whole", parts).alias("part")
    )
    kinds, entries = undecided.agg(F.sum("kinds"), F.sum(F.when(F.col("kinds") > WIDE, F.col("windows")))).first()
    shards = max(1, -(-(kinds or 0) // SHARD))
    pieces = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(entries or 0) // RUN_ROWS))
    wanted = wanted.withColumn("shard", F.pmod(F.xxhash64("gram", "part"), F.lit(shards))).drop("part")
    # Rows that repeat both id and text: every text with a stretch has one at its start.
    again = found.where("start = 0").groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key")
    fetched = fetch(docs, wanted, store(again, "rows-again"), length)
    shard = store(shard_spans(fetched, length, pieces), "shard-spans")
    sure = shard.where("piece is null").select("doc_id", "text_key", "begin", "end")
    crossed = merge_shards(shard.where("piece is not null"), length)
    return copies.unionByName(sure).unionByName(crossed)


FETCHED = "shard long, gram long, whole long, copies long, parts long, doc_id long, text_key long, start long, n int, data binary"


def fetch(docs: DataFrame, wanted: DataFrame, again: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted stretches: each document is opened once for all of its own.

    ``again`` (doc_id, text_key) are documents with several rows: one row of each is opened.
    """
    one = wanted.select("doc_id", "text_key", F.struct("shard", "gram", "whole", "copies", "parts", "start", "n").alias("one"))
    several = not again.isEmpty()
    if several:
        marks = again.withColumn("again", F.lit(True))
        one = one.withColumn("again", F.lit(False)).unionByName(marks.withColumn("one", F.lit(None).cast(one.schema["one"].dataType)))
    else:
        one = one.withColumn("again", F.lit(False))
    lists = one.groupBy("doc_id", "text_key").agg(F.collect_list("one").alias("wanted"), F.max("again").alias("again"))
    lists = lists.where("size(wanted) > 0").withColumnsRenamed({"doc_id": "want_id", "text_key": "want_key"})
    both = docs.join(lists, docs["doc_id"].eqNullSafe(lists["want_id"]) & (docs["text_key"] == lists["want_key"]))
    if several:
        both = both.where("NOT again").unionByName(both.where("again").dropDuplicates(["doc_id", "text_key"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FETCHED.split(", ")]
        types = [pa.int64()] * 8 + [pa.int32(), pa.binary()]
        for batch in batches:
            held = []
            for doc, key, text, asked in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = text.encode()
                for w in asked:
                    piece = data[w["start"] : w["start"] + w["n"] - 1 + length]
                    held.append((w["shard"], w["gram"], w["whole"], w["copies"], w["parts"], doc, key, w["start"], w["n"], piece))
                if len(held) >= 8192:
                    yield rows(held, names, types)
                    held = []
            if held:
                yield rows(held, names, types)

    def rows(held, names, types) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names
        )

    return both.select("doc_id", "text_key", "text", "wanted").transform(arrow_map, run, FETCHED)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, into: str = "cuts") -> DataFrame:
    """``docs`` with a struct ``into``: n_bytes, spans of removed bytes, kept bytes."""
    rows = docs.drop(into)
    text = F.col("text").cast("string")
    keyed = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))
    lists = repeated_spans(keyed, length, gram).groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("begin", "end")).alias("spans")
    )
    mark = "_" * (max(len(c) for c in rows.columns) + 1)
    lists = lists.toDF(mark + "id", mark + "key", mark + "spans")
    own = rows.withColumn(mark + "own", text_key(text))
    both = own.join(
        lists, own["doc_id"].cast("long").eqNullSafe(lists[mark + "id"]) & (own[mark + "own"] == lists[mark + "key"]), "left"
    ).select(*rows.columns, mark + "spans")
    names = both.columns
    at = names.index("text")
    kind = pa.struct([
        ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                out = []
                for value, found in zip(batch.column(at).to_pylist(), batch.column(len(names) - 1).to_pylist(), strict=True):
                    data = (value or "").encode()
                    spans = merged([(s["begin"], s["end"]) for s in found or []])
                    kept, last = [], 0
                    for s, e in spans:
                        kept.append(data[last:s])
                        last = e
                    kept.append(data[last:])
                    out.append({"n_bytes": len(data), "spans": [{"begin": s, "end": e} for s, e in spans], "kept": b"".join(kept)})
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], [*names[:-1], into])

    kind_name = "struct<n_bytes:bigint,spans:array<struct<begin:bigint,end:bigint>>,kept:binary>"
    return both.transform(arrow_map, cut, f"{row_type(rows)}, `{into}` {kind_name}")


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated bytes cut from ``text``; ``n_chars`` follows.

    A character that loses some of its bytes loses all; a document that loses
    everything stays with an empty text.
    """
    into = free_name(docs.columns, "cuts")
    found = remove_repeats(docs, length, into=into)
    names = found.columns
    cuts, at = names.index(into), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.column(cuts).field("kept").to_pylist()
            texts = [None if t is None else k.decode(errors="ignore") for t, k in zip(batch.column(at).to_pylist(), kept, strict=True)]
            arrays = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns) if k != cuts]
            yield pa.RecordBatch.from_arrays(arrays, [c for c in names if c != into])

    clean = found.transform(arrow_map, run, row_type(found, without=into))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)
