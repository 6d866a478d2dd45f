"""Byte-level BPE through a table of distinct words.

Texts are split into words in Spark tasks and kept as blocks: a block has its own list
of different words, and each text is a row of positions in that list (0 for the next
word that has not been met yet, others counted from 1). The words of all
blocks meet in one table in which every distinct word is encoded once, and its ids are
turned into pieces once, by a join with the vocabulary. Ids come back to the blocks by
(block, position), and pieces with them unless they spell the word itself; there texts
are put together again. Blocks are bucketed, so what they hold of texts is never shuffled.

Special tokens inside a text are words of their own, as the tokenizer has it. Blocks end
at ``BLOCK_BYTES`` of text or ``BLOCK_TEXTS`` texts, so lists are bounded; a longer text is
a block alone. A null text is empty and has no ids; null and repeated ids and repeated
rows are kept as they are; no documents give no rows. Decoded bytes that are not UTF-8
(ids cut inside a character) become replacement characters; an id that the vocabulary
lacks or a null id decodes to nothing.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import arrow_map
from facetloom.llm.tokens import byte_letters, vocabulary_path
from facetloom.session import scratch_path

BLOCK_BYTES = 8 << 20
BLOCK_TEXTS = 1 << 15
OUT_WORDS = 1 << 18  # in one batch of results
WORDS_AT_ONCE = 4096
LEVEL = 3  # of Zstandard, for positions
ID_TYPE, ID_BYTES = "<u2", 2  # of an id between tables; a vocabulary has at most 2^16

#: How byte-level vocabularies of this kind split a text into words.
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPLIT = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)

BLOCKS = "block long, doc_ids array<long>, sizes array<int>, codes binary, words array<{}>"


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """``df`` written to the shared folder and read back as a table dealt by ``by``, without a shuffle."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).sortBy(by)
    writer.option("path", scratch_path(spark, name)).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


class Vocabulary:
    """A tokenizer file: its words, its pieces and its special tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def special(self) -> dict[str, int]:
        with open(self.path, encoding="utf-8") as file:
            return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}

    def pieces(self) -> list[tuple[int, bytes]]:
        """(id, bytes) of the whole vocabulary."""
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        names = {v: k for k, v in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        special = {v: k.encode() for k, v in self.special.items()}
        if max(names) >> 8 * ID_BYTES:
            raise ValueError("more than 2^16 ids")
        return [(k, special.get(k) or bytes(map(byte_of.__getitem__, name))) for k, name in sorted(names.items())]

    def splitter(self) -> Callable[[str], list[str]]:
        import regex

        words = regex.compile(SPLIT).findall
        if not self.special:
            return words
        marks = sorted(self.special, key=len, reverse=True)
        cut = re.compile("(" + "|".join(map(re.escape, marks)) + ")").split

        def split(text: str) -> list[str]:
            if not any(m in text for m in marks):
                return words(text)
            # Every second part is a mark.
            return [w for k, part in enumerate(cut(text)) for w in ([part] if k % 2 else words(part))]

        return split

    def encoder(self) -> Callable[[list[str]], list[list[int]]]:
        """Ids of each of some words."""
        letters, special, model = byte_letters(), self.special, self.tokenizer.model

        def encode(words: list[str]) -> list[list[int]]:
            return [
                [special[w]] if w in special
                else [t.id for t in model.tokenize(w if w.isascii() and w.isalnum() else "".join(map(letters.__getitem__, w.encode())))]
                for w in words
            ]

        return encode


def blocked(rows: DataFrame, split: Callable[[], Callable], kind: str) -> DataFrame:
    """Blocks, stored, of ``rows`` (doc_id, x): ``split()`` makes the words, of type ``kind``, of an x."""
    schema = BLOCKS.format(kind)
    word_type = {"string": pa.string(), "int": pa.int32()}[kind]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from zstandard import ZstdCompressor

        words_of, press = split(), ZstdCompressor(level=LEVEL)
        number = TaskContext.get().partitionId() << 33
        own: dict = {}
        ids, sizes, codes, size = [], [], array("I"), 0

        def block():
            data = np.frombuffer(codes, np.uint32)
            # A word's first place says only that the next word of the list is new.
            new = np.diff(np.maximum.accumulate(data.astype(np.int64)), prepend=-1) > 0
            data = np.where(new, 0, data + 1).astype(np.uint16 if len(own) < 1 << 16 else np.uint32)
            # Low bytes first, then high bytes: both compress better alone.
            planes = data.view(np.uint8).reshape(len(data), -1).T.tobytes()
            values = [number, ids, sizes, press.compress(planes), list(own)]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(word_type)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["block", "doc_ids", "sizes", "codes", "words"])

        for batch in batches:
            for k in range(batch.num_rows):
                value = batch.column(1)[k].as_py()
                words = words_of(value) if value else []
                if ids and (size > BLOCK_BYTES or len(ids) >= BLOCK_TEXTS):
                    yield block()
                    number, own, ids, sizes, codes, size = number + 1, {}, [], [], array("I"), 0
                codes.extend([own.setdefault(w, len(own)) for w in words])
                ids.append(batch.column(0)[k].as_py())
                sizes.append(len(words))
                size += len(value or ()) if kind == "string" else 4 * len(words)
        if ids:
            yield block()

    return bucketed(rows.transform(arrow_map, pack, schema), "blocks", "block")


def asked_words(blocks: DataFrame) -> DataFrame:
    """(block, pos, word), dealt by word."""
    # Joins ask for keys that are not null: asked here, both sides of a join share one shuffle.
    asked = blocks.where("block IS NOT NULL").select("block", F.posexplode("words").alias("pos", "word"))
    return asked.where("word IS NOT NULL").repartition("word")


def placed(pos: Column, value: Column) -> Column:
    """A value behind its position, four bytes that sort like the number: half as wide as a struct."""
    return F.concat(F.unhex(F.lpad(F.hex(pos.cast("long")), 8, "0")), value)


def values_of(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the values behind ``parts``' positions, one after the other, and the size of each."""
    # Their own buffers: a block has too many words for a Python object each.
    edges = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
    data = np.frombuffer(parts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    value = np.ones(len(data), bool)
    for k in range(4):
        value[edges[:-1] - edges[0] + k] = False
    return data[value], np.diff(edges) - 4


def gathered(at: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of parts ``at``, in this order, and the ends of each."""
    each = sizes[at]
    ends = np.cumsum(each)
    first = (np.cumsum(sizes) - sizes)[at] - (ends - each)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first, each)].astype(np.int32), ends


def unblocked(blocks: DataFrame, found: DataFrame, with_ids: bool) -> DataFrame:
    """(doc_id, ids, text), or without ids, of ``blocks`` and their words' (block, pos, value, text).

    A value is a word's ids, or the bytes it decodes to; a word with ids but no ``text`` spells itself.
    """
    other = F.when(F.col("text").isNotNull(), F.struct("pos", "text"))
    # A block's list is bounded by the size of a block.
    lists = found.groupBy("block").agg(
        F.array_sort(F.collect_list(placed(F.col("pos"), F.col("value")))).alias("values"), F.collect_list(other).alias("others")
    )
    rows = blocks.join(lists, "block", "left").select("doc_ids", "sizes", "codes", "words", "values", "others")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        press = ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                row = dict(zip(batch.schema.names, (batch.column(c)[k] for c in range(batch.num_columns))))
                planes = np.frombuffer(press.decompress(row["codes"].as_py()), np.uint8)
                sizes, doc_ids = row["sizes"].as_py(), row["doc_ids"].as_py()
                n = sum(sizes)
                wide = np.uint16 if len(planes) == 2 * n else np.uint32
                at = np.ascontiguousarray(planes.reshape(-1, n).T).view(wide).ravel() if n else np.zeros(0, np.uint16)
                del planes
                new = at == 0
                at = at - at.dtype.type(1)
                at[new] = np.arange(np.count_nonzero(new))
                pieces, coded = [], None
                if row["values"].is_valid:
                    data, widths = values_of(row["values"].values)
                    if with_ids:
                        coded = data.view(ID_TYPE), widths // ID_BYTES
                        pieces = row["words"].values.cast(pa.binary()).to_pylist()
                        for o in row["others"].as_py():
                            pieces[o["pos"]] = o["text"]
                    else:
                        begins = np.cumsum(widths) - widths
                        pieces = [data[b : b + w].tobytes() for b, w in zip(begins.tolist(), widths.tolist())]
                ends = np.cumsum(sizes)
                begin = 0
                while begin < len(sizes):
                    # Some texts at a time; a long one alone.
                    before = int(ends[begin] - sizes[begin])
                    end = max(begin + 1, int(np.searchsorted(ends, before + OUT_WORDS, "right")))
                    codes = at[before : int(ends[end - 1])]
                    listed, texts, done = codes.tolist(), [], 0
                    for size in sizes[begin:end]:
                        texts.append(b"".join([pieces[i] for i in listed[done : done + size]]).decode("utf-8", "replace"))
                        done += size
                    columns = {"doc_id": pa.array(doc_ids[begin:end], pa.int64())}
                    if with_ids:
                        ids, edges = gathered(codes, *coded) if coded else (np.zeros(0, np.int32), np.zeros(0, np.int64))
                        edges = np.concatenate([[0], edges])[np.concatenate([[0], ends[begin:end] - before])]
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))
                    columns["text"] = pa.array(texts, pa.string())
                    yield pa.RecordBatch.from_pydict(columns)
                    begin = end

    return rows.transform(arrow_map, put_together, "doc_id long, ids array<int>, text string" if with_ids else "doc_id long, text string")


def piece_table(spark, path: str) -> DataFrame:
    """(id, piece) of a vocabulary: as many rows as the file has, some ten thousand."""
    return spark.createDataFrame(Vocabulary(path).pieces(), "id int, piece binary")


def word_table(asked: DataFrame, path: str) -> DataFrame:
    """(word, ids, text) of each distinct word: its ids, and what they decode to if that is not the word."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Vocabulary(path).encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, WORDS_AT_ONCE):
                part = batch.column(0).slice(at, WORDS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([part, pa.array(ids_of(part.to_pylist()), pa.list_(pa.int32()))], ["word", "ids"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a word follow each other: neither the explode nor the broadcast join moves any."""
        word, ids, pieces, out = None, [], [], []

        def close():
            text = b"".join(pieces)
            out.append((word, np.array(ids, ID_TYPE).tobytes(), None if text == word.encode() else text))

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.binary()))], ["word", "ids", "text"])

        for batch in batches:
            for w, pos, i, piece in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if pos == 0:
                    if word is not None:
                        close()
                    word, ids, pieces = w, [], []
                if w != word or pos != len(ids):
                    raise RuntimeError("the ids of a word came in another order")
                ids.append(i)
                pieces.append(piece or b"")
            if out:
                yield rows()
                out.clear()
        if word is not None:
            close()
            yield rows()

    # Its first place comes along, so that the words are dealt once for this table and for its join.
    distinct = asked.groupBy("word").agg(F.min("block").alias("block"), F.min("pos").alias("pos"))
    encoded = distinct.transform(arrow_map, encode, "word string, ids array<int>")
    each = encoded.select("word", F.posexplode("ids").alias("pos", "id"))
    pieces = F.broadcast(piece_table(asked.sparkSession, path))
    joined = each.join(pieces, "id", "left").select("word", "pos", "id", "piece")
    return joined.transform(arrow_map, spelled, "word string, ids binary, text binary")


def roundtrip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) per row of ``docs`` (doc_id, text): its ids and the text they decode to."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = blocked(rows, lambda: Vocabulary(path).splitter(), "string")
    asked = asked_words(blocks)
    found = asked.join(word_table(asked, path), "word").select("block", "pos", F.col("ids").alias("value"), "text")
    return unblocked(blocks, found, with_ids=True)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) per row of ``docs`` (doc_id, text)."""
    return roundtrip(docs, path).select("doc_id", "ids")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) per row of ``coded`` (doc_id, ids): any ids, not only whole words."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    rows = coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    blocks = blocked(rows, lambda: list, "int")
    pieces = piece_table(coded.sparkSession, path)
    asked = blocks.select("block", F.posexplode("words").alias("pos", "id"))
    value = F.coalesce("piece", F.lit(b"").cast("binary")).alias("value")
    found = asked.join(F.broadcast(pieces), "id", "left").select("block", "pos", value, F.lit(None).cast("binary").alias("text"))
    return unblocked(blocks, found, with_ids=False)
