"""WARC archives compressed record by record against a dictionary of their own.

Each task writes the records of its rows into archives: pieces spread evenly over
an archive's bytes train a Zstandard dictionary (or are it, where too few to train
on), which stands in a skippable frame at the head of the file; every record is a frame of its own, so any record can be read alone. Files
get a name of their own per attempt and are listed in the returned manifest;
what a lost attempt left is in no manifest and is never read.

Null html is an empty payload. Rows with equal payloads: the smallest page_id is
archived as a response, the others as revisits without a payload. Rows that
repeat that smallest page_id are responses too, as are rows whose group has no
page_id at all. No rows give no archives.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import arrow_map, store
from facetloom.session import scratch_path

# Fixed values of the archive format.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 64 << 10
TRAINING_BYTES = 1 << 20
PIECES = 512  # of an archive, to train on
ARCHIVE_BYTES = 64 << 20  # of uncompressed records, after which a new archive starts
LEVEL = 3

MANIFEST = "path string, records long, raw_bytes long, archive_bytes long, dictionary_bytes long"
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload binary,"
    " payload_bytes long, payload_digest string, path string, position long"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, response_id): the page whose payload stands for this one."""
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    # One row per payload that occurs twice; counted before anything is shuffled.
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(
        F.min("page_id").alias("response_id"), F.count("*").alias("_n")
    ).where("_n > 1").drop("_n")
    first = store(first, "warc-first")  # a plain table, so that a payload with very many pages can be split
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "response_id")


def _uri(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def _page(uri: str) -> int | None:
    tail = uri.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def record(page_id, url, payload: bytes, response_id, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit of another."""
    revisit = response_id is not None and response_id != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_uri(page_id)}>",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # A header is one line; other characters stay as they are.
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_uri(response_id)}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What ``record`` wrote; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].partition(":")[2]
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": fields["WARC-Type"],
        "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload, "payload_bytes": length, "payload_digest": digest,
    }


def sample(records: list[bytes]) -> list[bytes]:
    """Pieces spread evenly over the bytes of ``records``: ``PIECES`` of them, or all of few bytes."""
    total = sum(map(len, records))
    size = max(64, min(TRAINING_BYTES, total) // PIECES)
    step, at, passed, found = max(size, total // PIECES), 0, 0, []
    for data in records:
        while at < passed + len(data):
            begin = at - passed
            found.append(data[begin : begin + size])
            at += step
        passed += len(data)
    return found


def train(pieces: list[bytes], size: int = DICTIONARY_BYTES):
    """Dictionary of some pieces: a trained one, or their own bytes if they have too little in common to train on."""
    import zstandard

    size = max(256, min(size, sum(map(len, pieces)) // 8))
    try:
        return zstandard.train_dictionary(size, pieces, k=512, d=8, level=LEVEL)
    except zstandard.ZstdError:
        # A reader takes what starts with the magic number, whose first byte is "7", for a trained one.
        raw = b"".join(pieces)[-size:].lstrip(b"7")
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], dictionary) -> Iterator[bytes]:
    """Head frame and one frame per record."""
    import zstandard

    if dictionary is not None:
        content = dictionary.as_bytes()
        yield struct.pack("<II", DICTIONARY_FRAME, len(content)) + content
        dictionary.precompute_compress(level=LEVEL)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    for data in records:
        yield pack.compress(data)


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; returns the stored manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for page_id, url, payload, response_id in zip(*columns, strict=True):
                held.append(record(page_id, url, payload, response_id, date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield put(held, size)
                    held, size = [], 0
        if held:
            yield put(held, size)

    def put(records: list[bytes], size: int) -> pa.RecordBatch:
        from pyarrow import fs

        store_, root = fs.FileSystem.from_uri(folder)
        name = f"{uuid.uuid4().hex}.warc.zst"
        store_.create_dir(root, recursive=True)
        written, dictionary = 0, train(sample(records))
        with store_.open_output_stream(f"{root}/{name}") as out:
            for frame in archive(records, dictionary):
                out.write(frame)
                written += len(frame)
        return pa.RecordBatch.from_pylist(
            [{
                "path": f"{folder}/{name}", "records": len(records), "raw_bytes": size, "archive_bytes": written,
                "dictionary_bytes": len(dictionary.as_bytes()),
            }],
            pa.schema([("path", pa.string()), *((k, pa.int64()) for k in ("records", "raw_bytes", "archive_bytes", "dictionary_bytes"))]),
        )

    return store(with_revisits(pages, min_bytes).transform(arrow_map, write, MANIFEST), "warc-manifest")


def records_in(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(position, record) of each frame of an archive."""
    import zstandard

    at, dictionary = 0, None
    if data[:4] == struct.pack("<I", DICTIONARY_FRAME):
        size = struct.unpack("<I", data[4:8])[0]
        dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        at = 8 + size
    context = zstandard.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(data)
    while at < len(data):
        reader = context.decompressobj()
        out = reader.decompress(view[at:])
        yield at, out
        at = len(data) - len(reader.unused_data)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the archives a manifest lists."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("path", pa.string()), ("position", pa.int64()),
        ])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store_, name = fs.FileSystem.from_uri(path)
                with store_.open_input_stream(name) as file:
                    data = file.read()
                rows, size = [], 0
                for at, found in records_in(data):
                    rows.append(parse(found) | {"path": path, "position": at})
                    size += len(found)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = manifest.select("path")
    return files.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "path").transform(arrow_map, read, RECORDS)


def roundtrip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the records back."""
    folder = scratch_path(pages.sparkSession, "warc")
    if "://" not in folder:
        folder = folder if folder.startswith("file:") else f"file://{folder}"
    return read_archives(write_archives(pages, folder, min_bytes=min_bytes))
