"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of a bounded size, so a bundle is an ordinary ``.warc.zst`` file. A seek table in a skippable
frame at the end (the public seekable format) gives the compressed and plain size of every frame, and an index table maps each record to its
bundle, its frame and its place inside the frame: one record is read by fetching the table and one frame.

Payloads are compared by digest, which shuffles digests and ids; of equal payloads the row with the smallest id is written as a response and the others
as revisits without payload. Every task writes bundles under names of its own attempt, and only the bundles of attempts that Spark has
committed are in the index; what a lost attempt left is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinaria.llm.common import as_bytes, hot_keys, join_hot
from opinaria.session import cut_lineage, shared_dir

# Fixed values of the seekable format: magic of the skippable frame, magic and layout of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
ENTRY, FOOTER = struct.Struct("<II"), struct.Struct("<IBI")
FRAME_BYTES = 1 << 20  # plain bytes from which a frame is closed
BUNDLE_BYTES = 64 << 20  # compressed bytes from which a bundle is closed
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
RECORD = "<urn:x-page:%s:%d>"
INDEX_SCHEMA = "record_id string, page_id long, bundle string, frame int, offset long, length long"
READ_SCHEMA = ("record_id string, page_id long, record_type string, refers_to long, target_uri string, "
               "payload_bytes long, payload_digest string, payload binary")


def record_id(page_id: int | None, row: int) -> str:
    return RECORD % ("" if page_id is None else page_id, row)


def page_of(record: str) -> int | None:
    """The page id in a record id; null when the page had none."""
    number = record.split(":")[2]
    return int(number) if number else None


def record_bytes(row: int, page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: bytes, refers: str | None, date: str) -> bytes:
    """A response record, or a revisit of record ``refers``: the HTTP head without the payload."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(page_id, row)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}")
    if refers:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers}"]
    else:
        body += payload or b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), block and the end of the record that begins at ``at``."""
    past = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:past].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    headers = {name.lower(): value for name, value in (line.split(": ", 1) for line in lines)}
    start = past + 4
    end = start + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut off")
    return headers, data[start:end], end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame with (compressed, plain) sizes of the frames before it."""
    body = b"".join(ENTRY.pack(*s) for s in sizes) + FOOTER.pack(len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class Bundle:
    """One bundle for reading: its seek table, and frames by number."""

    def __init__(self, path: str):
        files, place = fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(place)
        past = self.file.size()
        frames, flags, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, past - FOOTER.size))
        if magic != SEEKABLE or flags:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(frames * ENTRY.size, past - FOOTER.size - frames * ENTRY.size)
        self.sizes = list(ENTRY.iter_unpack(table))
        self.starts, at = [], 0
        for compressed, _ in self.sizes:
            self.starts.append(at)
            at += compressed

    def frame(self, number: int) -> bytes:
        compressed, plain = self.sizes[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(compressed, self.starts[number]), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


class BundleWriter:
    """Bundles of one task attempt; ``add`` gives the place of a record, ``close`` ends the last bundle."""

    def __init__(self, folder: str, partition: int, frame_bytes: int, bundle_bytes: int, level: int):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.base, self.name = folder, f"{partition:06d}-{uuid.uuid4().hex}"
        self.frame_bytes, self.bundle_bytes, self.level = frame_bytes, bundle_bytes, level
        self.number, self.out, self.parts, self.held, self.sizes, self.written = 0, None, [], 0, [], 0

    def add(self, record: bytes) -> tuple[str, int, int, int]:
        """(bundle, frame, offset, length) of the record."""
        if self.out is None:
            file = f"{self.name}-{self.number:04d}.warc.zst"
            self.files.create_dir(self.folder, recursive=True)
            self.out, self.path = self.files.open_output_stream(f"{self.folder}/{file}", compression=None), f"{self.base}/{file}"
            self.sizes, self.written = [], 0
        place = (self.path, len(self.sizes), self.held, len(record))
        self.parts.append(record)
        self.held += len(record)
        if self.held >= self.frame_bytes:
            self._end_frame()
            if self.written >= self.bundle_bytes:
                self.close()
        return place

    def _end_frame(self) -> None:
        packed = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(b"".join(self.parts))
        self.out.write(packed)
        self.sizes.append((len(packed), self.held))
        self.written += len(packed)
        self.parts, self.held = [], 0

    def close(self) -> None:
        if self.out is not None:
            if self.parts:
                self._end_frame()
            self.out.write(seek_table(self.sizes))
            self.out.close()
            self.out, self.number = None, self.number + 1


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0,
                  frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3, date: str = EPOCH) -> DataFrame:
    """Write every row of ``pages`` as a record into bundles below ``folder``, which all executors must be able to write, and return the index: record_id,
    page_id, bundle, frame, offset (inside the plain frame) and length.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads of at least ``min_revisit_bytes`` bytes the one with the smallest id
    is a response and the others revisit it; smaller payloads are all responses. Rows without an id come after all ids and can be revisited
    as well; of rows that repeat the id too one is the response. A null url leaves the header out; signs that a header cannot
    hold are percent-encoded. Other columns are ignored; an empty table gives an empty index.
    """
    payload = F.coalesce(as_bytes(html_col), F.lit(b""))
    rows = cut_lineage(pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("size"), F.unhex(F.sha1(payload)).alias("digest")))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").alias("first_id"), F.col("row").alias("first_row"))
    repeated = cut_lineage(rows.where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("many"), F.min(order).alias("first"))
                           .where("many > 1").select("digest", "many", "first.first_id", "first.first_row"))
    hot = hot_keys(repeated, "digest", "many", rows.count())
    judged = join_hot(rows, repeated.drop("many"), "digest", hot=hot)
    again = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    ready = judged.select("row", "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", "digest", again.alias("again"), "first_id", "first_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, TaskContext.get().partitionId(), frame_bytes, bundle_bytes, level)
        for batch in batches:
            places = []
            small = [batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5, 6, 7, 8)]
            for payload, row, page, url, size, digest, revisits, first_id, first_row in zip(batch.column(3), *small):
                refers = record_id(first_id, first_row) if revisits else None
                places.append((record_id(page, row), page, *writer.add(record_bytes(row, page, url, payload.as_py(), size, digest, refers, date))))
            columns = list(zip(*places)) or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["record_id", "page_id", "bundle", "frame", "offset", "length"])
        writer.close()

    return cut_lineage(ready.mapInArrow(run, INDEX_SCHEMA))


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.rsplit(b"Content-Length: ", 1)[1])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    response = headers["warc-type"] == "response"
    if response and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {headers['warc-record-id']} does not have its digest")
    record, refers, url = headers["warc-record-id"], headers.get("warc-refers-to"), headers.get("warc-target-uri")
    return (record, page_of(record), headers["warc-type"], page_of(refers) if refers else None, unquote(url) if url is not None else None,
            size, digest, payload if response and payloads else None)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 8
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ["record_id", "page_id", "record_type", "refers_to", "target_uri", "payload_bytes", "payload_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _dealt(index: DataFrame, *columns: str) -> DataFrame:
    """Rows of an index with each bundle in one partition."""
    bundles = index.agg(F.count_distinct("bundle")).first()[0]
    return index.select(*columns).repartition(max(1, min(bundles, 10_000)), "bundle")


def read_bundles(index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the bundles of an index, one frame in memory at a time: record_id, page_id, record_type, refers_to (page id), target_uri, payload_bytes,
    payload_digest (base32 SHA-1) and payload (null for revisits and without ``payloads``). Digests of responses are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                bundle = Bundle(path)
                for number in range(len(bundle.sizes)):
                    data, at, rows = bundle.frame(number), 0, []
                    while at < len(data):
                        headers, block, at = parse_record(data, at)
                        rows.append(_row(headers, block, payloads))
                    yield _records(rows)
                bundle.close()

    return _dealt(index.select("bundle").distinct(), "bundle").mapInArrow(run, READ_SCHEMA)


def fetch(index: DataFrame, wanted: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records of the page ids in ``wanted``, by index, seek table and frame; only the frames that hold one are read."""
    ids = wanted.select(F.col(id_col).cast("long").alias("page_id")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, number, bundle, data = None, None, None, b""
        for batch in batches:
            rows = []
            for place, frame, offset in zip(*(c.to_pylist() for c in batch.columns)):
                if place != path:
                    if bundle:
                        bundle.close()
                    bundle, path, number = Bundle(place), place, None
                if frame != number:
                    data, number = bundle.frame(frame), frame
                headers, block, _ = parse_record(data, offset)
                rows.append(_row(headers, block, True))
            yield _records(rows)
        if bundle:
            bundle.close()

    found = _dealt(index.join(ids, "page_id", "left_semi"), "bundle", "frame", "offset")
    return found.sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, READ_SCHEMA)


def bundle_folder(pages: DataFrame) -> str:
    """A fresh folder for bundles below the shared folder of the session."""
    return shared_dir(pages.sparkSession)
