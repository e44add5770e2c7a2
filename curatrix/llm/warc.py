"""WARC records in seekable Zstandard bundles: write, index, read back, fetch single records."""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import shared_folder, small_side, stored

#: Bytes of records from which on a frame is closed, and of compressed frames from which on a bundle is.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 28
SUFFIX = ".warc.zst"
#: Fixed values of the seekable format: a skippable frame's number and the footer's mark.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FOOTER, ENTRY = struct.Struct("<IBI"), struct.Struct("<II")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-record:"
#: Signs that a target URI keeps; all others are escaped.
URI_SIGNS = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in '"<>\\^`{|}')
FRAMES = "file string, frame int, start long, packed long, size long"
RECORDS = "record_id string, page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to_id string, refers_to long"


def record_id(page_id: int | None, digest: str) -> str:
    """Identifier of a page's record; the payload's digest tells rows of one page apart."""
    return f"{URN}{'' if page_id is None else page_id}:{digest}"


def page_of(identifier: str) -> int | None:
    number = identifier[len(URN) :].split(":", 1)[0]
    return int(number) if number else None


def record(kind: str, identifier: str, date: str, content_type: str, block: bytes, **fields: str) -> bytes:
    """One WARC/1.1 record."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{identifier}>", f"WARC-Date: {date}", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v)]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Type: {content_type}", f"Content-Length: {len(block)}"])
    return b"".join([head.encode(), b"\r\n\r\n", block, b"\r\n\r\n"])


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> tuple[str, bytes]:
    """(identifier, record) of a page: a response, or a revisit that keeps the HTTP head only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    identifier = record_id(page_id, digest)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    target = urllib.parse.quote(url, safe=URI_SIGNS) if url else identifier
    fields = {"WARC_Target_URI": target, "WARC_Payload_Digest": f"sha1:{digest}"}
    if refers_to is not None:
        fields |= {"WARC_Refers_To": f"<{refers_to}>", "WARC_Profile": PROFILE}
    return identifier, record("response" if refers_to is None else "revisit", identifier, date, "application/http;msgtype=response", http if refers_to is not None else http + payload, **fields)


def records_in(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of each record of an unpacked frame."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("no record begins here")
        fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
        end = head + 4 + int(fields["content-length"])
        yield at, fields, data[head + 4 : end]
        at = end + 4


def described(fields: dict[str, str], block: bytes) -> tuple[dict, bytes]:
    """(row of ``RECORDS``, payload) of a page record; a response's payload must have the digest it names."""
    head, payload = block.split(b"\r\n\r\n", 1)
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    told = int(next(line for line in head.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
    if fields["warc-type"] == "response" and (len(payload) != told or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    identifier, refers = fields["warc-record-id"].strip("<>"), fields.get("warc-refers-to", "").strip("<>")
    return {
        "record_id": identifier, "page_id": page_of(identifier), "record_type": fields["warc-type"], "target_uri": fields["warc-target-uri"], "payload_bytes": told,
        "payload_digest": digest, "refers_to_id": refers or None, "refers_to": page_of(refers) if refers else None,
    }, payload


class Bundle:
    """Independent frames written to ``out`` one after the other, and the footer that tells where each begins."""

    def __init__(self, out, frame_bytes: int):
        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.table: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.held = self.size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame of a record and its offset within the unpacked frame."""
        if self.held and self.held + len(data) > self.frame_bytes:
            self.flush()
        place = len(self.table), self.held
        self.parts.append(data)
        self.held += len(data)
        return place

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.parts))
            self.out.write(packed)
            self.table.append((len(packed), self.held))
            self.size += len(packed)
            self.parts, self.held = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(ENTRY.pack(*e) for e in self.table) + FOOTER.pack(len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(start, packed size, unpacked size) of each frame of an open bundle, from its footer."""
    end = file.size()
    file.seek(end - FOOTER.size)
    count, flags, mark = FOOTER.unpack(file.read(FOOTER.size))
    if mark != SEEKABLE or flags:
        raise ValueError("not a seekable bundle")
    file.seek(end - FOOTER.size - count * ENTRY.size)
    out, at = [], 0
    for packed, size in ENTRY.iter_unpack(file.read(count * ENTRY.size)):
        out.append((at, packed, size))
        at += packed
    return out


def with_responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): which page's record each page repeats, null for a response.

    Of equal payloads of at least ``revisit_bytes`` the page with the largest id is the
    response. Payloads meet by their SHA-1; the largest id is aggregated map-side, and only
    payloads that repeat are joined back.
    """
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    long = rows.filter(F.octet_length("payload") >= revisit_bytes)
    groups = long.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top")).filter("n > 1 and top is not null")
    tops = small_side(stored(groups.select("digest", "top"), "repeated"))
    return rows.join(tops, "digest", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def write_bundles(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a record per row of ``with_responses`` to bundles in ``folder`` (a URI of a shared store).

    Returns the index: ``record_id``, ``record_type``, ``file``, ``frame``, ``offset`` in
    the unpacked frame, ``length``. Each task writes its rows as they come, in frames of
    about ``frame_bytes`` (or one longer record), so it holds one frame at a time. A bundle
    has a temporary name until it is whole; those of tasks that failed are in no index.
    """
    schema = StructType.fromDDL("record_id string, record_type string, file string, frame int, offset long, length long")
    arrow = to_arrow_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        task, bundle, rows, name = TaskContext.get().partitionId(), None, [], ""

        def closed() -> pa.RecordBatch:
            bundle.close()
            store.move(f"{path}/.{name}", f"{path}/{name}")
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for page_id, url, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if bundle is None:
                    name = f"bundle-{task:06d}-{uuid.uuid4().hex}{SUFFIX}"
                    bundle, rows = Bundle(store.open_output_stream(f"{path}/.{name}", compression=None), frame_bytes), []
                    bundle.add(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", date, "application/warc-fields", b"format: WARC File Format 1.1\r\n"))
                body, top = payload.as_py(), refers.as_py()
                told = None if top is None else record_id(top, base64.b32encode(hashlib.sha1(body).digest()).decode())
                identifier, data = page_record(page_id.as_py(), url.as_py(), body, told, date)
                rows.append((identifier, "response" if told is None else "revisit", name, *bundle.add(data), len(data)))
                if bundle.size + bundle.held >= bundle_bytes:
                    yield closed()
                    bundle = None
        if bundle is not None:
            yield closed()

    return stored(records.mapInArrow(write, schema), "index")


def frames_of(files: DataFrame, folder: str) -> DataFrame:
    """(file, frame, start, packed, size): the seek tables of the bundles in ``files`` (column ``file``), stored."""
    schema = StructType.fromDDL(FRAMES)
    arrow = to_arrow_schema(schema)

    def read(batches):
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_file(f"{path}/{name}") as file:
                    table = seek_table(file)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(table)), pa.array(range(len(table)), pa.int32()), *(pa.array(list(c), pa.int64()) for c in zip(*table, strict=True))], schema=arrow)

    return stored(files.mapInArrow(read, schema), "frames")


def _spread(frames: DataFrame, per_task: int = 64) -> DataFrame:
    """Frames dealt to enough tasks; few rows stand for many bytes, so their number is given."""
    tasks = max(frames.sparkSession.sparkContext.defaultParallelism, -(-frames.count() // per_task))
    return frames.repartition(tasks, "file", "frame")


def _unpacked(batch: pa.RecordBatch, store, path: str) -> Iterator[tuple[int, bytes]]:
    unpacker = zstandard.ZstdDecompressor()
    for k in range(batch.num_rows):
        name, start, packed = (batch.column(c)[k].as_py() for c in ("file", "start", "packed"))
        with store.open_input_file(f"{path}/{name}") as file:
            file.seek(start)
            yield k, unpacker.decompress(file.read(packed))


def read_bundles(files: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Page records of the bundles in ``files``: the columns of ``RECORDS`` and, if wanted, ``payload`` (null for a revisit).

    Frames are read by themselves, in any task, at the places that the footers name. A
    response whose payload does not have its digest is an error.
    """
    schema = StructType.fromDDL(RECORDS + (", payload binary" if payload else ""))
    arrow = to_arrow_schema(schema)

    def read(batches):
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for _, data in _unpacked(batch, store, path):
                rows = [described(f, b) for _, f, b in records_in(data) if f["warc-type"] != "warcinfo"]
                listed = [r | {"payload": p if r["record_type"] == "response" else None} for r, p in rows]
                yield pa.RecordBatch.from_pylist(listed, schema=arrow)

    return _spread(frames_of(files, folder)).mapInArrow(read, schema)


def fetch(index: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """The records whose ``record_id`` is in ``wanted``, each read from its frame alone; a revisit comes with the payload it refers to.

    Only frames that hold a wanted record are read.
    """
    ids = wanted.select("record_id").distinct()
    own = _fetched(index, ids, folder)
    refers = own.filter("refers_to_id is not null").select(F.col("refers_to_id").alias("record_id")).distinct()
    origin = _fetched(index, refers, folder).select(F.col("record_id").alias("refers_to_id"), F.col("payload").alias("_origin")).dropDuplicates(["refers_to_id"])
    return own.join(origin, "refers_to_id", "left").withColumn("payload", F.coalesce("payload", "_origin")).drop("_origin")


def _fetched(index: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    schema = StructType.fromDDL(RECORDS + ", payload binary")
    arrow = to_arrow_schema(schema)
    places = stored(index.join(ids, "record_id").groupBy("file", "frame").agg(F.collect_set("offset").alias("offsets")), "places")
    frames = frames_of(places.select("file").distinct(), folder).join(places, ["file", "frame"])

    def read(batches):
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for k, data in _unpacked(batch, store, path):
                rows = []
                for offset in batch.column("offsets")[k].as_py():
                    _, fields, block = next(records_in(memoryview(data)[offset:].tobytes()))
                    row, body = described(fields, block)
                    rows.append(row | {"payload": body if row["record_type"] == "response" else None})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return stored(_spread(frames).mapInArrow(read, schema), "fetched")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", revisit_bytes: int = 0, payload: bool = False, **sizes) -> DataFrame:
    """Writes a WARC record per page to a new shared folder and returns the records that its bundles hold.

    * A null body is an empty payload; empty payloads equal each other like any others.
    * A null or empty url is replaced by the record's identifier; signs that a URI may not
      hold are escaped.
    * Rows repeated under one id with one payload are all of its record: all responses, if
      theirs is the largest id of that payload, else all revisits. With different
      payloads they are records of their own.
    * Null ids come after all others: such a page is a response only if its payload has no
      page with an id.
    * An empty table writes no bundle and gives no rows. Other columns are ignored.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    index = write_bundles(with_responses(pages, id_col, url_col, body_col, revisit_bytes), folder, **sizes)
    return read_bundles(index.select("file").distinct(), folder, payload)
