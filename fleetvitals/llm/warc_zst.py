"""WARC 1.1 records in Zstandard archives: one frame per record, the dictionary in a leading
skippable frame.

Writing: equal payloads are found by digest and length before anything is written; the smallest id
is the response and the others are revisits without a payload of their own. Each task writes its
rows to archives of bounded size in the shared folder under a name of its own attempt, and only the
list of archives that finished tasks return is read, so a lost executor leaves nothing half-done.

Reading: an archive is streamed; each frame is decoded alone and its version line, header fields,
lengths, ending and digests are checked.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm._scratch import settle, shared_folder

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")

DATE = "1970-01-01T00:00:00Z"
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 16 << 10
SAMPLE_BYTES = 1 << 20
LEVEL = 3
READ_BYTES = 1 << 20


class WarcError(ValueError):
    pass


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page: Any, url: str | None, payload: bytes, first: Any) -> bytes:
    """A response, or a revisit of page ``first`` where that is given. A null page or URL is left
    to the record's own name."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    name = "urn:page:" if page is None else f"urn:page:{page}"
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", f"<{_clean(name)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url if url is not None else name)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
    ]
    if first is not None:
        fields += [("WARC-Refers-To", f"<{_clean(f'urn:page:{first}')}>"), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict[str, Any]:
    """The checked fields of one record, by lower-case name, with ``block`` and ``payload``."""
    line, _, rest = data.partition(b"\r\n")
    if line != VERSION:
        raise WarcError(f"version line {line[:40]!r}")
    head, found, rest = rest.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("header without an end")
    out: dict[str, Any] = {}
    for part in head.split(b"\r\n"):
        name, colon, value = part.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"header line {part[:60]!r}")
        if name.lower() in out:
            raise WarcError(f"{name} twice")
        out[name.lower()] = value.strip()
    for name in NEEDED:
        if name not in out:
            raise WarcError(f"no {name}")
    if not out["content-length"].isdecimal():
        raise WarcError("Content-Length is no number")
    size = int(out["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("block length or record end")
    block = rest[:size]
    if out.get("warc-block-digest", f"sha1:{payload_digest(block)}") != f"sha1:{payload_digest(block)}":
        raise WarcError("block digest")
    out["block"] = block
    if out["warc-type"] in ("response", "revisit"):
        http, found, payload = block.partition(b"\r\n\r\n")
        told = re.search(rb"(?im)^content-length: *([0-9]+)\r?$", http)
        if not found or not http.startswith(b"HTTP/") or not told:
            raise WarcError("HTTP header")
        out["payload"], out["payload_bytes"] = payload, int(told[1])
        if out["warc-type"] == "response":
            if len(payload) != out["payload_bytes"] or out.get("warc-payload-digest") != f"sha1:{payload_digest(payload)}":
                raise WarcError("payload length or digest")
        elif payload or "warc-refers-to" not in out or "warc-payload-digest" not in out:
            raise WarcError("revisit with a payload, or without its reference")
    return out


class Archive:
    """Writes records to a stream; the first megabyte of them trains the dictionary."""

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.waiting, self.held = out, [], 0
        self.records = self.raw_bytes = self.bytes = 0
        self.packer = None

    def add(self, data: bytes) -> None:
        self.records += 1
        self.raw_bytes += len(data)
        if self.packer is not None:
            return self._put(self.packer.compress(data))
        self.waiting.append(data)
        self.held += len(data)
        if self.held >= SAMPLE_BYTES:
            self._start()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _start(self) -> None:
        import zstandard

        kept = None
        try:
            kept = zstandard.train_dictionary(DICTIONARY_BYTES, [x[:8192] for x in self.waiting], k=256, d=8)
        except zstandard.ZstdError:  # too few or too short to learn from
            pass
        if kept is not None:
            inside = zstandard.ZstdCompressor(level=LEVEL).compress(kept.as_bytes())
            self._put(struct.pack("<II", SKIPPABLE, len(inside)) + inside)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_checksum=True)
        for data in self.waiting:
            self._put(self.packer.compress(data))
        self.waiting = []

    def close(self) -> None:
        if self.packer is None:
            self._start()
        self.out.close()


def frames(source: BinaryIO) -> Iterator[bytes]:
    """The records of an archive, one from each frame; holds one record and a block of input."""
    import zstandard

    data = source.read(8)
    dictionary = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        (size,) = struct.unpack("<I", data[4:])
        inside = source.read(size)
        if len(inside) != size:
            raise WarcError("dictionary frame is cut short")
        if inside[:4] == ZSTD_MAGIC:
            inside = zstandard.ZstdDecompressor().decompress(inside)
        dictionary, data = zstandard.ZstdCompressionDict(inside), b""
    opener = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data or (data := source.read(READ_BYTES)):
        frame, parts = opener.decompressobj(), []
        try:
            while True:
                parts.append(frame.decompress(data))
                if frame.eof:
                    data = frame.unused_data
                    break
                data = source.read(READ_BYTES)
                if not data:
                    raise WarcError("last frame is cut short")
        except zstandard.ZstdError as e:
            raise WarcError(f"frame: {e}") from e
        yield b"".join(parts)


def _file_system(uri: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def marked(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` as (page, url, payload, first): ``first`` is the smallest id with an equal payload
    of ``least_bytes`` at least, null where the row is that one itself."""
    rows = pages.select(F.col("page_id").alias("page"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sum", F.sha2("payload", 256))
    shared = rows.where(F.length("payload") >= least_bytes).groupBy("sum").agg(F.min("page").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = rows.join(shared.select("sum", "least"), "sum", "left")
    first = F.when(~F.col("page").eqNullSafe(F.col("least")), F.col("least"))
    return joined.select("page", "url", "payload", first.alias("first"))


def write_archives(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``marked`` rows; returns the written list of archives (path, records, bytes)."""
    folder = folder or shared_folder(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, top = _file_system(folder)
        attempt, made, archive, path = TaskContext.get().taskAttemptId(), [], None, ""
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page", "url", "payload", "first")]
            for page, url, payload, first in zip(*columns):
                if archive is None:
                    files.create_dir(top, recursive=True)
                    path = f"task-{attempt:08d}-{len(made):05d}.warc.zst"
                    archive = Archive(files.open_output_stream(f"{top}/{path}", compression=None))
                archive.add(record(page, url, payload, first))
                if archive.raw_bytes >= ARCHIVE_BYTES:
                    archive.close()
                    made.append((path, archive.records, archive.bytes))
                    archive = None
        if archive is not None:
            archive.close()
            made.append((path, archive.records, archive.bytes))
        yield pa.record_batch([pa.array([f"{folder}/{m[0]}" for m in made], pa.string()), *(pa.array([m[k] for m in made], pa.int64()) for k in (1, 2))], names=["path", "records", "bytes"])

    return settle(rows.mapInArrow(run, "path string, records bigint, bytes bigint"))


def read_archives(archives: DataFrame, page_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """One row per response or revisit: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, and the payload itself if asked for. A record that fails a check ends the job."""
    n = max(1, archives.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, told in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                files, name = _file_system(path)
                seen, rows, held = 0, [], 0
                with files.open_input_stream(name, compression=None) as source:
                    for data in frames(source):
                        seen += 1
                        r = parse(data)
                        page = r["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
                        back = r.get("warc-refers-to", "<>").removeprefix("<urn:page:").removesuffix(">")
                        url = r.get("warc-target-uri")
                        rows.append((page or None, url, r["payload_bytes"], r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"], None if r["warc-type"] == "response" else back, r["payload"] if with_payload else None))
                        held += len(data)
                        if held > 4 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                if seen != told:
                    raise WarcError(f"{path}: {seen} records, {told} were written")
                yield _rows(rows)

    spread = archives.repartition(n, "path")
    ddl = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"
    found = spread.mapInArrow(run, ddl)
    found = found.withColumns({c: F.col(c).cast(page_type) for c in ("page_id", "refers_to")})
    return found if with_payload else found.drop("payload")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def round_trip(pages: DataFrame, least_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives and reads them back.

    Null html is an empty payload, a null url is replaced by the record's name, and a null page_id
    stays null and is never referred to while a number has the same payload. Rows that share both
    page_id and payload are each written as the response. An empty table writes no archive and
    gives no rows; other columns are not read."""
    page_type = pages.schema["page_id"].dataType.simpleString()
    return read_archives(write_archives(marked(pages, least_bytes)), page_type, with_payload)
