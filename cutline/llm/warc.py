"""WARC archives compressed with Zstandard (.warc.zst).

An archive begins with a skippable frame that holds a dictionary; then every record is a frame of its
own, compressed with that dictionary, so that records can be read singly. The reader loads the
dictionary, decodes one frame at a time and checks each record: version line, required headers, the
block's length against Content-Length, the record's end, and the digests of block and payload.

Records of equal payload are stored once: the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, new_dir, small

#: Fixed values of the formats.
VERSION = b"WARC/1.1"
DICTIONARY_FRAME = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length")

#: Bytes of records that a dictionary is trained on, of the dictionary, and of an archive (before it is followed by another).
SAMPLE, DICTIONARY, ARCHIVE = 2 << 20, 32 << 10, 256 << 20


class WarcError(ValueError):
    """An archive or record that is not well formed."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, headers: dict[str, str | None], block: bytes) -> bytes:
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", **headers, "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in lines.items() if v is not None)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: object, url: str | None, payload: bytes, refers_to: object, date: str) -> bytes:
    """A response record, or a revisit record (HTTP headers only) where refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else None
    headers = {"WARC-Date": date, "WARC-Target-URI": target, "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    if refers_to is None:
        return record("response", f"urn:page:{page_id}", headers, http + payload)
    return record("revisit", f"urn:page:{page_id}", headers | {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": REVISIT_PROFILE}, http)


class ArchiveWriter:
    """Writes records, each a frame, after the dictionary that the first of them give."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.level, self.held, self.size, self.written, self.compressor = sink, level, [], 0, 0, None

    def add(self, data: bytes) -> None:
        if self.compressor:
            self._frame(data)
            return
        self.held.append(data)
        self.size += len(data)
        if self.size >= SAMPLE:
            self._begin()

    def _begin(self) -> None:
        try:
            trained = zstandard.train_dictionary(DICTIONARY, self.held).as_bytes()
        except zstandard.ZstdError:  # too few records to train on: their first bytes serve as they are
            trained = b"".join(self.held)[:DICTIONARY] or VERSION
        self.sink.write(struct.pack("<II", DICTIONARY_FRAME, len(trained)) + trained)
        self.written += 8 + len(trained)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=True, write_checksum=True)
        for x in self.held:
            self._frame(x)
        self.held = []

    def _frame(self, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.sink.write(frame)
        self.written += len(frame)

    def close(self) -> None:
        if not self.compressor:
            self._begin()
        self.sink.close()


def frames(source, chunk: int = 1 << 18) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the data frames of an open archive, one at a time."""
    held, base = source.read(chunk), 0
    dictionary = None
    if len(held) >= 8 and struct.unpack("<I", held[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", held[4:8])[0]
        while len(held) < 8 + size:
            more = source.read(chunk)
            if not more:
                raise WarcError("the dictionary frame is cut short")
            held += more
        content, held, base = held[8 : 8 + size], held[8 + size :], 8 + size
        if content[:4] == FRAME:
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        dictionary = zstandard.ZstdCompressionDict(content)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        held = held or source.read(chunk)
        if not held:
            return
        one, out, used = decompressor.decompressobj(), [], 0
        try:
            while True:
                out.append(one.decompress(held))
                used += len(held) - len(one.unused_data)
                if one.eof:
                    held = one.unused_data
                    break
                held = source.read(chunk)
                if not held:
                    raise WarcError(f"the frame at {base} is cut short")
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at {base}: {e}") from e
        yield base, b"".join(out)
        base += used


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of a record; WarcError if it is not well formed."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/1."):
        raise WarcError("no version line or no end of the headers")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name.strip():
            raise WarcError(f"not a header: {line[:80]!r}")
        headers[name.strip()] = value.strip()
    if missing := [x for x in REQUIRED if x not in headers]:
        raise WarcError(f"no {', '.join(missing)}")
    if not headers["Content-Length"].isdecimal():
        raise WarcError("Content-Length is not a number")
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}, but the block and its end have {len(rest)} bytes")
    block = rest[:n]
    if headers.get("WARC-Block-Digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
        raise WarcError("the block does not have its digest")
    return headers, block


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes | None, int, str | None]:
    """The payload (None: not stored here), its length and its digest, checked against the headers."""
    said = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    if not headers.get("Content-Type", "").startswith("application/http"):
        return block, len(block), said or digest(block)
    http, mark, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if not mark:
        raise WarcError("the HTTP headers do not end")
    if headers["WARC-Type"] == "revisit":
        return None, length or 0, said
    if length is not None and length != len(payload):
        raise WarcError(f"the HTTP length is {length}, but the payload has {len(payload)} bytes")
    if said and said != digest(payload):
        raise WarcError("the payload does not have its digest")
    return payload, len(payload), said or digest(payload)


def write_warc(pages: DataFrame, path: str | None = None, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one record per row; return the manifest (path, records), one row per archive.

    Of rows whose payloads (html in UTF-8; null: empty) are equal (by SHA-256 and length; SHA-1, which the archives state, has known collisions) and have at least min_bytes, those
    with the largest page_id become response records and the others revisits of it (null ids too; if
    all are null, responses); smaller payloads are all responses. path: a folder that driver and
    executors share (by default a new one in the shared folder). A null url is left out. Each task
    writes archives under names of its own; only finished ones are in the manifest. An empty table
    writes none. Other columns are not read.
    """
    path = path or new_dir(pages.sparkSession, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    keyed = rows.withColumns({"sha": F.sha2("payload", 256), "n": F.octet_length("payload")})
    groups = cut(keyed.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.count("*").alias("copies"), F.max("page_id").alias("kept")).where("copies > 1").drop("copies"))
    rows = keyed.join(small(groups, groups.count()), ["sha", "n"], "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        writer, names, counts = None, [], []
        for batch in batches:
            for page, link, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if writer is None or writer.written > ARCHIVE:
                    if writer:
                        writer.close()
                    names.append(f"{uuid.uuid4().hex}.warc.zst")
                    counts.append(0)
                    writer = ArchiveWriter(fs.open_output_stream(f"{root}/{names[-1]}", compression=None))
                    writer.add(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", {"WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                writer.add(page_record(page, link, payload, refers, date))
                counts[-1] += 1
        if writer:
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{n}" for n in names], pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return cut(rows.mapInArrow(run, "path string, records long"))


RECORDS = "path string, position long, record_type string, record_id string, target_uri string, date string, refers_to_id string, payload_digest string, payload_bytes long, payload binary"


def read_warc(archives: DataFrame) -> DataFrame:
    """The response and revisit records of the archives named in column path (see RECORDS).

    payload is null for revisits; payload_bytes and payload_digest are those of the full payload. A
    malformed archive or record fails the job with WarcError. No archives give no rows.
    """
    spark = archives.sparkSession
    tasks = max(1, spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(x.split() for x in RECORDS.split(", ")), strict=True)
        types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k] for k in kinds]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], list(names))

        for paths in batches:
            for path in paths.column("path").to_pylist():
                fs, at = pa.fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with fs.open_input_stream(at, compression=None) as source:
                    for offset, data in frames(source):
                        headers, block = parse(data)
                        if headers["WARC-Type"] not in ("response", "revisit"):
                            continue
                        payload, n, sha = payload_of(headers, block)
                        bare = lambda x: x and x.strip("<>")
                        rows.append((path, offset, headers["WARC-Type"], bare(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Date"], bare(headers.get("WARC-Refers-To")), sha, n, payload))
                        size += len(data)
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                yield batch(rows)

    return archives.select("path").repartition(tasks).mapInArrow(run, RECORDS)
