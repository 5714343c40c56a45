"""Web archives: one gzip member per record, written by tasks and read back sequentially.

A record is a response (HTTP headers and payload) or a revisit, which names the response with the
same payload and carries the headers only.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut

#: a new archive file is begun beyond this size
FILE_BYTES = 1_000_000_000
#: payloads below this are always stored
REVISIT_BYTES = 1000
_CHUNK = 1 << 16


class DamagedArchive(ValueError):
    """An archive breaks the framing or a digest."""


def label(digest: bytes) -> str:
    """A SHA-1 digest as written in record headers."""
    return "sha1:" + base64.b32encode(digest).decode()


def _clean(value: object) -> str:
    """A header value: control characters percent-encoded, null empty."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value if value is not None else ""))


def member(kind: str, number: int | None, url: str | None, payload: bytes | None, digest: bytes, refers_to: int | None,
           date: str, level: int) -> bytes:
    """One record as a gzip member; ``payload`` is None for a revisit."""
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if number is None else number}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url)}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {label(digest)}", f"WARC-Block-Digest: {label(hashlib.sha1(block).digest())}",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return squeeze.compress(head) + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of every page: of equal payloads of at least
    ``least`` bytes the largest key is stored, the others refer to it.

    Null html is an empty payload, a null url stays null. A null key is never the largest; where
    all keys of a payload are null, each is stored. Rows that repeat key and payload are all
    stored, as none is larger. Other columns are ignored; no rows give no rows. Only payloads that occur more than once take part in the join, whose right side has one row
    per payload; a payload that a third of the pages share is split by the adaptive skew join.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    sizes = pages.select(F.col(key).cast("long").alias("page_id"), F.sha1(body).alias("d"), F.octet_length(body).alias("n"))
    shared = sizes.filter(F.col("n") >= least).groupBy("d").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("c"))
    joined = rows.join(shared.filter("c > 1 and first is not null").drop("c"), F.col("digest") == F.col("d"), "left")
    same = F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return joined.select("page_id", "url", "payload", "digest", F.when(~same, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", level: int = 4, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, digest, refers_to) below ``path`` and return the finished
    files (file, records).

    Each task streams records into files named after itself and this attempt, so a repeated or
    speculative attempt never touches another's file; only files of the attempt that succeeded
    are listed, and readers go by the list. ``path`` is any URI that pyarrow can open.
    """
    schema = pa.schema([("file", pa.string()), ("records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        done: list[tuple[str, int]] = []
        out, count, size = None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):  # one payload at a time
                number, url, payload, digest, first = (batch.column(c)[i].as_py() for c in range(5))
                if out is None or size >= file_bytes:
                    if out is not None:
                        out.close()
                        done[-1] = (done[-1][0], count)
                    file = posixpath.join(root, f"{name}-{len(done):05d}.warc.gz")
                    out, count, size = store.open_output_stream(file, compression=None), 0, 0
                    done.append((posixpath.join(path, posixpath.basename(file)), 0))
                kind = "response" if first is None else "revisit"
                data = member(kind, number, url, payload if first is None else None, bytes.fromhex(digest), first, date, level)
                out.write(data)
                count, size = count + 1, size + len(data)
        if out is not None:
            out.close()
            done[-1] = (done[-1][0], count)
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], schema=schema)

    slim = records.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    return cut(slim.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "file string, records long"))


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(file) of every archive below ``path``, by Spark's own listing; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(path)
    return found.select(F.col("path").alias("file"))


@dataclass
class Record:
    """One record as framed in the archive; ``payload`` only if it was asked for."""

    headers: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0
    payload_digest: bytes = b""
    payload: bytes | None = None


def read_records(stream, keep_payload: bool = False) -> Iterator[Record]:
    """Records of one archive: the stream is read in pieces and inflated incrementally; a
    record's extent comes from Content-Length and must end with its gzip member; block and
    payload digests must hold. Anything else raises ``DamagedArchive``."""
    raw, ended = b"", False

    def more() -> bytes:
        nonlocal raw, ended
        if not raw and not ended:
            raw = stream.read(_CHUNK)
            ended = not raw
        return raw

    while more():
        inflate = zlib.decompressobj(31)
        held = bytearray()

        def fill(held=held, inflate=inflate) -> bool:
            nonlocal raw
            while not inflate.eof:
                source = inflate.unconsumed_tail or more()
                if not source:
                    raise DamagedArchive("the archive ends inside a record")
                if not inflate.unconsumed_tail:
                    raw = b""
                try:
                    got = inflate.decompress(source, _CHUNK)
                except zlib.error as e:
                    raise DamagedArchive(str(e)) from e
                if inflate.eof:
                    raw = inflate.unused_data or raw
                held.extend(got)
                if got:
                    return True
            return False

        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill():
                raise DamagedArchive("a record has no end of headers")
        version, *lines = bytes(held[:end]).decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise DamagedArchive(f"not a record: {version[:40]}")
        record = Record(dict(line.split(": ", 1) for line in lines))
        del held[: end + 4]
        left = int(record.headers["Content-Length"])
        block, payload, http, parts = hashlib.sha1(), hashlib.sha1(), bytearray(), []
        inside = False
        while left:
            if not held and not fill():
                raise DamagedArchive("a block is shorter than its Content-Length")
            piece = bytes(held[:left])
            del held[: len(piece)]
            left -= len(piece)
            block.update(piece)
            if not inside:
                http += piece
                if (end := http.find(b"\r\n\r\n")) < 0:
                    continue
                piece, inside = bytes(http[end + 4 :]), True
            payload.update(piece)
            record.payload_bytes += len(piece)
            if keep_payload:
                parts.append(piece)
        while fill():
            pass
        if bytes(held) != b"\r\n\r\n":
            raise DamagedArchive("a record does not end where its Content-Length says")
        if label(block.digest()) != record.headers.get("WARC-Block-Digest"):
            raise DamagedArchive("a block does not match its digest")
        record.payload_digest = payload.digest()
        if record.headers.get("WARC-Type") != "revisit" and label(record.payload_digest) != record.headers.get("WARC-Payload-Digest"):
            raise DamagedArchive("a payload does not match its digest")
        record.payload = b"".join(parts) if keep_payload else None
        yield record


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_archives(files: DataFrame, keep_payload: bool = False) -> DataFrame:
    """(page_id, url, record_type, refers_to, digest, payload_bytes, payload) of every record of
    ``files`` (file); ``digest`` is the header's, in hex. A revisit has no payload of its own
    (0 bytes). A file is read by one task from start to end, in bounded memory."""
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ])

    def rows(file: str) -> Iterator[tuple]:
        store, name = fs.FileSystem.from_uri(file)
        with store.open_input_stream(name, compression=None) as stream:
            for r in read_records(stream, keep_payload):
                h = r.headers
                digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                yield (_number(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"], _number(h.get("WARC-Refers-To")), digest, r.payload_bytes, r.payload)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(file):
                    held.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    ddl = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary"
    n = max(1, min(files.count(), 100_000))
    return files.select("file").repartition(n).mapInArrow(read, ddl)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): a revisit takes the
    length of the response it refers to, found by id and digest (null if that is missing). Null
    ids and digests find nothing; repeated responses count once for that, and every record gives
    one row; no records give none."""
    slim = records.drop("payload", "url")
    stored = slim.filter("record_type = 'response'").groupBy(F.col("page_id").alias("_id"), F.col("digest").alias("_d")).agg(
        F.max("payload_bytes").alias("_bytes")
    )
    wanted = slim.filter("record_type = 'revisit'").join(
        stored, (F.col("refers_to") == F.col("_id")) & (F.col("digest") == F.col("_d")), "left"
    )
    wanted = wanted.withColumn("payload_bytes", F.col("_bytes")).select(*slim.columns)
    every = slim.filter("record_type <> 'revisit'").unionByName(wanted)
    return every.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
