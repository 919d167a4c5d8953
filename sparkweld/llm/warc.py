"""Zstandard WARC archives: writer with payload deduplication, and a validating reader.

An archive begins with a skippable frame that holds its compression dictionary, then has one Zstandard frame a record.
The writer trains the dictionary of an archive on its own first records, at most ``TRAIN_BYTES`` of them, and begins
another archive once one has ``ARCHIVE_BYTES``, so that many tasks can read. Each task writes under a name of its own
attempt and renames when done; a repeated task writes the same bytes under the same final name.

The reader streams an archive of any size, a piece at a time, and holds one record; a frame that decodes to over
``RECORD_BYTES`` is an error. It decodes a frame at a time and checks the version line, the mandatory headers, that the frame holds exactly
the header, ``Content-Length`` bytes and the record's end, the HTTP body's length and the payload's digest.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes that with the smallest id is written as response and
the others as revisits that refer to it. Defined cases: a null payload is the empty one; smaller payloads are all
responses; rows that repeat the smallest id are all responses; a row without an id revisits if any row with one has its
payload; an empty table gives no archive; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweld.llm.common import salted_join, save, session, shared_dir, slices, table

REVISIT_BYTES = 100
ARCHIVE_BYTES = 8 << 20
TRAIN_BYTES, DICTIONARY_BYTES = 512 << 10, 16 << 10
#: The longest record and dictionary that are read, and bytes that are read and decoded at once: 4 KB decode to 128 MB at most.
RECORD_BYTES, DICTIONARY_MOST, READ_BYTES, PIECE = 512 << 20, 16 << 20, 1 << 20, 4 << 10
DATE = "2000-01-01T00:00:00Z"
DICTIONARY_MAGIC, ZSTD_MAGIC = 0x184D2A5D, 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int, date: str = DATE) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) keeps the HTTP header and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % size + _END
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def dictionary(samples: list[bytes]) -> bytes | None:
    """A trained dictionary, or none where the samples are too few or too alike to train one."""
    if len(samples) < 16:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes], trained: bytes | None, level: int = 3) -> Iterator[bytes]:
    """The archive's parts: the dictionary's frame, if there is one, and a frame for each record."""
    if trained is not None:
        yield struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained
    c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True)
    for r in records:
        yield c.compress(r)


class ArchiveError(ValueError):
    """An archive or record that isn't valid, with its offset."""


class _Source:
    """A file that is read in pieces, with the offset of what comes next."""

    def __init__(self, file) -> None:
        self.file, self.held, self.at = file, b"", 0

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end."""
        while len(self.held) < n and (more := self.file.read(max(READ_BYTES, n - len(self.held)))):
            self.held += more
        out, self.held = self.held[:n], self.held[n:]
        self.at += len(out)
        return out

    def back(self, unused: bytes) -> None:
        self.held, self.at = unused + self.held, self.at - len(unused)


def frames(data) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each record's frame of an archive, given as bytes or as an open file."""
    source, trained = _Source(io.BytesIO(data) if isinstance(data, (bytes, bytearray, memoryview)) else data), None
    while head := source.take(8):
        at = source.at - len(head)
        if len(head) < 8:
            raise ArchiveError(f"offset {at}: the archive ends inside a frame header")
        magic, size = struct.unpack("<II", head)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic != DICTIONARY_MAGIC:
                left = size
                while left and (some := source.take(min(left, READ_BYTES))):
                    left -= len(some)
                if left:
                    raise ArchiveError(f"offset {at}: the archive ends inside a skippable frame")
                continue
            if at or size > DICTIONARY_MOST:
                raise ArchiveError(f"offset {at}: a dictionary frame that isn't the first" if at else f"offset 0: a dictionary of {size} bytes")
            body = source.take(size)
            if len(body) != size:
                raise ArchiveError(f"offset {at}: the archive ends inside a skippable frame")
            if body[:4] == struct.pack("<I", ZSTD_MAGIC):
                body = _decode(_Source(io.BytesIO(body)), None, 0, DICTIONARY_MOST)
            trained = zstandard.ZstdCompressionDict(body)
            continue
        if magic != ZSTD_MAGIC:
            raise ArchiveError(f"offset {at}: no Zstandard frame")
        source.back(head)
        yield at, _decode(source, trained, at, RECORD_BYTES)


def _decode(source: _Source, trained, at: int, most: int) -> bytes:
    d, out, size = zstandard.ZstdDecompressor(dict_data=trained).decompressobj(), [], 0
    try:
        while not d.eof:
            if not (some := source.take(PIECE)):
                raise ArchiveError(f"offset {at}: the archive ends inside a frame")
            out.append(d.decompress(some))
            size += len(out[-1])
            if size > most:
                raise ArchiveError(f"offset {at}: a frame that decodes to over {most} bytes")
    except zstandard.ZstdError as e:
        raise ArchiveError(f"offset {at}: {e}") from e
    source.back(d.unused_data)
    return b"".join(out)


def _headers(lines: list[bytes], at: int) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ArchiveError(f"offset {at}: no header: {line[:80]!r}")
        out.setdefault(name.strip().lower().decode("ascii", "replace"), value.strip().decode("utf-8", "replace"))
    return out


def parse(data: bytes, at: int = 0) -> dict:
    """A record's fields, validated. ``payload`` is None for a revisit."""
    head, sep, rest = data.partition(_END)
    lines = head.split(b"\r\n")
    if not sep or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ArchiveError(f"offset {at}: no WARC/1 record")
    h = _headers(lines[1:], at)
    if lack := [n for n in ("warc-type", "warc-record-id", "warc-date", "content-length") if n not in h]:
        raise ArchiveError(f"offset {at}: lacks {', '.join(lack)}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + len(_END) or not rest.endswith(_END):
        raise ArchiveError(f"offset {at}: the block isn't of Content-Length {h['content-length']}")
    out = {"record_id": h["warc-record-id"], "record_type": h["warc-type"], "date": h["warc-date"], "uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"), "payload_digest": None, "payload_bytes": None, "payload": None}
    stated = h.get("warc-payload-digest", "")
    block = rest[: -len(_END)]
    if not h.get("content-type", "").startswith("application/http"):
        return out | {"payload": block, "payload_bytes": len(block), "payload_digest": hashlib.sha256(block).hexdigest()}
    http, sep, body = block.partition(_END)
    if not sep or not http.startswith(b"HTTP/"):
        raise ArchiveError(f"offset {at}: no HTTP header")
    size = _headers(http.split(b"\r\n")[1:], at).get("content-length")
    if out["record_type"] == "revisit":
        if not out["refers_to"] or not stated.startswith("sha256:"):
            raise ArchiveError(f"offset {at}: a revisit without target or digest")
        return out | {"payload_digest": stated.partition(":")[2], "payload_bytes": int(size) if size else None}
    if size is not None and int(size) != len(body):
        raise ArchiveError(f"offset {at}: the HTTP body isn't of Content-Length {size}")
    digest = hashlib.sha256(body).hexdigest()
    if stated.startswith("sha256:") and stated != f"sha256:{digest}":
        raise ArchiveError(f"offset {at}: the payload's digest differs")
    return out | {"payload": body, "payload_bytes": len(body), "payload_digest": digest}


def decide(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html, digest, bytes, refers_to)``: each page with the response that it revisits, if any."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    found = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    out = salted_join(rows, save(found, "payloads"), ["digest"], ["page_id"], 16, "left")
    own = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "html", "digest", "bytes", F.when(~own, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages as archives under ``folder`` (a URI all executors reach); returns ``(path, records, bytes)``."""
    session(pages.sparkSession)

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = pa.fs.FileSystem.from_uri(folder)
        part, number, done = TaskContext.get().partitionId(), 0, []
        sink = compressor = temp = None
        waiting: list[bytes] = []
        size = count = held = 0

        def flush() -> None:
            nonlocal sink, compressor, temp, size, waiting, held
            if sink is None:
                temp = f"{base}/_attempts/{uuid.uuid4().hex}"
                sink = fs.open_output_stream(temp)
                trained = dictionary([r[:65536] for r in waiting])
                if trained is not None:
                    sink.write(struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained)
                compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True)
            for r in waiting:
                frame = compressor.compress(r)
                sink.write(frame)
                size += len(frame)
            waiting, held = [], 0

        def close() -> None:
            nonlocal sink, number, size, count
            sink.close()
            final = f"{base}/archives/part-{part:06d}-{number:05d}.warc.zst"
            if fs.get_file_info(final).type != pa.fs.FileType.NotFound:
                fs.delete_file(final)
            fs.move(temp, final)
            done.append((final, count, size))
            sink, number, size, count = None, number + 1, 0, 0

        for rows, texts in slices(batches, "html"):
            ids, urls, digests, refers = (rows.column(i).to_pylist() for i in (0, 1, 3, 5))
            for page_id, url, html, digest, ref in zip(ids, urls, texts, digests, refers):
                r = record(page_id, url, html, digest, ref, len(html))
                waiting.append(r)
                held += len(r)
                count += 1
                if held >= TRAIN_BYTES:
                    flush()
                    if size >= ARCHIVE_BYTES:
                        close()
        if waiting:
            flush()
        if sink is not None:
            close()
        if done:
            a, b, c = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["path", "records", "bytes"])

    fs, base = pa.fs.FileSystem.from_uri(folder)
    for d in ("archives", "_attempts"):
        fs.create_dir(f"{base}/{d}", recursive=True)
    rows = decide(pages).sortWithinPartitions("page_id", "digest", "url")
    out = save(rows.mapInArrow(put, "path string, records long, bytes long"), "manifest")
    fs.delete_dir(f"{base}/_attempts")
    return out


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of all ``*.warc.zst`` under ``folder``, one row each with the archive's path and the frame's offset."""
    session(spark)
    schema = "record_id string, record_type string, date string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, path string, offset long"
    kind = pa.schema([*((n, pa.string()) for n in ("record_id", "record_type", "date", "uri", "refers_to", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])

    def get(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, inside = pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                out, size = [], 0
                with fs.open_input_stream(inside, compression=None) as f:
                    for at, content in frames(f):
                        try:
                            r = parse(content, at)
                        except ArchiveError as e:
                            raise ArchiveError(f"{path}: {e}") from e
                        if not payload:
                            r["payload"] = None
                        out.append(r | {"path": path, "offset": at})
                        size += len(r["payload"] or b"") + 500
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, kind)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, kind)

    # names and lengths alone: contents are streamed by the tasks
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", "length").mapInArrow(get, schema)


ORACLE = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND n >= 100
"""


def query(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), folder)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read(spark, f"{folder}/archives", payload=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
