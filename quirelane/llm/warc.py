"""WARC archives: a writer with revisit records, and a sequential reader.

Writer: one gzip member per record. Each task writes archives of bounded size under names of its own attempt and returns
their places as rows, so a lost or repeated task leaves at most an orphan that no manifest names.

Reader: archives are streamed in blocks; members are inflated incrementally; records are framed by Content-Length; block
and payload digests are verified. A task holds one block of input and one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelane.llm.common import as_bytes
from quirelane.session import cut

VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 64 << 20
#: Size at which archives end that are kept as rows, for folders that only Spark can open.
INLINE_BYTES = 16 << 20
READ_BYTES = 256 << 10
#: Archives that a reading task takes by their size; an archive is read from its start, so it stays with one task.
TASK_BYTES = 256 << 20
LEVEL = 4
READ_SCHEMA = "archive string, record_id string, record_type string, target_uri string, refers_to_id string, payload_bytes long, payload_digest string, payload binary, verified boolean, problem string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    problem: str | None = None


def write_record(headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """A record as one gzip member. Line breaks within a value become spaces, so a value can't end its header."""
    lines = [VERSION, *(k + b": " + b" ".join(v.split(b"\n")).replace(b"\r", b" ") for k, v in headers), b"Content-Length: %d" % len(block)]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(lines) + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def read_records(chunks: Iterable[bytes]) -> Iterator[Record]:
    """Records of a .warc.gz (or plain .warc) given as blocks of any size.

    A damaged or truncated archive gives a last record with a problem instead of an exception.
    """
    buffer = bytearray()
    headers: dict[str, str] | None = None
    need = 0
    try:
        for part in _inflate(chunks):
            buffer += part
            while True:
                if headers is None:
                    while buffer[:2] == b"\r\n":
                        del buffer[:2]
                    end = buffer.find(b"\r\n\r\n")
                    if end < 0:
                        break
                    headers = _headers(bytes(buffer[:end]))
                    del buffer[: end + 4]
                    need = int(headers["content-length"])
                if len(buffer) < need + 4:
                    break
                block, mark = bytes(buffer[:need]), bytes(buffer[need : need + 4])
                del buffer[: need + 4]
                yield Record(headers, block, None if mark == b"\r\n\r\n" else "no record end")
                headers = None
    except (zlib.error, ValueError, KeyError) as error:
        yield Record(headers or {}, b"", f"damaged: {error}")
        return
    if headers is not None or bytes(buffer).strip():
        yield Record(headers or {}, bytes(buffer), "truncated")


def _inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Decompressed pieces of at most READ_BYTES; plain input goes through as it is."""
    z, plain = None, None
    for chunk in chunks:
        if plain is None and chunk:
            plain = chunk[:1] != b"\x1f"
        if plain:
            yield chunk
            continue
        while chunk:
            z = z or zlib.decompressobj(31)
            yield z.decompress(chunk, READ_BYTES)
            chunk = z.unconsumed_tail
            if z.eof:
                chunk, z = z.unused_data, None
    if z is not None:
        raise ValueError("the last member has no end")


def _headers(data: bytes) -> dict[str, str]:
    first, *lines = data.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC version line")
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, body = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("latin-1")
    return fields, body if gap else b""


def _page_record(page_id, url: bytes | None, payload: bytes, refers_to) -> bytes:
    name = lambda i: b"<urn:page:%s>" % (b"none" if i is None else b"%d" % i)
    digest = base32_sha1(payload).encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    headers = [
        (b"WARC-Type", b"revisit" if revisit else b"response"),
        (b"WARC-Record-ID", name(page_id)),
        (b"WARC-Date", b"1970-01-01T00:00:00Z"),
        (b"WARC-Target-URI", url or b""),
        (b"Content-Type", b"application/http; msgtype=response"),
        (b"WARC-Payload-Digest", b"sha1:" + digest),
        (b"WARC-Block-Digest", b"sha1:" + base32_sha1(block).encode()),
    ]
    if revisit:
        headers += [(b"WARC-Profile", PROFILE), (b"WARC-Refers-To", name(refers_to))]
    return write_record(headers, block)


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/", 1)[0] else (fs.LocalFileSystem(), uri)


def opens(uri: str) -> bool:
    """Whether tasks can open a folder themselves; else archives are kept as rows of the manifest."""
    try:
        _filesystem(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return False
    return True


def mark_revisits(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``: of pages with equal payloads of ``min_bytes`` or more, the smallest page_id; null for that page.

    Only digests that repeat are joined back; a digest shared by very many pages is a hot key on the side that adaptive
    execution splits, with one row on the other.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marked = pages.select("page_id", "url", "html", F.unhex(F.sha1(payload)).alias("_sha1"))
    size = F.octet_length(payload)
    seen = pages.where(size >= min_bytes).groupBy(F.unhex(F.sha1(payload)).alias("_key"))
    firsts = seen.agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_key", "_first")
    out = marked.join(cut(firsts), F.col("_sha1") == F.col("_key"), "left")
    return out.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, *, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) under ``folder``; (archive, records, bytes) per archive.

    ``folder`` is a path or URI that all executors share. Where it is one that only Spark can open, nothing is written
    there, and the manifest holds the archives themselves, of bounded size, in a further column. The payload is the html in UTF-8, empty where html is null.
    Pages with equal payloads of ``min_bytes`` or more: that with the smallest page_id is the response, the others
    revisit it; a page without an id revisits one that has an id; repeated rows of the smallest id are all responses.
    The manifest is materialised before it is returned: later reads need no second write.
    """

    inline = not opens(folder)
    limit = min(archive_bytes, INLINE_BYTES) if inline else archive_bytes

    def row(place: str, n: int, done: int, out) -> pa.RecordBatch:
        content = {"content": pa.array([out.getvalue()], pa.binary())} if inline else {}
        out.close()
        return pa.RecordBatch.from_pydict({"archive": [place], "records": [n], "bytes": [done]} | content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, done, n = None, "", 0, 0
        for b in batches:
            ids, refs = b.column(0).to_pylist(), b.column(3).to_pylist()
            for i, url, html, ref in zip(ids, as_bytes(b.column(1)), as_bytes(b.column(2)), refs, strict=True):
                if out is None:
                    place, done, n = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    if inline:
                        out = io.BytesIO()
                    else:
                        store, path = _filesystem(place)
                        store.create_dir(path.rsplit("/", 1)[0])
                        out = store.open_output_stream(path, compression=None)
                record = _page_record(i, url, html or b"", ref)
                out.write(record)
                done, n = done + len(record), n + 1
                if done >= limit:
                    yield row(place, n, done, out)
                    out = None
        if out is not None:
            yield row(place, n, done, out)

    rows = mark_revisits(pages, min_bytes=min_bytes)
    return cut(rows.mapInArrow(run, "archive string, records long, bytes long" + ", content binary" * inline))


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, bytes) of the .warc and .warc.gz files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.col("path").rlike(r"\.warc(\.gz)?$")).select(F.col("path").alias("archive"), F.col("length").alias("bytes"))


def read_archives(archives: DataFrame, *, payloads: bool = True) -> DataFrame:
    """A row per record of the archives that column ``archive`` names, or column ``content`` holds, with digests checked.

    Payload figures of a revisit are those of the payload that it stands for. ``verified`` is false where a digest
    differs, and ``problem`` says what is wrong with a record that can't be read. Archives are dealt out evenly, one to a
    task while they are few, and about TASK_BYTES of them where they are many.
    """

    inline = "content" in archives.columns

    def one(place: str, content: bytes | None) -> Iterator[tuple]:
        if content is not None:
            opened = io.BytesIO(content)
        else:
            store, path = _filesystem(place)
            opened = store.open_input_stream(path, compression=None)
        with opened as f:
            for r in read_records(iter(lambda: f.read(READ_BYTES), b"")):
                h, kind = r.headers, r.headers.get("warc-type", "")
                http, body = _http(r.block) if h.get("content-type", "").startswith("application/http") else ({}, r.block)
                ok = r.problem is None
                if block := h.get("warc-block-digest", ""):
                    ok &= block == "sha1:" + base32_sha1(r.block)
                said = h.get("warc-payload-digest", "").removeprefix("sha1:")
                if kind == "revisit":
                    digest, size = said, int(http.get("content-length", 0))
                else:
                    digest, size = base32_sha1(body), len(body)
                    ok &= not said or said == digest
                yield place, h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-refers-to"), size, digest, body if payloads and kind != "revisit" else None, ok, r.problem

    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, place in enumerate(b.column(0).to_pylist()):
                rows, held = [], 0
                for row in one(place, b.column(1)[i].as_py() if inline else None):
                    rows.append(row)
                    held += len(row[7] or b"")
                    if held >= 8 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    archives = cut(archives.select("archive", *["content"] * inline, F.col("bytes") if "bytes" in archives.columns else F.lit(ARCHIVE_BYTES).cast("long").alias("bytes")))
    there = archives.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    tasks = min(there["n"], max(4 * archives.sparkSession.sparkContext.defaultParallelism, -(-(there["bytes"] or 0) // TASK_BYTES)))
    return archives.repartition(max(tasks, 1)).select("archive", *["content"] * inline).mapInArrow(run, READ_SCHEMA)
