"""WARC archives: one gzip member for each record, written from rows and read back record by record."""

from __future__ import annotations

import base64
import binascii
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spill, table, take_over

CRLF = b"\r\n"
#: Payloads below so many bytes are never revisits.
LEAST_REVISIT = 100
#: Compressed bytes after which a writer begins another archive.
ARCHIVE_BYTES = 8 << 20
_ID = "urn:x-page:"


class WarcError(ValueError):
    """A record that breaks the format, or whose digest does not fit its content."""


@dataclass
class Record:
    """A record; ``digest`` is the payload's SHA-256. A revisit has no payload, and the digest and length that it names."""

    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes
    digest: str | None
    length: int | None

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    @property
    def id(self) -> str | None:
        return self.headers.get("warc-record-id", "").strip("<>") or None

    @property
    def refers_to(self) -> str | None:
        return self.headers.get("warc-refers-to", "").strip("<>") or None


def write_record(kind: str, page: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> bytes:
    """One record as one gzip member. A revisit has the HTTP headers of the full payload, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{page}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + quote(uri, safe="".join(map(chr, range(33, 127)))))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines += [
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(lines).encode() + CRLF + CRLF + block + CRLF + CRLF) + gz.flush()


def write_info(name: str, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> bytes:
    """The record that an archive begins with."""
    block = b"software: auralake\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:x-archive:{quote(name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(lines).encode() + CRLF + CRLF + block + CRLF + CRLF) + gz.flush()


def _headers(lines: bytes) -> dict[str, str]:
    found = {}
    for line in lines.split(CRLF):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise WarcError(f"not a header: {line[:80]!r}")
        found[name.strip().lower()] = value.strip()
    return found


def _check(said: str | None, content: bytes, what: str, name: str | None) -> str:
    """The content's SHA-256, after comparing it with a digest in hexadecimal or base 32; algorithms other than SHA-1, SHA-256 and MD5 are not compared."""
    digest = hashlib.sha256(content)
    algorithm, _, value = (said or "").partition(":")
    algorithm = algorithm.lower().replace("-", "")
    if algorithm in ("sha256", "sha1", "md5"):
        own = digest if algorithm == "sha256" else hashlib.new(algorithm, content)
        if value.lower() != own.hexdigest() and value.upper().rstrip("=") != base64.b32encode(own.digest()).decode().rstrip("="):
            raise WarcError(f"{name}: the {what}'s digest differs")
    return digest.hexdigest()


def _sha256(said: str | None) -> str | None:
    """The hexadecimal form of a SHA-256 that a header names, if it is one."""
    algorithm, _, value = (said or "").partition(":")
    if algorithm.lower().replace("-", "") != "sha256":
        return None
    if len(value) == 64:
        return value.lower()
    try:
        return base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
    except binascii.Error:
        return None


def _unchunked(body: bytes, name: str | None) -> bytes:
    """The content of a body in HTTP's chunked form."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        try:
            n = int(body[at:end].partition(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            n = -1
        if n < 0 or end + 2 + n > len(body):
            raise WarcError(f"{name}: a broken chunk at byte {at}")
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def parse_record(data: bytes) -> Record:
    """One decompressed member: version line, headers, as many bytes as Content-Length says, two line ends; digests must fit.

    Any record type is taken. A response's payload is what follows its HTTP headers, measured and not as they say; a digest may be
    of the payload as it was sent or, of a chunked one, of its content. Whatever breaks the format is a WarcError.
    """
    head, cut, rest = data.partition(CRLF + CRLF)
    version, _, fields = head.partition(CRLF)
    if not cut or not version.startswith(b"WARC/"):
        raise WarcError(f"not a record: {data[:40]!r}")
    headers = _headers(fields)
    name = headers.get("warc-record-id")
    if "warc-type" not in headers or not headers.get("content-length", "").isdecimal():
        raise WarcError(f"{name}: no type or no length")
    n = int(headers["content-length"])
    block = rest[:n]
    if len(block) < n or rest[n:] != CRLF + CRLF:
        raise WarcError(f"{name}: content of {n} bytes expected, {len(rest) - 4} found")
    _check(headers.get("warc-block-digest"), block, "block", name)
    http, payload = {}, block
    if headers.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(CRLF + CRLF)
        http = _headers(lines) if (lines := top.partition(CRLF)[2]) else {}
    if headers["warc-type"] == "revisit":
        said = http.get("content-length", "")
        return Record(headers, http, b"", _sha256(headers.get("warc-payload-digest")), int(said) if said.isdecimal() else None)
    said = headers.get("warc-payload-digest")
    if http.get("transfer-encoding", "").lower() == "chunked":
        content = _unchunked(payload, name)
        try:
            digest = _check(said, content, "payload", name)
        except WarcError:
            _check(said, payload, "payload", name)
            digest = hashlib.sha256(content).hexdigest()
        payload = content
    else:
        digest = _check(said, payload, "payload", name)
    return Record(headers, http, payload, digest, len(payload))


def read_archive(blocks: Iterable[bytes]) -> Iterator[Record]:
    """The records of an archive that comes in blocks of any size: one member is inflated at a time, block by block."""
    inflate, made = None, bytearray()
    for block in blocks:
        while block:
            if inflate is None:
                inflate, made = zlib.decompressobj(31), bytearray()
            try:
                made += inflate.decompress(block)
            except zlib.error as e:
                raise WarcError(f"broken gzip member: {e}") from e
            block = inflate.unused_data
            if inflate.eof:
                yield parse_record(bytes(made))
                inflate = None
    if inflate is not None:
        raise WarcError("the archive ends within a member")


def _write(batches) -> Iterator:
    """(page_id, url, payload, digest, refers_to) rows to (archive, content) rows."""
    import pyarrow as pa
    from pyspark import TaskContext

    take_over("warc")

    schema, n, held, size = pa.schema([("archive", pa.string()), ("content", pa.binary())]), 0, [], 0
    task = TaskContext.get().partitionId()

    def done():
        name = f"pages-{task:06d}-{n:05d}.warc.gz"
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join([write_info(name), *held])], pa.binary())], schema=schema)

    for batch in batches:
        pages, urls, digests, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
        for page, url, payload, digest, first in zip(pages, urls, batch.column(2), digests, refers, strict=True):
            body = payload.as_buffer().to_pybytes()
            name = "" if page is None else str(page)
            held.append(write_record("response" if first is None else "revisit", name, url, body, digest, None if first is None else str(first)))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield done()
                n, held, size = n + 1, [], 0
    if held:
        yield done()


def _read(kinds: tuple[str, ...]):
    """(content) rows to a row for each record of these kinds."""

    def page(uri: str | None) -> int | None:
        number = (uri or "").removeprefix(_ID)
        return int(number) if number != uri and number.lstrip("-").isdecimal() else None

    def run(batches) -> Iterator:
        import pyarrow as pa

        take_over("warc")
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for content in batch.column(0):
                view = memoryview(content.as_buffer())
                for r in read_archive(view[i : i + 65536] for i in range(0, len(view), 65536)):
                    if r.kind in kinds:
                        rows.append((page(r.id), r.headers.get("warc-target-uri"), r.length, r.digest, r.kind, page(r.refers_to), r.id, r.refers_to))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for every row and returns the archives as a table in the shared folder: (archive, content).

    The payload is the column's UTF-8, null being empty. Of payloads that are equal and have 100 bytes or
    more, the one with the smallest id is a response and the others are revisits of it; rows that repeat the
    smallest id are responses too, and so is a row with a null id if its payload has no row with an id.
    Smaller payloads are always responses. A null url is left out of its record. Columns other than the three
    named are not read; an empty table gives no archives.

    Equal payloads are found by their SHA-256 on a table of digests, which aggregates before it is shuffled; the
    pages then join those digests that occur more than once. An archive takes the records of one partition
    until it has 8 MB.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("_payload"),
    ).withColumn("_digest", F.sha2("_payload", 256))
    firsts = (
        rows.where(F.octet_length("_payload") >= LEAST_REVISIT).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1 and _first is not null").select("_digest", "_first")
    )
    joined = rows.join(firsts, "_digest", "left")
    refers = F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return spill(
        joined.select("_id", "_url", "_payload", "_digest", refers.alias("_refers")).mapInArrow(_write, "archive string, content binary"), "warc"
    )


def read_archives(archives: DataFrame, content_col: str = "content", kinds: tuple[str, ...] = ("response", "revisit")) -> DataFrame:
    """A row for each record of these kinds in archives of a binary column, such as spark.read.format("binaryFile") gives:
    (page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_id).

    page_id and refers_to are the numbers of records written here, null for others. A null archive has no records; a broken
    record fails the task.
    """
    return archives.where(F.col(content_col).isNotNull()).select(content_col).mapInArrow(
        _read(kinds), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string"
    )


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Writes archives (archive, content) as files of a folder that all executors share, a path or URI: (archive, bytes).
    A repeated task writes the same file again."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.as_buffer()) for x in batch.column(1)], pa.int64())], names=["archive", "bytes"])

    return archives.select("archive", "content").mapInArrow(run, "archive string, bytes long")


def op8_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT page_id, body, octet_length(encode(body))::BIGINT AS payload_bytes, sha256(body) AS payload_digest,
  min(page_id) OVER (PARTITION BY body) AS first FROM p),
r AS (SELECT *, payload_bytes >= {LEAST_REVISIT} AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to FROM r
"""
