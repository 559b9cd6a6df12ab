"""Web archives: written with one gzip member per record, read back sequentially."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inundata.storage import Scratch

#: Compressed bytes after which a task begins a new archive; bytes read from an archive at once.
ARCHIVE_BYTES, READ_BYTES = 32_000_000, 1 << 16
#: Payloads that are stored once if they repeat have as many bytes at least.
REVISIT_LEAST = 1000

#: Bytes of a record's header at most.
HEADER_MOST = 1 << 20
#: Tasks that read archives at most.
READERS = 20_000

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"
DATE = "2000-01-01T00:00:00Z"


class ArchiveError(ValueError):
    """A record that breaks the format or its own length or digest."""


def digest(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def undigest(text: str) -> str:
    return base64.b32decode(text.removeprefix("sha1:")).hex()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit has the HTTP header alone, with the full payload's length and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{RECORD_ID}{';' + uuid.uuid4().hex if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": digest(hashlib.sha1(payload).digest()),
        "WARC-Block-Digest": digest(hashlib.sha1(block).digest()),
        "Content-Length": str(len(block)),
    }
    if url:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{RECORD_ID}{refers_to}>"}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
    return gzip.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""

    @property
    def page_id(self) -> int | None:
        return page_of(self.headers["warc-record-id"])


def page_of(text: str) -> int | None:
    tail = text.strip("<>").removeprefix(RECORD_ID).partition(";")[0]
    return int(tail) if tail else None


def fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


class Members:
    """Reads a stream of gzip members in order, each decompressed as far as it is asked for."""

    def __init__(self, stream, size: int = READ_BYTES) -> None:
        self.stream, self.size, self.rest = stream, size, b""
        self.z, self.held = None, b""

    def next(self) -> bool:
        """Opens the next member; false at the stream's end."""
        self.rest = self.rest or self.stream.read(self.size)
        self.z, self.held = zlib.decompressobj(wbits=31), b""
        return bool(self.rest)

    def more(self) -> bool:
        """Decompresses a little more of the member; false at its end."""
        while not self.z.eof:
            self.rest = self.rest or self.stream.read(self.size)
            if not self.rest:
                raise ArchiveError("the archive ends within a record")
            try:
                part = self.z.decompress(self.rest, self.size)
            except zlib.error as e:
                raise ArchiveError(f"a record isn't a sound gzip member: {e}") from None
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if part:
                self.held += part
                return True
        return False

    def until(self, mark: bytes, most: int) -> bytes:
        """Bytes up to the mark, which is passed over; there are ``most`` at most."""
        at = 0
        while (found := self.held.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.held)
            if at > most or not self.more():
                raise ArchiveError("a record's header has no end")
        out, self.held = self.held[:found], self.held[found + len(mark) :]
        return out

    def exactly(self, n: int) -> bytes:
        """The next n bytes, and none beyond them but what the last step gave."""
        parts, got = [self.held[:n]], min(n, len(self.held))
        self.held = self.held[n:]
        while got < n:
            if not self.more():
                raise ArchiveError("a record is shorter than its header says")
            parts.append(self.held[: n - got])
            self.held = self.held[n - got :]
            got += len(parts[-1])
        return b"".join(parts)

    def end(self) -> None:
        if self.held or self.more():
            raise ArchiveError("a record is longer than its header says")


def read_record(m: Members) -> Record:
    """Frames the open member's record by its Content-Length and verifies lengths and digests."""
    head = m.until(b"\r\n\r\n", HEADER_MOST)
    if not head.startswith(b"WARC/"):
        raise ArchiveError("a member doesn't begin with a record")
    headers = fields(head)
    for name in ("content-length", "warc-type", "warc-record-id", "warc-block-digest", "warc-payload-digest"):
        if name not in headers:
            raise ArchiveError(f"a record has no {name}")
    if not headers["content-length"].isdecimal():
        raise ArchiveError("a record's length is no number")
    block = m.exactly(int(headers["content-length"]))
    if m.exactly(4) != b"\r\n\r\n":
        raise ArchiveError("a record's length isn't as its header says")
    m.end()
    if digest(hashlib.sha1(block).digest()) != headers["warc-block-digest"]:
        raise ArchiveError("a block's digest isn't as its header says")
    http, mark, payload = block.partition(b"\r\n\r\n")
    r = Record(headers, fields(http), payload)
    length = r.http.get("content-length", "")
    if not mark or not length.isdecimal():
        raise ArchiveError("a block has no HTTP header with a length")
    if headers["warc-type"] == "response":
        if len(payload) != int(length):
            raise ArchiveError("a payload's length isn't as its header says")
        if digest(hashlib.sha1(payload).digest()) != headers["warc-payload-digest"]:
            raise ArchiveError("a payload's digest isn't as its header says")
    elif headers["warc-type"] != "revisit" or payload or "warc-refers-to" not in headers:
        raise ArchiveError("a record is neither a response nor a revisit of one")
    try:
        r.page_id, undigest(headers["warc-payload-digest"]), page_of(headers.get("warc-refers-to", ""))
    except ValueError:
        raise ArchiveError("a record's name or digest can't be read") from None
    return r


def read_archive(stream) -> Iterator[Record]:
    m = Members(stream)
    while m.next():
        yield read_record(m)


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        out = path = None
        size = n = 0
        done: list[tuple[str, int, int]] = []
        for b in batches:
            for page_id, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:  # a new name for each attempt: only those of finished tasks are listed and read
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, size, n = fs.open_output_stream(path, compression=None), 0, 0
                data = record(page_id, url, (html or "").encode(), refers)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return run


def _read(root: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(root)
        for b in batches:
            for path in b.column("path").to_pylist():
                with fs.open_input_stream(path, compression=None) as stream:
                    rows: list[tuple] = []
                    size = 0
                    for r in read_archive(stream):
                        refers = r.headers.get("warc-refers-to")
                        rows.append((r.page_id, r.headers.get("warc-target-uri"), int(r.http["content-length"]), undigest(r.headers["warc-payload-digest"]), r.headers["warc-type"], page_of(refers) if refers else None, r.payload if payloads else None))
                        size += len(r.payload) if payloads else 100
                        if size > 4_000_000:
                            yield _rows(rows)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows)

    return run


_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], _NAMES)


def write_archives(pages: DataFrame, root: str, scratch: Scratch, least: int = REVISIT_LEAST) -> DataFrame:
    """Writes a record for each page below ``root`` and returns path, records and bytes of each archive.

    Of pages with equal payloads of ``least`` bytes or more, all but the one with
    the largest page_id are revisits of it. Null html is an empty payload.
    Rows that repeat that page_id are all responses; a row without page_id has
    a record without one, named at random, and never is what others
    revisit. A table without ``url`` has records without a target.
    """
    spark = pages.sparkSession
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), url, F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"n": F.octet_length("html"), "sha": F.unhex(F.sha1(F.col("html").cast("binary"))), "sum": F.xxhash64("html")})
    same = ["n", "sha", "sum"]
    owner = p.where(F.col("n") >= least).groupBy(same).agg(F.max("page_id").alias("owner"), F.count("*").alias("copies")).where("copies > 1 and owner is not null").drop("copies")
    owner = scratch.keep(owner, "owner")  # so that the join has shuffles of its own, whose hot payloads adaptive execution splits
    rows = p.join(owner, same, "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner")).alias("refers_to"))
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return rows.mapInArrow(_write(root), "path string, records long, bytes long")


def read_archives(spark: SparkSession, archives: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that ``archives`` lists by path, with verified lengths and digests.

    ``archives`` is a saved table. Each task reads its archives from the start,
    member by member, no further than a record's Content-Length, and holds one
    record at a time. Whatever breaks the format, a length or a digest raises
    ArchiveError. Columns: page_id,
    url, payload_bytes and payload_digest (of the full payload, for revisits
    too), record_type, refers_to, payload (null for revisits or if not wanted).
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    tasks = max(1, min(READERS, archives.count()))  # a number, as adaptive execution would join tasks by the few bytes of their paths
    return archives.select("path").repartition(tasks, "path").mapInArrow(_read(root, payloads), schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages as archives into the shared folder and reads them back, without payloads."""
    spark = pages.sparkSession
    with Scratch(spark) as scratch:
        root = scratch.path("warc", keep=True)
        archives = scratch.keep(write_archives(pages, root, scratch), "archives")
        return read_archives(spark, archives, root, payloads=False).drop("payload", "url")
