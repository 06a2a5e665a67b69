"""Operator 6: a content-addressed web archive.

Each page becomes a WARC record. Payloads are stored once, keyed by their SHA-256 (a gzip
member each); the exact header bytes of every record are a table beside them. A record is its
header, the payload its digest leads to (for a response) and the closing line ends,
so the original records come back through one join, and digests are computed again from what was read.

Of records with equal payloads the one with the largest page_id is the response, the others are revisits of it.
Payloads of fewer than MIN_BYTES are responses always (the contract sets 0, so all take part).

Edge cases: a null html is an empty payload; rows that repeat a response's page_id are responses too; a null page_id
revisits its payload's response, and is a response if no equal payload has an id; control characters in a url are
percent-encoded in its header; an empty table gives an empty archive. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ingot.llm.common import prepare, ships
from ingot.session import scratch_path

ships(__name__)

MIN_BYTES = 0  # fixed by the contract
DATE = "2024-01-01T00:00:00Z"  # of all records, unless the caller knows better
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = b"\r\n\r\n"


@dataclass
class Archive:
    """Paths of the two tables."""

    headers: str
    payloads: str


def payload_of(html) -> bytes:
    return (html.as_py() or "").encode("utf-8", "surrogatepass")


def sha1_text(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digest_batches(batches):
    """For mapInArrow over (page_id, url, html): page_id, url, digest, sha1, n."""
    for b in batches:
        bodies = [payload_of(h) for h in b.column(2)]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0), b.column(1),
                pa.array([hashlib.sha256(x).digest() for x in bodies], pa.binary()),
                pa.array([sha1_text(x) for x in bodies], pa.string()),
                pa.array([len(x) for x in bodies], pa.int64()),
            ],
            names=["page_id", "url", "digest", "sha1", "n"],
        )


def payload_batches(batches):
    """For mapInArrow over (html): digest, payload (gzip), each payload of a batch once."""
    for b in batches:
        bodies = {hashlib.sha256(x).digest(): x for x in map(payload_of, b.column(0))}
        packed = [gzip.compress(x, 6, mtime=0) for x in bodies.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(bodies), pa.binary()), pa.array(packed, pa.binary())], names=["digest", "payload"]
        )


def header(page_id, url, sha1: str, n: int, refers_to, date: str = DATE) -> bytes:
    """The record's bytes before its payload; a revisit has no payload of its own."""
    visit = refers_to is not None
    size = len(HTTP) + (0 if visit else n)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if visit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if visit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {size}", "", ""]
    return "\r\n".join(lines).encode() + HTTP


def header_batches(date: str):
    """For mapInArrow over (page_id, url, digest, sha1, n, refers_to): page_id, digest, header."""

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4, 5)), strict=True)
            heads = [header(*r, date) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(heads, pa.binary())], names=["page_id", "digest", "header"])

    return run


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = DATE) -> Archive:
    """Write the archive's two tables below ``path``."""
    prepare(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    marks = pages.mapInArrow(digest_batches, f"page_id {kind}, url string, digest binary, sha1 string, n long")
    first = marks.groupBy("digest").agg(F.max("page_id").alias("owner"))
    refers = F.when((F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))
    rows = marks.join(first, "digest").select("page_id", "url", "digest", "sha1", "n", refers.alias("refers_to"))
    out = Archive(f"{path}/headers", f"{path}/payloads")
    rows.mapInArrow(header_batches(date), f"page_id {kind}, digest binary, header binary").write.parquet(out.headers)
    bodies = pages.select("html").mapInArrow(payload_batches, "digest binary, payload binary")
    # equal digests are equal payloads, so any copy will do; copies of a task meet before the shuffle
    bodies.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "uncompressed").parquet(out.payloads)
    return out


def parse(head: bytes) -> dict[str, str]:
    """The fields of a record's header; raises if it isn't one."""
    warc, _, http = head.partition(END)
    lines = warc.decode().split("\r\n")
    if lines[0] != "WARC/1.1" or http != HTTP[: len(http)] or len(http) != len(HTTP):
        raise ValueError("not a record of this archive")
    return dict(line.split(": ", 1) for line in lines[1:])


def _number(urn: str | None) -> int | None:
    return None if urn is None or urn == "<urn:page:None>" else int(urn.removeprefix("<urn:page:").removesuffix(">"))


def _records(b):
    """(header bytes, fields, payload) of each row of (header, digest, payload); raises on a wrong digest."""
    last, body, sha1 = None, b"", ""
    for head, digest, packed in zip(*(b.column(k) for k in (0, 1, 2)), strict=True):
        if digest.as_py() != last:
            last, body = digest.as_py(), gzip.decompress(packed.as_py())
            sha1 = sha1_text(body)
            if hashlib.sha256(body).digest() != last:
                raise ValueError("a stored payload does not have its digest")
        head = head.as_py()
        fields = parse(head)
        size = len(HTTP) + (len(body) if fields["WARC-Type"] == "response" else 0)
        if fields["WARC-Payload-Digest"] != f"sha1:{sha1}" or int(fields["Content-Length"]) != size:
            raise ValueError("a record's header does not fit its payload")
        yield head, fields, body, sha1


def index_batches(batches):
    for b in batches:
        rows = [
            (_number(f["WARC-Record-ID"]), len(x), s, f["WARC-Type"], _number(f.get("WARC-Refers-To")))
            for _, f, x, s in _records(b)
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def record_batches(batches):
    for b in batches:
        rows = [(_number(f["WARC-Record-ID"]), h + (x if f["WARC-Type"] == "response" else b"") + END) for h, f, x, _ in _records(b)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary()))], names=["page_id", "record"])


def _joined(spark: SparkSession, archive: Archive) -> DataFrame:
    heads, bodies = spark.read.parquet(archive.headers), spark.read.parquet(archive.payloads)
    return heads.join(bodies, "digest").select("header", "digest", "payload")


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, record: every original record, byte for byte."""
    return _joined(spark, archive).mapInArrow(record_batches, "page_id long, record binary")


def read_index(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: read back from the archive."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return _joined(spark, archive).mapInArrow(index_batches, schema)


def archived(pages: DataFrame) -> DataFrame:
    """Write an archive in the shared folder and read its index back."""
    spark = prepare(pages.sparkSession)
    return read_index(spark, write_archive(pages, scratch_path(spark, "warc")))
