"""WARC: archives with one gzip member for each record, written by executors and read back sequentially.

Writing: each task writes archives of bounded size into a shared folder under a name of its own attempt and returns a
manifest row for each; only the manifests of tasks that succeeded are read, so retried or speculative tasks do no harm.
Reading: chunks of the file go through zlib.decompressobj; where a member ends, the rest starts the next one. Each member
is framed by its Content-Length, must end in CRLF CRLF, and the SHA-256 of its payload must equal the stated digest.

Copies: payloads of at least min_bytes that occur more than once are stored once, by the row with the smallest page_id;
other rows become revisit records, which keep the digest and the length. The table of repeated digests is written first,
so that the join back is one between two exchanges and Spark can split a digest that holds a third of all rows.

Defined results. Null html: empty payload. Null page_id: a record without a page id, never chosen as response where another
row has an id. Repeated page_id with equal payload: all rows with the smallest id are responses. Line breaks in an url are
percent-encoded in the header. Empty table: no archive, no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import common

MIN_BYTES = 100
COLUMNS = ("page_id", "url", "html", "digest", "size", "refers_to", "serial", "first_url")
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 16
#: Pages carry no time of their own.
DATE = b"1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that can't be framed or whose digest is wrong."""


#: Spark's names of stores that Arrow knows by another one.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path of a folder in Spark's notation: local files, hdfs, s3a, gs, abfs and abfss. Others are an error."""
    scheme, sep, rest = uri.partition("://")
    try:
        return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{sep}{rest}")
    except pa.ArrowInvalid as e:
        raise WarcError(f"archives can't be written to {scheme}: {e}") from None


def _open(uri: str, mode: str):
    fs, path = located(uri)
    return fs.open_input_stream(path, compression=None) if mode == "r" else fs.open_output_stream(path, compression=None)


def record(page_id: int | None, url: bytes | None, payload: bytes, size: int, digest: str, refers_to: int | None, serial: int = 0, refers_url: bytes | None = None) -> bytes:
    """The bytes of a record, not compressed. A revisit (refers_to is set) leaves out the payload and names the response's url and page. serial tells repeated rows apart."""
    revisit = refers_to is not None
    bare = lambda x: (x or b"").replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}:{serial}")).encode(),
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + bare(url),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if page_id is not None:
        head.append(b"X-Page-Id: %d" % page_id)
    if revisit:
        head += [b"WARC-Profile: " + PROFILE.encode(), b"WARC-Refers-To-Target-URI: " + bare(refers_url), b"WARC-Refers-To-Date: " + DATE, b"X-Refers-To-Page-Id: %d" % refers_to]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of each gzip member, decompressed as the chunks come."""
    d, out, begun = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            begun = True
            out.append(d.decompress(chunk))
            chunk = b""
            if d.eof:
                chunk = d.unused_data
                yield b"".join(out)
                d, out, begun = zlib.decompressobj(31), [], False
    if begun:
        raise WarcError("the archive ends inside a gzip member")


def parse(member: bytes) -> dict:
    """Headers, length and digest of a record; raises WarcError where framing or digest is wrong."""
    head, sep, rest = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] != b"WARC/1.1":
        raise WarcError("no WARC header")
    fields = dict(line.split(b": ", 1) if b": " in line else (line.rstrip(b":"), b"") for line in lines[1:])
    n = int(fields[b"Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError("Content-Length doesn't frame the record")
    http, sep, payload = rest[:n].partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    kind, digest = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise WarcError("the payload's digest or length is wrong")
    page, refers = fields.get(b"X-Page-Id"), fields.get(b"X-Refers-To-Page-Id")
    return {"page_id": page and int(page), "url": fields[b"WARC-Target-URI"], "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers and int(refers)}


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write every row of pages (page_id, url, html) and return the manifest (path, records)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumns({"digest": F.sha2("html", 256), "size": F.length("html").cast("long")})
    firsts = rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first_url"), F.count(F.lit(1)).alias("n"))
    firsts = common.materialize(firsts.filter("n > 1").select("digest", "first", "first_url"), "warc-firsts")
    rows = rows.join(firsts, "digest", "left").withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).withColumn("serial", F.monotonically_increasing_id())
    store, path = located(folder)
    store.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, path, size, n, k = TaskContext.get(), None, "", 0, 0, 0

        def done():
            out.close()
            return pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

        for batch in batches:
            for page_id, url, html, digest, length, refers, serial, first_url in zip(*(common.utf8(batch, c) if c in ("url", "html", "first_url") else batch.column(c).to_pylist() for c in COLUMNS), strict=True):
                if out is None:
                    path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}.warc.gz"
                    out, size, n, k = _open(path, "w"), 0, 0, k + 1
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = z.compress(record(page_id, url, html, length, digest, refers, serial, first_url)) + z.flush()
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return rows.select(*COLUMNS).mapInArrow(common.tidied(write), "path string, records long")


def read_archives(manifest: DataFrame, content: bool = False) -> DataFrame:
    """One row for each record of the archives that manifest (path) lists, url and payload included where content is asked for."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] if content else [])]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.binary(), "payload": pa.binary()}

    def chunks(path: str) -> Iterator[bytes]:
        with _open(path, "r") as f:
            while data := f.read(CHUNK):
                yield data

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[dict] = []
                for member in members(chunks(path)):
                    rows.append(parse(member))
                    if len(rows) == 500:
                        yield pa.record_batch([pa.array([r[c] for r in rows], kinds[c]) for c in names], names=names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array([r[c] for r in rows], kinds[c]) for c in names], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", url binary, payload binary" if content else "")
    return manifest.select("path").mapInArrow(common.tidied(scan), schema)


def query(spark, sf_dir: str) -> DataFrame:
    folder = common.scratch_path(spark, "warc")
    manifest = common.materialize(write_archives(common.read(spark, sf_dir, "pages"), folder), "warc-manifest")
    # one task for each few archives; the manifest is one short row for each archive
    return read_archives(manifest.repartition(spark.sparkContext.defaultParallelism * 4, "path"))


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN f.first IS NULL OR f.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
