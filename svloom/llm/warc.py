"""WARC, index first: records are written with an index of offset, length, URL and digest; reads go through the index.

Selected records are sorted by file and offset and close byte ranges are coalesced into few large reads.

Edge cases: a null html is an empty payload, a null url is an empty target; rows with a null page_id are written but never chosen as
the record that others refer to, unless a payload has no other. Repeated rows with one page_id get a record each,
all of the same type. Empty tables give no files and no rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, read_table, shuffle_partitions, staged

#: Bytes after which a writer begins a new archive; a record is never split.
ARCHIVE_BYTES = 256 << 20
#: Ranges closer than GAP_BYTES are read together, up to READ_BYTES at once (one record at least).
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Bytes of a file that are read in one task, and archive bytes for which there is a partition.
STRETCH_BYTES, PARTITION_BYTES = 32 << 20, 32 << 20
INDEX = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, stored binary"


def filesystem(uri: str):
    """The Arrow file system of a URI or path, and the path in it. Hadoop's names of S3 are Arrow's ``s3``."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri) if re.match(r"\w[\w+.-]*:/", uri) else (fs.LocalFileSystem(), uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, n_bytes: int, digest: str, kind: str, refers_to: int | None, refers_url: str) -> bytes:
    """One WARC/1.1 record in a gzip member of its own. A revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    name = f"{page_id}\n{url}\n{kind}"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"X-Page-ID: {page_id}"] * (page_id is not None)
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {refers_url}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> dict:
    """A record from its gzip member. The digest of a stored payload is computed from the stored bytes and held against the header."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n_bytes = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != n_bytes or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields["WARC-Target-URI"], "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "payload_bytes": n_bytes, "payload_digest": digest, "stored": payload if kind == "response" else None}


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes pages(page_id, url, html) as WARC archives into the folder; returns the index, one row per record.

    Of records with equal payloads of at least ``least_bytes`` bytes, the one with the smallest page_id is the response. Which one that
    is comes from an aggregate over digests; its result has one row per digest, so a hot payload only makes the larger side uneven,
    which adaptive execution splits. A file is closed before its index rows leave the task, under a name of the task attempt: rows
    of a lost attempt never point into a file that another attempt has written."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    firsts = rows.groupBy("sha1").agg(F.min_by(F.struct("page_id", "url"), F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = rows.join(firsts, "sha1", "left").select("page_id", "url", "payload", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        task = TaskContext.get()
        out, n, at, rows = None, 0, 0, []
        schema = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset", "length"]

        def closed() -> pa.RecordBatch:
            out.close()
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], schema)

        for batch in batches:
            for page_id, url, body, first_id, first_url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first_id", "first_url")), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{n}.warc.gz"
                    out, n, at, rows = store.open_output_stream(f"{root}/{name}", compression=None), n + 1, 0, []
                digest = base32_sha1(body)
                again = first_id is not None and len(body) >= least_bytes and page_id != first_id
                kind = "revisit" if again else "response"
                url = re.sub(r"[\r\n]", " ", url)
                member = record(page_id, url, body, len(body), digest, kind, first_id, re.sub(r"[\r\n]", " ", first_url or ""))
                out.write(member)
                rows.append((page_id, url, len(body), digest, kind, first_id if again else None, name, at, len(member)))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return marked.mapInArrow(write, INDEX)


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the index's rows, read from the archives: rows are dealt by file and stretch of it, over as
    many partitions as the records' bytes ask for (the index itself is too small to tell), sorted, and close ranges read at once."""
    stretch = F.floor(F.col("offset") / F.lit(STRETCH_BYTES))
    volume = index.agg(F.sum("length")).first()[0] or 0
    partitions = max(shuffle_partitions(index.sparkSession), -(-volume // PARTITION_BYTES))
    asked = index.select("file", "offset", "length", stretch.alias("stretch")).repartition(partitions, "file", "stretch").sortWithinPartitions("file", "offset")
    asked = asked.select("file", "offset", "length")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stored", pa.binary())])
        opened, name = None, None
        for batch in batches:
            wanted = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            i = 0
            while i < len(wanted):
                file, start, length = wanted[i]
                end, j = start + length, i + 1
                while j < len(wanted) and wanted[j][0] == file and wanted[j][1] - end <= GAP_BYTES and wanted[j][1] + wanted[j][2] - start <= READ_BYTES:
                    end, j = max(end, wanted[j][1] + wanted[j][2]), j + 1
                if file != name:
                    if opened is not None:
                        opened.close()
                    opened, name = store.open_input_file(f"{root}/{file}"), file
                piece = opened.read_at(end - start, start)
                found = [parse(piece[o - start : o - start + n]) for _, o, n in wanted[i:j]]
                if not payloads:
                    found = [x | {"stored": None} for x in found]
                yield pa.RecordBatch.from_pylist(found, schema)
                i = j
        if opened is not None:
            opened.close()

    return asked.mapInArrow(read, READ)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Writes every page, stages the index, reads all records back through it."""
    folder = new_folder(spark, "warc")
    index = staged(write_archives(read_table(spark, sf_dir, "pages"), folder, 0), "warc-index")
    return read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hx, unhex(sha1(payload)) AS b FROM p),
f AS (SELECT hx, min(page_id) AS first_id FROM h GROUP BY hx),
bits AS (SELECT hx, string_agg(lpad(bin(('0x' || substr(hx, 2 * i + 1, 2))::INT), 8, '0'), '' ORDER BY i) AS s
  FROM (SELECT DISTINCT hx FROM h), range(20) r(i) GROUP BY hx),
d AS (SELECT hx, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: CAST(substr(s, 5 * k + j + 1, 1) AS INT) * (16 >> j)))::INT, 1), '' ORDER BY k) AS digest
  FROM bits, range(32) q(k) GROUP BY hx)
SELECT h.page_id, h.payload_bytes, d.digest AS payload_digest,
  CASE WHEN h.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN h.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM h JOIN f USING (hx) JOIN d USING (hx)
"""
