"""WARC archives with an index written first and coalesced range reads.

``write`` stores one record for each row, each record being a gzip member of its own,
and returns the index: file, offset, length, url and digest of every record. ``read``
takes any selection of index rows, sorts them by file and offset, joins neighbouring
byte ranges into one read each, and parses the records.

Of the records with equal payloads of at least ``least`` bytes only that with the
smallest page_id holds the payload; the others are revisit records that refer to it.

Tasks write to files whose names hold a fresh random part, and the index names only
the file of the attempt that ended well, so a task that runs again after an executor
was lost can't mix its records with those of the first attempt.

Defined results: a null payload is an empty one; payloads below ``least`` bytes are
all responses; of several rows with the same payload and the same smallest page_id
each is a response; rows without page_id are revisits where some other row of the
payload has one, else responses; an empty table writes no record; other columns are
ignored.
"""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import cut, shared_dir, slices, table

LEAST_BYTES = 100
#: Ranges at most this far apart are read together, up to so many bytes in a read.
GAP, READ = 1 << 16, 1 << 23

INDEX = "page_id long, url string, file string, offset long, length long, payload_bytes long, digest string, record_type string, refers_to long"
RECORDS = "page_id long, record_type string, refers_to long, declared_bytes long, declared_digest string, payload string"


def _record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html) and return their index."""
    base = f"{shared_dir(pages.sparkSession)}/warc"
    where, path = fs.FileSystem.from_uri(base)
    where.create_dir(path, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\r\\n]", " ").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    repeated = cut(rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first"))
    told = rows.join(repeated, rows.digest == repeated.of, "left").select("page_id", "url", "html", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def run(batches):
        store, folder = fs.FileSystem.from_uri(base)
        name, out, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for part in slices(batch):
                found: list[list] = [[] for _ in range(9)]
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                    payload = payload.encode("utf-8", "surrogatepass")
                    member = _member(_record(page_id, url, payload, digest, refers_to))
                    out = out or store.open_output_stream(name, compression=None)
                    out.write(member)
                    values = (page_id, url, name, at, len(member), len(payload), digest, "response" if refers_to is None else "revisit", refers_to)
                    for column, value in zip(found, values):
                        column.append(value)
                    at += len(member)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                if out:
                    out.flush()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, kinds)], [x.split()[0] for x in INDEX.split(", ")])
        if out:
            out.close()

    index = cut(told.mapInArrow(run, INDEX))
    return index.withColumn("base", F.lit(base))


def _parsed(raw: bytes) -> tuple:
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    of = lambda key: (lambda x: int(x) if x else None)(fields[key][len("<urn:page:") : -1]) if key in fields else None
    block = block[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    return of("WARC-Record-ID"), fields["WARC-Type"], of("WARC-Refers-To"), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), payload


def read(index: DataFrame) -> DataFrame:
    """The records that ``index`` names: their headers, and the payload of responses."""
    first = index.select("base").first()
    base = first[0] if first else ""

    def run(batches):
        store = fs.FileSystem.from_uri(base)[0]
        opened: tuple = ("", None)
        for batch in batches:
            for part in slices(batch):
                files, offsets, lengths = (c.to_pylist() for c in part.columns)
                found: list[list] = [[] for _ in range(6)]
                i = 0
                while i < len(files):
                    j, end = i + 1, offsets[i] + lengths[i]
                    while j < len(files) and files[j] == files[i] and offsets[j] - end <= GAP and offsets[j] + lengths[j] - offsets[i] <= READ:
                        end = offsets[j] + lengths[j]
                        j += 1
                    if opened[0] != files[i]:
                        if opened[1]:
                            opened[1].close()
                        opened = (files[i], store.open_input_file(files[i]))
                    data = opened[1].read_at(end - offsets[i], offsets[i])
                    for k in range(i, j):
                        at = offsets[k] - offsets[i]
                        for column, value in zip(found, _parsed(zlib.decompress(data[at : at + lengths[k]], 31))):
                            column.append(value)
                    i = j
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                payload = pa.array(found[5], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(found, kinds)), payload], [x.split()[0] for x in RECORDS.split(", ")])

    # one file is read by one task, in the order of its bytes
    ordered = index.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(write(table(spark, sf_dir, "pages")))
    held = F.col("record_type") == "response"
    return found.select(
        "page_id",
        F.when(held, F.octet_length("payload").cast("long")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(held, F.sha2("payload", 256)).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS page FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, payload_bytes, p.payload_digest,
       CASE WHEN page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page <> page_id THEN page END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
