"""Web archives with an index first: records are written, listed by place, and read back by byte ranges.

Each task writes the records of its part to files of its own, a compressed member
for each record, and gives a line of index for each: file, offset, length, URL,
digest.  The index is written as a table before anything is read.  A reader takes
any selection of index rows, sorts it by place, and joins neighbouring ranges so
that one request fetches many records.

Files go to a folder all executors share, through the file systems that Arrow
knows (local and mounted folders, HDFS, object stores).  A task that runs again
writes under another name; only files of attempts that Spark accepted are listed.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import new_folder, small_batches, text_of, written

#: Payloads of fewer bytes are never made revisits.
LEAST_BYTES = 1000
#: Bytes of an archive after which the next one begins.
ARCHIVE_BYTES = 1 << 30
#: Parts among which the copies of one payload are dealt.
PARTS = 32
#: Bytes of a file that one task reads, and of one request; ranges this close are joined.
SEGMENT_BYTES = 64 << 20
REQUEST_BYTES = 4 << 20
GAP_BYTES = 64 << 10

INDEX = "archive string, offset bigint, length bigint, page_id bigint, url string, digest string, record_type string"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def _member(row: dict, stamp: str) -> bytes:
    """One compressed record.  A revisit keeps the response's head but no payload."""
    payload = row["payload"] or b""
    revisit = row["refers_to_row"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{row['page_id']} {row['digest']} {row['url']}")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", stamp),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if row["page_id"] is not None:
        fields.append(("X-Page-Id", str(row["page_id"])))
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", "".join(c for c in row["url"] if c not in "\r\n")))
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", str(row["refers_to"])),
        ]
    fields.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, stamp: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of `pages` (page_id, url, html) below `folder`; the index, written as a table, is returned.

    Of rows with equal payloads of at least `LEAST_BYTES` bytes the one with the
    largest page_id is a response, the others are revisits of it; where that id
    itself is repeated with the payload, all its rows are responses.  Rows without
    page_id are revisits only of rows that have one.  A null html is an empty payload.
    """
    spark = pages.sparkSession
    small_batches(spark)
    payload = text_of("html").cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.sha1(payload).alias("digest"),
    ).withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int"))
    # The copies of one payload may be any share of all rows: they are counted before they are shuffled and joined in parts.
    long_ones = rows.filter(F.octet_length("payload") >= LEAST_BYTES)
    last = long_ones.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
    last = written(last.filter((F.col("copies") > 1) & F.col("refers_to").isNotNull()).select("digest", "refers_to"), "last-copies")
    last = last.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    told = rows.join(last, ["digest", "part"], "left").select(
        "page_id", "url", "payload", "digest", "refers_to",
        (F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).alias("refers_to_row"),
    )
    schema = T.StructType.fromDDL(INDEX)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        name, out, at = "", None, 0
        try:
            for batch in batches:
                listed = []
                for row in batch.to_pylist():
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name = f"part-{context.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out, at = system.open_output_stream(f"{root}/{name}", compression=None), 0
                    member = _member(row, stamp)
                    out.write(member)
                    listed.append(
                        {"archive": name, "offset": at, "length": len(member), "page_id": row["page_id"], "url": row["url"],
                         "digest": row["digest"], "record_type": "revisit" if row["refers_to_row"] else "response"}
                    )
                    at += len(member)
                yield pa.RecordBatch.from_pylist(listed, schema=to_arrow_schema(schema))
        finally:
            if out is not None:
                out.close()

    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    fs_system, fs_root = fs.FileSystem.from_uri(folder)
    fs_system.create_dir(fs_root, recursive=True)
    return written(told.mapInArrow(write, schema), "archive-index")


def _parsed(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if not revisit and hashlib.sha1(payload).digest() != base64.b32decode(fields["WARC-Payload-Digest"][5:]):
        raise ValueError("a record's payload does not have its digest")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return {
        "page_id": int(page) if page else None, "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": int(refers) if refers else None, "payload_bytes": size,
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(), "payload": None if revisit else payload,
    }


def _requests(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Sorted ranges joined into runs, each of one file and of bounded size."""
    run: list[tuple[str, int, int]] = []
    for row in rows:
        if run and (
            row[0] != run[0][0] or row[1] - (run[-1][1] + run[-1][2]) > GAP_BYTES or row[1] + row[2] - run[0][1] > REQUEST_BYTES
        ):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """The records that rows of an index name: headers and, but for revisits, the payload.

    The rows are dealt by file and stretch of it, sorted by place, and fetched in
    joined ranges; what stands between two chosen records is skipped unless short.
    """
    small_batches(selected.sparkSession)
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    schema = T.StructType.fromDDL(RECORD)
    places = selected.select("archive", "offset", "length", F.floor(F.col("offset") / SEGMENT_BYTES).alias("stretch"))
    places = places.repartition("archive", "stretch").sortWithinPartitions("archive", "offset").select("archive", "offset", "length")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for run in _requests(list(zip(*[c.to_pylist() for c in batch.columns], strict=True))):
                first, end = run[0][1], run[-1][1] + run[-1][2]
                with system.open_input_file(f"{root}/{run[0][0]}") as source:
                    data = source.read_at(end - first, first)
                records = [_parsed(zlib.decompress(data[o - first : o - first + n], 31)) for _, o, n in run]
                yield pa.RecordBatch.from_pylist(records, schema=to_arrow_schema(schema))

    return places.mapInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read all back: a row for each page with what its record says."""
    folder = new_folder(pages.sparkSession, "archives")
    index = write_archives(pages, folder)
    return read_records(index, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


ROUND_TRIP_SQL = f"""
WITH page AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
),
last AS (
  SELECT payload_digest, max(page_id) AS last_id FROM page WHERE payload_bytes >= {LEAST_BYTES}
  GROUP BY payload_digest HAVING count(*) > 1
),
told AS (
  SELECT page.*, CASE WHEN last_id IS NOT NULL AND page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to
  FROM page LEFT JOIN last USING (payload_digest)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, url
FROM told
"""
