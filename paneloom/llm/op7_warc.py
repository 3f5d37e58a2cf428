"""WARC archives with an index written first, and reads of selected records by byte ranges.

Writing: each task writes its records to one archive file in the shared folder, under a name of its
own, and emits an index row per record: archive, offset, length, URL, digest. A task that is run
again writes another file; only files that the index names count. Records are gzip members, as in
``.warc.gz``, so each can be read alone. Reading: index rows are dealt by (archive, stretch of
bytes), sorted by offset, and neighbouring ranges are fetched by one read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from .base import new_folder, query, stored, table

STRETCH = 8 << 20  # bytes of an archive that one read covers, about
MOST_TASKS = 20_000  # of a read
GAP = 64 << 10  # unwanted bytes that a read may cover between two wanted ranges
INDEX = "page_id long, archive string, offset long, length long, url string, payload_digest string, record_type string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
CRLF = b"\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> bytes:
    return f"<urn:page:{'' if page_id is None else page_id}>".encode()


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has no block, its Payload-Length tells the length of what it refers to."""
    block = b"" if revisit else payload
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A").encode()
    head = [
        b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _urn(page_id),
        b"WARC-Target-URI: " + clean, b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"Payload-Length: %d" % len(payload), b"Content-Type: text/html", b"Content-Length: %d" % len(block),
    ]
    if revisit:
        head += [b"WARC-Refers-To: " + _urn(refers_to),
                 b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    if url is None:
        head.append(b"Target-Is-Null: 1")
    return CRLF.join([*head, b"", b""]) + block + CRLF + CRLF


def _parse(record: bytes) -> dict:
    """Headers (lower-case names) and payload of one record."""
    head, _, rest = record.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(b":") for line in lines[1:])}
    n = int(fields[b"content-length"])
    if rest[n:] != CRLF + CRLF:
        raise ValueError("a WARC record does not end where its length says")
    return {"fields": fields, "payload": rest[:n]}


def _id(urn: bytes | None) -> int | None:
    number = (urn or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(number) if number else None


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; the stored index.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id
    is a response and the others revisits that refer to it; all smaller ones are responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    # First only digests are looked at; copies are pre-aggregated, and only rows that have copies take part in the join.
    marks = own.select("page_id", F.octet_length("html").alias("size"), F.sha1(F.encode("html", "UTF-8")).alias("sha"))
    marks = stored(marks.where(F.col("size") >= least_bytes), "marks")
    copied = marks.groupBy("sha", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = marks.join(copied, ["sha", "size"]).where(
        "page_id is not null and refers_to is not null and page_id < refers_to").select("page_id", "refers_to", "size", "sha")
    revisits = revisits.distinct().withColumnsRenamed({"page_id": "p", "size": "s", "sha": "d"})
    # The payload's hash belongs to the condition only where a page_id is not unique.
    rows = own.join(revisits, (F.col("page_id") == F.col("p")) & (F.octet_length("html") == F.col("s"))
                    & (F.sha1(F.encode("html", "UTF-8")) == F.col("d")), "left")
    rows = rows.select("page_id", "url", F.col("html").cast("binary").alias("html"), "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        out = None
        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in batches:
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                index: list[list] = [[], [], [], []]
                for page, url, payload, refers in zip(*(batch.column(i) for i in range(4))):
                    payload, refers = payload.as_py(), refers.as_py()
                    digest = sha1_base32(payload)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = packer.compress(_record(page.as_py(), url.as_py(), payload, digest, refers, refers is not None)) + packer.flush()
                    out.write(data)
                    for values, value in zip(index, (at, len(data), digest, "response" if refers is None else "revisit")):
                        values.append(value)
                    at += len(data)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([name] * len(batch), pa.string()), pa.array(index[0], pa.int64()), pa.array(index[1], pa.int64()),
                     batch.column(1), pa.array(index[2], pa.string()), pa.array(index[3], pa.string())],
                    names=["page_id", "archive", "offset", "length", "url", "payload_digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    return stored(rows.mapInArrow(write, INDEX), "index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload of the records that ``index`` names.

    ``index`` may be any selection of the index. Digest and length of a response are worked out
    from the payload that was read, those of a revisit come from its header. A record that is
    not where the index says it is raises an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        source, name = None, None
        for batch in batches:
            ranges = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            i = 0
            while i < len(ranges):
                archive, begin, length = ranges[i]
                end, j = begin + length, i + 1
                while (j < len(ranges) and ranges[j][0] == archive and ranges[j][1] <= end + GAP
                       and ranges[j][1] + ranges[j][2] - begin <= max(STRETCH, length)):
                    end, j = max(end, ranges[j][1] + ranges[j][2]), j + 1
                if archive != name:
                    if source is not None:
                        source.close()
                    source, name = files.open_input_file(f"{root}/{archive}"), archive
                data = source.read_at(end - begin, begin)
                columns: list[list] = [[] for _ in range(7)]
                for _, offset, size in ranges[i:j]:
                    found = _parse(zlib.decompress(data[offset - begin: offset - begin + size], 31))
                    fields, payload = found["fields"], found["payload"]
                    revisit = fields[b"warc-type"] == b"revisit"
                    digest = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    if not revisit and sha1_base32(payload) != digest:
                        raise ValueError("a payload does not have its digest")
                    url = None if b"target-is-null" in fields else fields[b"warc-target-uri"].decode()
                    values = (_id(fields[b"warc-record-id"]), int(fields[b"payload-length"]) if revisit else len(payload), digest,
                              "revisit" if revisit else "response", _id(fields.get(b"warc-refers-to")), url, None if revisit else payload)
                    for column, value in zip(columns, values):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
                i = j
        if source is not None:
            source.close()

    # Tasks by the bytes to be read, not by those of the index.
    wanted = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-wanted // (2 * STRETCH)), MOST_TASKS))
    stretch = F.floor(F.col("offset") / STRETCH).alias("stretch")
    rows = index.select("archive", "offset", "length", stretch).repartition(tasks, "archive", "stretch")
    return rows.sortWithinPartitions("archive", "offset").select("archive", "offset", "length").mapInArrow(read, RECORD)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all ``pages`` and read all records back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html counts as empty, a null url is kept as null; rows without page_id are responses;
    rows that repeat a page_id and payload are of one type. An empty table gives no rows.
    """
    folder = new_folder(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    elif folder.startswith("file:/") and not folder.startswith("file:///"):
        folder = "file:///" + folder.removeprefix("file:").lstrip("/")
    return read_records(write_archives(pages, folder, least_bytes), folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_warc")
def op7_warc(spark, sf_dir):
    """Every page written to WARC archives and read back."""
    return archived(table(spark, sf_dir, "pages"))
