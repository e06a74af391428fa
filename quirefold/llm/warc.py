"""WARC archives, index first.

Each input partition is written as one archive of gzip members, a record for each page; beside it, the
index holds file, offset, length, url, digest and type of every record. Reading starts from the index:
the selected records are sorted by place, near ones are coalesced into one byte-range read, and the
records are parsed from these ranges. Files go through pyarrow's file systems by their URI, into the
shared folder, under a name of the task attempt's own, so a lost executor's half-written file is never
named by the index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, bound_batches, read, small

#: Payloads from this many bytes on may be revisits.
LEAST_BYTES = 1000

#: Records up to this far apart are read at once, up to so many bytes a read.
GAP_BYTES, RANGE_BYTES = 64 << 10, 1 << 20

#: Bytes of an archive that one reading task takes, about.
SPAN_BYTES = 8 << 20

LEVEL = 1
DATE = "2026-01-01T00:00:00Z"
ID = "urn:quirefold:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _line(value: str) -> str:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, serial: str) -> bytes:
    """The bytes of one record, before compression; a revisit has the HTTP header alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{serial if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode())
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def parse(data: bytes) -> dict:
    """A record's fields; payload is null for a revisit, whose size and digest come from its headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    own = _fields(head)
    block = rest[: int(own["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    name = lambda key: (int(x) if (x := own.get(key, "").strip("<>").removeprefix(ID)).lstrip("-").isdigit() else None)
    revisit = own["warc-type"] == "revisit"
    return {
        "page_id": name("warc-record-id"), "url": own.get("warc-target-uri"), "record_type": own["warc-type"], "refers_to": name("warc-refers-to"),
        "payload_bytes": int(_fields(http)["content-length"]) if revisit else len(payload),
        "payload_digest": base64.b32decode(own["warc-payload-digest"].removeprefix("sha1:")).hex() if revisit else hashlib.sha1(payload).hexdigest(),
        "payload": None if revisit else payload,
    }


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, payload binary, refers_to) as archives; returns the index, lazily.

    Keep the index as a table before use: computing it is what writes. Null url: no target header. Null
    page_id: the record has an id of its own. Null payload: empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        try:
            for batch in batches:
                if out is None:
                    fs, path = _open(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                rows = []
                columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to")]
                for k in range(batch.num_rows):
                    page, url, payload, refers = (c[k].as_py() for c in columns)
                    payload = payload or b""
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = z.compress(record(page, url, payload, refers, f"none-{uuid.uuid4().hex}")) + z.flush()
                    out.write(data)
                    rows.append((page, url, hashlib.sha1(payload).hexdigest(), "response" if refers is None else "revisit", refers, name, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
        finally:
            if out is not None:
                out.close()

    return pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, INDEX)


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """rows (file, offset, length), sorted, in groups that one read fetches."""
    group: list[tuple[str, int, int]] = []
    for row in rows:
        if group and (row[0] != group[0][0] or row[1] - (group[-1][1] + group[-1][2]) > GAP_BYTES or row[1] + row[2] - group[0][1] > RANGE_BYTES):
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def read_warc(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the rows of index (file, offset, length) name, in any order; each row once.

    Without payloads the column payload is null; sizes and digests still come from the bytes read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            for group in _ranges(rows):
                name, first = group[0][0], group[0][1]
                if name not in opened:
                    for f in opened.values():
                        f.close()
                    fs, path = _open(name)
                    opened = {name: fs.open_input_file(path)}
                data = opened[name].read_at(group[-1][1] + group[-1][2] - first, first)
                found = [parse(zlib.decompress(data[o - first : o - first + n], 31)) for _, o, n in group]
                if not payloads:
                    found = [x | {"payload": None} for x in found]
                yield pa.RecordBatch.from_pylist(found, schema=schema)
        for f in opened.values():
            f.close()

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    bound_batches(index.sparkSession)
    placed = index.select("file", "offset", "length")
    total, files = placed.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count_distinct("file")).first()
    tasks = max(1, files, -(-total // SPAN_BYTES))  # a number of its own, else tasks are merged by the bytes of the index, not of the archives
    spans = placed.repartition(int(tasks), "file", F.floor(F.col("offset") / SPAN_BYTES)).sortWithinPartitions("file", "offset")
    return spans.mapInArrow(run, RECORD)


def mark_revisits(pages: DataFrame, stages: Stages, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, payload and others) with refers_to: the largest page_id of those with an equal payload
    of at least least_bytes, null for that page itself, for smaller payloads and where no page_id is known."""
    keyed = pages.withColumn("_q_key", F.when(F.octet_length("payload") >= least_bytes, F.sha2("payload", 256)))
    groups = keyed.where("_q_key IS NOT NULL").groupBy("_q_key").agg(F.max("page_id").alias("_q_last"), F.count(F.lit(1)).alias("_q_n")).where("_q_n > 1")
    groups = stages.keep(groups.select("_q_key", "_q_last"), "groups")
    joined = keyed.join(small(groups, 120), "_q_key", "left")
    return joined.withColumn("refers_to", F.when(F.col("_q_last") != F.coalesce(F.col("page_id"), F.col("_q_last") - 1), F.col("_q_last"))).drop("_q_key", "_q_last")


def round_trip(pages: DataFrame, stages: Stages, payloads: bool = True) -> tuple[DataFrame, DataFrame]:
    """(index, records) of pages (page_id, url, html), written to the shared folder and read back.

    Null html is an empty payload. Rows equal in page_id and payload are each a response if their page_id
    is the largest of the group, else each a revisit. An empty table gives empty results.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    index = stages.keep(write_warc(mark_revisits(rows, stages), stages.path("warc")), "index")
    return index, read_warc(index, payloads)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records = round_trip(read(spark, sf_dir, "pages"), Stages(spark), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT *, CASE WHEN n >= {LEAST_BYTES} THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM g
"""
