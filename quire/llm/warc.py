"""WARC archives: a writer, and a sequential reader of gzip members.

Writing: each partition becomes one archive file, one gzip member for each record
(WARC/1.1), put under a temporary name and renamed, so a task that runs twice
replaces its own file. Reading: members are inflated incrementally, record
headers are parsed, the block is framed by Content-Length, and the payload's digest and
length are checked against the header. A revisit holds no payload: ``check`` looks its
digest and length up at the response that it refers to.

Of records with equal payloads of at least ``REVISIT_FROM`` bytes, the one with
the largest id is written as ``response`` and the others as ``revisit`` with an
empty payload that refers to it. Digests are computed by Spark; the largest id of
each digest that repeats is an aggregate. Up to ``SMALL_REPEATS`` such digests (counted
first) are broadcast, so payloads aren't shuffled; beyond, they are joined over a salt, so
that a payload that fills a third of the table is spread over ``SALTS`` tasks.

Files go through pyarrow's file systems by the URI of the folder, which has to be
one that driver and executors share.

Defined cases: a null payload is an empty one; null ids are below all others;
rows that repeat the id of the response are responses as well; one Arrow batch
of records is held in memory at a time, read back one record at a time; other columns are ignored, whatever their names; an
empty table writes no records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import scratch, written

REVISIT_FROM = 1000
SALTS = 32
SMALL_REPEATS = 200_000
READ = 1 << 16
VERSION = b"WARC/1.1\r\n"
#: The archives' date; a fixed one keeps reruns byte for byte the same.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", small: int = SMALL_REPEATS) -> DataFrame:
    """(page_id, url, payload, digest, payload_bytes, refers_to): refers_to is null for responses."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    large = F.col("payload_bytes") >= REVISIT_FROM
    first = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "warc-repeats")
    if first.limit(small + 1).count() <= small:
        joined = rows.join(F.broadcast(first), "digest", "left")
    else:
        first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("salt", salt).join(first, ["digest", "salt"], "left")
    other = large & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", "payload_bytes", F.when(other, F.col("first")).alias("refers_to"))


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record, headers and block, not yet compressed."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (b"" if revisit else payload)
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _one_line(url or "")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _many_lines(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member of its own, without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(records: DataFrame, folder: str) -> int:
    """Write one archive for each partition of ``records`` (see with_revisits); how many records were written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        name = f"{path}/part-{context.partitionId():06d}.warc.gz"
        draft = f"{path}/_draft-{context.partitionId():06d}-{context.taskAttemptId()}"
        n, out = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                out = out or fs.open_output_stream(draft)
                out.write(member(record_bytes(*row)))
                n += 1
        if out:
            out.close()
            fs.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    slim = records.select("page_id", "url", "payload", "digest", "refers_to")
    return slim.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def members(data) -> Iterator[bytes]:
    """The members of a gzip file, each inflated in steps of READ bytes; ``data`` has read(n)."""
    z, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        piece = rest or data.read(READ)
        if not piece:
            if parts or z.unconsumed_tail:
                raise ValueError("the archive ends inside a member")
            return
        parts.append(z.decompress(piece))
        rest = b""
        if z.eof:
            rest = z.unused_data
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; checks the framing."""
    head, mark, body = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not mark:
        raise ValueError("not a WARC record")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        headers[k.strip().lower().decode()] = v.strip().decode()
    n = int(headers["content-length"])
    if len(body) != n + 4 or body[n:] != b"\r\n\r\n":
        raise ValueError("the block's length differs from Content-Length")
    return headers, body[:n]


READ_SCHEMA = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload binary, "
    "payload_bytes bigint, payload_digest string, digest_ok boolean"
)


def _records(data) -> Iterator[tuple]:
    for raw in members(data):
        headers, block = parse_record(raw)
        payload = block.partition(b"\r\n\r\n")[2]
        said = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
        own = headers["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
        refers = headers.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
        size, digest, ok = len(payload), hashlib.sha1(payload, usedforsecurity=False).hexdigest(), True
        if headers["warc-type"] == "revisit":
            ok = not payload
            size, digest = int(headers["x-payload-length"]), said
        else:
            ok = digest == said and size == int(headers.get("x-payload-length", size))
        yield (
            int(own) if own else None, _many_lines(headers["warc-target-uri"]), headers["warc-type"], int(refers) if refers else None,
            payload, size, digest, ok,
        )


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of a folder's archives; a revisit's payload is empty, its digest and length are the full payload's.

    An archive is one row of the scan and is streamed record by record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()),
        ])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            fs, base = pyarrow.fs.FileSystem.from_uri(folder)
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                name = f"{base.rstrip('/')}/{path.rpartition('/')[2]}"
                with fs.open_input_stream(name, compression=None) as data:
                    for row in _records(data):
                        rows.append(row if payloads else (*row[:4], None, *row[5:]))
                        held += len(row[4]) if payloads else 100
                        if held > 1 << 22:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")
    n = max(1, files.count())
    return files.repartition(n, "path").mapInArrow(run, READ_SCHEMA)


def check(records: DataFrame) -> None:
    """Raise if a record fails its digest or length, or a revisit has no response with its digest and length."""
    failed = records.where("NOT digest_ok").select("page_id").limit(5).collect()
    if failed:
        raise ValueError(f"records whose payload differs from their headers: {[r.page_id for r in failed]}")
    claims = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest", "payload_bytes").distinct()
    held = records.where("record_type = 'response'").select("page_id", "payload_digest", "payload_bytes").distinct()
    lost = claims.join(held, ["page_id", "payload_digest", "payload_bytes"], "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"revisits without their response: {[r.page_id for r in lost]}")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.session import table

    folder = scratch(spark, "warc")
    write_archives(with_revisits(table(spark, sf_dir, "pages")), folder)
    back = written(read_archives(spark, folder, payloads=False).drop("payload"), "warc-records")
    check(back)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to, true AS digest_ok
FROM f
"""
