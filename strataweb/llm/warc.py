"""WARC archives: a writer with revisit records, and a reader whose tasks split archives anywhere.

Each record is a gzip member. A reading task has a range of bytes of an archive; it looks for gzip's
magic there, takes a candidate for a member if it inflates to a WARC header, and owns the records that
start inside its range, reading on beyond its end for the last of them.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

MAGIC, VERSION, END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
#: Bytes of an archive that a task reads, and that it reads at once.
SPLIT, BLOCK = 32 << 20, 1 << 20
#: Tasks that read archives, at most; they are as many as splits of all bytes, small archives sharing one.
TASKS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One gzip member: a response record, or a revisit record of the page refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": date, "WARC-Payload-Digest": f"sha256:{digest}"}
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": PROFILE}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + END) + packer.flush()


def _writer(folder: str):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, top = fs.FileSystem.from_uri(folder)
        name, size, n, out = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz", 0, 0, None
        for b in batches:
            for page_id, url, html, digest, refers_to in zip(*(x.to_pylist() for x in b.columns)):
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                data = record(page_id, url, c.encoded(html or ""), digest, refers_to)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    return each


def write(pages: DataFrame, folder: str) -> DataFrame:
    """(path, bytes, records) of the archives that pages (page_id, url, html) are written to.

    A null html is an empty payload. Of records with equal payloads of at least REVISIT_BYTES bytes the
    one with the smallest page_id is the response; rows that share that page_id are responses too, and
    so are rows without one. Other columns aren't read; no rows make no archive. An archive's
    name holds its task's attempt: what a lost attempt wrote isn't in the list.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    same = rows.filter(F.octet_length("html") >= REVISIT_BYTES).select("page_id", "digest")
    first = same.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    revisits = same.join(first, "digest").filter("page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    rows = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    return c.cut(rows.mapInArrow(_writer(folder), "path string, bytes long, records long"))


def parsed(data: bytes) -> tuple:
    """READ's columns of one inflated record."""
    head, _, block = data.partition(END)
    field = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = block[: int(field["Content-Length"])]
    http, _, payload = block.partition(END)
    number = lambda x: int(v) if x and (v := x.removeprefix("<urn:page:").removesuffix(">")) else None
    digest, kind = field["WARC-Payload-Digest"].removeprefix("sha256:"), field["WARC-Type"]
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {field['WARC-Record-ID']} isn't what its headers say")
    return number(field["WARC-Record-ID"]), field.get("WARC-Target-URI"), size, digest, kind, number(field.get("WARC-Refers-To")), payload if kind == "response" else None


def _inflated(source: pa.NativeFile, at: int, block: bytes) -> tuple[bytes, int] | None:
    """What the member at this place holds and where it ends, or None if none with a WARC header begins there."""
    unpack, data, got = zlib.decompressobj(31), [], 0
    try:
        while not unpack.eof:
            if not block:
                block = source.read_at(BLOCK, at) if at < source.size() else b""
                if not block:
                    return None
            data.append(unpack.decompress(block))
            got += len(data[-1])
            if got >= len(VERSION) and not (data[0] if len(data[0]) >= len(VERSION) else b"".join(data)).startswith(VERSION):
                return None
            at, block = at + len(block), b""
    except zlib.error:
        return None
    whole = b"".join(data)
    return (whole, at - len(unpack.unused_data)) if whole.startswith(VERSION) and END in whole else None


def records(source: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """The inflated records that start in bytes start to end of an archive."""
    at, base, block = start, start, b""
    while at < end:
        if at < base or at + len(MAGIC) > base + len(block):
            base, block = at, source.read_at(max(0, min(BLOCK, source.size() - at)), at)
        k = block.find(MAGIC, at - base)
        if k < 0:
            if base + len(block) >= min(end + len(MAGIC), source.size()):
                return
            at = max(at + 1, base + len(block) - len(MAGIC) + 1)
        elif base + k >= end:
            return
        elif found := _inflated(source, base + k, block[k:]):
            yield found[0]
            at = found[1]
        else:
            at = base + k + 1


def _reader(payload: bool):
    names = [x.split()[0] for x in READ.split(", ")][: None if payload else -1]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k, _ in zip(zip(*rows), kinds, names)], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end in zip(*(x.to_pylist() for x in b.columns)):
                store, at = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_file(at) as source:
                    for data in records(source, start, end):
                        rows.append(parsed(data))
                        size += len(data) if payload else 256
                        if size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return each


def read(archives: DataFrame, split: int = SPLIT, payload: bool = True) -> DataFrame:
    """READ's columns, a row for each record of the archives (path, bytes); no archives give no rows.

    A member that is cut short, broken or not headed as a WARC record is none. Records are returned as often as they are
    written, empty payloads too; other columns aren't read.
    """
    parts = archives.filter("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"), "bytes")
    parts = parts.select("path", "start", F.least(F.col("start") + split, F.col("bytes")).alias("end"))
    # Rows of a few bytes, each a split to read: a set number of tasks, as adaptive execution would put all in one.
    total = archives.agg(F.sum("bytes")).first()[0] or 1
    parts = parts.repartition(max(1, min(TASKS, -(-total // split))))
    schema = READ if payload else READ.rpartition(",")[0]
    return parts.mapInArrow(_reader(payload), schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{c.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    found = read(write(c.table(spark, sf_dir, "pages"), folder), payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
