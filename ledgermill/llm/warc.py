"""WARC archives: a writer with payload de-duplication, and a sequential reader.

Writing: every record is a gzip member of its own.  Members are gathered into chunks of about ``CHUNK`` bytes; each chunk
becomes one file through Spark's text sink, so archives land wherever Spark can write and only committed tasks' files
count.  The sink ends a file with its line separator, which is set to one more gzip member: a fixed metadata record that
marks the archive's end.  The digest of a payload decides which page holds it: the one with the largest id keeps the
payload as a response, the others become revisit records that refer to it.  Only (digest, id) pairs are grouped, with
partial aggregation.  Digests of more than a ``HOT_PART`` of all pages, so fewer than that many, are looked up in the page's
own task; the others, none of them large, join by a shuffle on their digest.  So a payload that a third of all pages share is no hot group.

Reading: files come as binary rows.  A member is decompressed incrementally, a record is framed by its headers' blank
line and Content-Length, block and payload digests are verified.

Defined cases: a null payload is empty; pages with equal payloads and the same largest id are all responses; a null id
never holds a payload unless all ids of its group are null; a null URL is left out of the record and read back as null;
columns other than the three are ignored; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm.common import new_path, stash

CHUNK = 8 << 20
SLICE = 1 << 16
DATE = "1970-01-01T00:00:00Z"
LEVEL = 4
#: A digest is hot if more than one page in so many has it.
HOT_PART = 2_000
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, verified boolean"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def page_urn(page_id) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


#: Ends every archive; the same bytes each time.
END = member(record("metadata", "urn:end-of-archive", [("Content-Type", "application/warc-fields")], b""))


def page_record(page_id: int | None, url: str | None, payload: bytes, holder: int | None) -> bytes:
    """A response, or a revisit of the page ``holder`` where that is another page."""
    revisit = page_id != holder
    fields = [("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=~"))] if url is not None else []
    fields += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{page_urn(holder)}>")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", page_urn(page_id), fields, http if revisit else http + payload)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
    for batch in batches:
        for page_id, url, payload, holder in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "holder")), strict=True):
            held.append(member(page_record(page_id.as_py(), url.as_py(), payload.as_py() or b"", holder.as_py())))
            size += len(held[-1])
            if size >= CHUNK:
                yield out()
                held.clear()
                size = 0
    if held:
        yield out()


def write(pages: DataFrame, path: str, hot_part: int = HOT_PART) -> None:
    """Archive pages (page_id, url, html) under ``path``, equal payloads once."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    counts = stash(base.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("pages")), "holders")
    hot = counts.where(F.col("pages") > counts.agg(F.sum("pages")).first()[0] / hot_part) if not counts.isEmpty() else counts
    marked = base.join(F.broadcast(hot.select("digest", F.col("holder").alias("hot_holder"), F.lit(True).alias("hot"))), "digest", "left")
    # A page with a hot digest knows its holder; its key meets nothing and only deals it evenly.
    key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.xxhash64("page_id", "url").cast("string"))
    joined = (
        marked.withColumn("key", key)
        .join(counts.select(F.col("digest").alias("key"), "holder").hint("shuffle_hash"), "key", "left")
        .select("page_id", "url", "payload", F.coalesce("hot_holder", "holder").alias("holder"))
    )
    made = joined.mapInArrow(chunks, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", END.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def members(content: bytes) -> Iterator[Iterator[bytes]]:
    """The gzip members of an archive in order, each as an iterator over its decompressed slices."""
    view, at = memoryview(content), 0

    def slices() -> Iterator[bytes]:
        nonlocal at
        z = zlib.decompressobj(31)
        while not z.eof:
            part = view[at : at + SLICE]
            if not part:
                raise ValueError("the archive ends inside a gzip member")
            at += len(part)
            data = z.decompress(part)
            if z.eof:
                at -= len(z.unused_data)
            if data:
                yield data

    while at < len(view):
        part = slices()
        yield part
        for _ in part:  # what the caller left of it
            pass


def frame(slices: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the record that a member holds."""
    held = bytearray()
    while (end := held.find(b"\r\n\r\n")) < 0:
        data = next(slices, None)
        if data is None:
            raise ValueError("a record without the end of its header")
        held += data
    version, *lines = held[:end].decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    del held[: end + 4]
    for data in slices:
        held += data
    n = int(fields["content-length"])
    if held[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is not its Content-Length")
    return fields, bytes(held[:n])


def parsed(content: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA from the response and revisit records of an archive; one that can't be framed raises."""
    for part in members(content):
        fields, block = frame(part)
        kind = fields["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next(int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length")
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        good = fields["warc-block-digest"] == f"sha1:{base32_sha1(block)}" and (kind == "revisit" or (len(payload) == length and base32_sha1(payload) == digest))
        number = lambda urn: None if urn.strip("<>") == "urn:page:null" else int(urn.strip("<>").removeprefix("urn:page:"))
        uri = fields.get("warc-target-uri")
        refers = fields.get("warc-refers-to")
        yield number(fields["warc-record-id"]), None if uri is None else unquote(uri), length, digest, kind, None if refers is None else number(refers), payload if kind == "response" else None, good


def reader(with_payload: bool):
    def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                size = 0
                for row in parsed(content.as_py()):
                    rows.append(row if with_payload else (*row[:6], None, row[7]))
                    size += row[2] if with_payload else 0
                    if size >= CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return read_batches


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(reader(with_payload), SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages in the shared folder and read the records back; a digest that doesn't match fails the job."""
    spark, path = pages.sparkSession, new_path(pages.sparkSession, "warc")
    write(pages, path)
    sound = F.when(F.col("verified"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("digest mismatch in record of page "), F.col("page_id").cast("string"))))
    return read(spark, path, with_payload=False).select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to", "url")


#: The records' digest in DuckDB; base32 takes five bits of the hash at a time.
ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
n AS (SELECT *, list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', h[i]) - 1) AS x, max(page_id) OVER (PARTITION BY html) AS holder FROM p)
SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((x[(5 * j) // 4 + 1] * 16 + x[(5 * j) // 4 + 2]) >> CAST(3 - (5 * j) % 4 AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
 CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> holder THEN holder END AS refers_to FROM n"""
