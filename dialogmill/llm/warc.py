"""WARC archives: repeated payloads become revisit records, written and read back by Spark."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmill.llm.common import map_arrow, scratch_path, table

CRLF = "\r\n"
END = CRLF * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ADDRESS = "urn:x-no-address:"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: A gzip member of no bytes; it stands between the members of two records, so that Spark's text reader can part them.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
LEVEL = 4
#: Bytes of records that a task reads or writes together.
HELD = 8 << 20


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to, refers_to_url), a row for each page.

    Of pages with equal payloads (SHA-1 and length) of at least ``min_bytes`` bytes, the one with the largest
    id is the response and the others revisit it. Smaller payloads are all responses. A null
    payload is an empty one. Rows that repeat the largest id are responses too; a row with a null id
    revisits unless all ids of its group are null. An empty table gives an empty table.

    Only headers (id, digest, length) meet by digest; the digests that repeat are joined to them, and the revisits
    found are joined to the pages by id and digest, so a payload of many pages lies in no one place.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    heads = rows.where(F.col("payload_bytes") >= min_bytes).select("page_id", "url", "payload_digest", "payload_bytes")
    repeated = (
        heads.groupBy("payload_digest", "payload_bytes")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("refers_to"), F.max_by("url", "page_id").alias("refers_to_url"))
        .where((F.col("n") > 1) & F.col("refers_to").isNotNull())
        .drop("n")
    )
    revisits = heads.join(repeated, ["payload_digest", "payload_bytes"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), "refers_to", "refers_to_url").distinct()
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("payload_digest") == F.col("__digest")), "left")
    return joined.select("page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(F.col("__digest").isNotNull(), "revisit").otherwise("response").alias("record_type"), "refers_to", "refers_to_url")


def _member(record: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{"" if page_id is None else page_id}|{digest}'.encode()).hexdigest())}>"


def _address(url: str | None, page_id: int | None) -> str:
    return NO_ADDRESS + str(page_id) if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def format_record(row: dict, date: str) -> bytes:
    """The record of a row of ``resolve_revisits``: headers, and for a response the payload behind its HTTP headers."""
    body = row["payload"].encode() if row["record_type"] == "response" else b""
    block = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {row['payload_bytes']}{END}".encode() + body
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_record_id(row['page_id'], row['payload_digest'])}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_address(row['url'], row['page_id'])}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}", f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if row["record_type"] == "revisit":
        head += [
            f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(row['refers_to'], row['payload_digest'])}", f"WARC-Refers-To-Target-URI: {_address(row['refers_to_url'], row['refers_to'])}",
            f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {row['refers_to']}",
        ]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return CRLF.join(head).encode() + END.encode() + block + END.encode()


def write_archives(resolved: DataFrame, path: str, date: str = "2025-01-01T00:00:00Z") -> None:
    """WARC/1.1 archives under ``path``, one for each partition: a warcinfo record and one for each row of ``resolve_revisits``.

    Each record is a gzip member of its own, and an empty member stands behind it. A revisit has no payload; it names the response's record, address, page and
    digest. The page's id is kept in a header of its own, left out if null; a null address becomes a
    urn; line breaks in addresses are escaped. Spark ends the names in ``.txt``; ``name_archives`` makes that ``.warc.gz``.
    An archive holds what one partition does, so Spark's partition sizes bound it.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = f"software: dialogmill{CRLF}format: WARC File Format 1.1{CRLF}".encode()
        info = f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>{CRLF}WARC-Date: {date}{CRLF}Content-Type: application/warc-fields{CRLF}Content-Length: {len(fields)}{END}".encode()
        members, held, first = [], 0, True
        for batch in batches:
            for k in range(len(batch)):
                if first:
                    members, first = [_member(info + fields + END.encode())], False
                members.append(_member(format_record(batch.slice(k, 1).to_pylist()[0], date)))
                held += len(members[-1])
                if held > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["value"])
                    members, held = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["value"])

    packed = map_arrow(resolved, pack, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def name_archives(spark: SparkSession, path: str) -> None:
    """Renames the archives to ``.warc.gz``, for other readers; ``read_archives`` takes the names that Spark gave."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            files.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.gz"))


def parse_record(record: bytes, with_payload: bool = True) -> tuple | None:
    """A record as a row of RECORD, by its Content-Length; a response's digest and length are those of what was read. None for warcinfo."""
    split = record.index(END.encode())
    lines = record[:split].decode().split(CRLF)
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record begins here")
    head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    if head["warc-type"] == "warcinfo":
        return None
    begin = split + 4
    payload = record[record.index(END.encode(), begin) + 4 : begin + int(head["content-length"])]
    number = lambda k: int(head[k]) if k in head else None
    response = head["warc-type"] == "response"
    digest = hashlib.sha1(payload).hexdigest() if response else base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
    url = None if head["warc-target-uri"].startswith(NO_ADDRESS) else head["warc-target-uri"]
    return number("x-page-id"), url, head["warc-type"], digest, len(payload) if response else number("x-payload-length"), number("x-refers-to-page"), payload if response and with_payload else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The page records of all archives under ``path``: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload.

    Archives are read record by record and large ones by several tasks, so the size of an archive sets no limit. An archive of no
    pages gives no rows; what was null or repeated in the pages is so again, with null payloads read as empty ones.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for member in batch.column(0):
                record = parse_record(zlib.decompress(member.as_py(), 31), with_payload)
                if record:
                    rows.append(record)
                    held += len(record[-1] or b"") + 200
                if held > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    members = spark.read.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)
    return map_arrow(members.select(F.col("value").cast("binary")), parse, RECORD)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(resolve_revisits(table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS original FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM m
"""
