"""WARC records in a chunked record table.

A record is a run of rows (record, chunk_no): joined in that order, their data are the WARC/1.1 bytes of the record, and
the rows of a file those of an archive. A payload is cut into parts of CHUNK bytes before it reaches the writer, which so
holds a batch of parts and no record; it carries the payload's SHA-1 from row to row, each row has the digest up to its
end, and a reader that finds another one stops there. Of records with equal payloads the one with the least page_id holds
the payload; the others are revisits that name it, written without their payloads being moved.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.llm import bloom
from sparkvec.llm.common import Scratch, join_groups, shared_folder, ship_code, table, text_or_empty

#: Bytes of payload in a row at most, and the least payload that a revisit may stand for.
CHUNK, LEAST = 64 << 10, 0
#: The date that every record bears, so that archives of the same pages are the same.
DATE = "2024-01-01T00:00:00Z"

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_TABLE = "record string, page_id long, chunk_no int, n_chunks int, so_far binary, data binary"
_ROWS = pa.schema([("record", pa.string()), ("page_id", pa.int64()), ("chunk_no", pa.int32()), ("n_chunks", pa.int32()), ("so_far", pa.binary()), ("data", pa.binary())])
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, key: bytes, uid: int | None) -> str:
    """The urn of a page's record: of its response to a payload's key, or of the revisit in row uid."""
    h = hashlib.sha1(f"page {page_id} payload {key.hex()} row {uid}".encode()).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def header(page_id: int | None, url: str | None, key: bytes, n: int, uid: int | None, refers_to: int | None) -> bytes:
    """The bytes of a record before its payload of n bytes; a revisit has a uid and no payload. The key begins with the
    payload's SHA-1."""
    revisit = uid is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id, key, uid)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}"]
    lines += [f"WARC-Payload-Digest: sha1:{_base32(key[:20])}", f"X-Payload-Length: {n}"]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, key, None)}>", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(_HTTP) + (0 if revisit else n)}", "", ""]
    return "\r\n".join(lines).encode() + _HTTP


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the table from parts of payloads; those of a record follow each other."""
    sha = hashlib.sha1()
    for batch in batches:
        names, numbers, ends, data = [], [], [], []
        others = (batch.column(c).to_pylist() for c in ("page_id", "url", "key", "n", "uid", "refers_to", "n_chunks", "chunk_no"))
        for page, url, key, n, uid, refers_to, n_chunks, c, part in zip(*others, batch.column("part"), strict=True):
            own = memoryview(part.as_buffer() or b"")
            if c == 0:
                sha = hashlib.sha1()
            sha.update(own)
            names.append(record_id(page, key, uid))
            numbers.append(c)
            ends.append(sha.digest())
            data.append(b"".join((header(page, url, key, n, uid, refers_to) if c == 0 else b"", own, b"\r\n\r\n" if c == n_chunks - 1 else b"")))
        yield pa.RecordBatch.from_arrays([pa.array(names), batch.column("page_id"), pa.array(numbers, pa.int32()), batch.column("n_chunks"), pa.array(ends, pa.binary()), pa.array(data, pa.binary())], schema=_ROWS)


def write_archives(pages: DataFrame, folder: str) -> None:
    """A record for each row of pages (page_id, url, html; null html: empty) in the table at folder.

    Repeated rows give a response and revisits of it. A null page_id is larger than any other; of rows that share the least
    page_id, that with the least url is the response. No rows give an empty table; other columns are ignored. Only rows
    whose payload a Bloom filter finds possibly repeated move, once each task has reduced equal payloads to one.
    """
    spark = pages.sparkSession
    ship_code(spark)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(text_or_empty("html"), "utf-8").alias("html"))
    # Payloads are equal if their SHA-1, another hash and their length are.
    digested = own.withColumn("n", F.octet_length("html").cast("long")).withColumn("key", F.unhex(F.concat(F.sha1("html"), F.lpad(F.hex(F.xxhash64("html")), 16, "0"), F.lpad(F.hex("n"), 16, "0"))))
    place = F.struct(F.col("page_id").isNull().alias("last"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    with Scratch(spark) as scratch:
        narrow = scratch.stage(digested.select("page_id", "url", "key", "n", F.monotonically_increasing_id().alias("uid")), "digests")
        total = narrow.count()
        shared = narrow.where(F.col("n") >= LEAST)
        first = shared.groupBy("key").agg(F.min(F.struct(place.alias("place"), "uid")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
        groups = scratch.stage(first.select("key", "c", F.col("first.place.page_id").alias("refers_to"), F.col("first.uid").alias("_uid")), "groups")
        again = join_groups(shared, groups, "key", "c", total).where("uid <> _uid").select("page_id", "url", "key", "n", "uid", "refers_to", F.lit(1).alias("n_chunks"), F.lit(0).alias("chunk_no"), F.lit(b"").alias("part"))
        bits = bloom.filter_bits(total)
        marked = bloom.mark_repeated(digested, bloom.repeated_words(shared.select("key"), "key", bits), "key", bits, "maybe")
        several = F.col("maybe") & (F.col("n") >= LEAST)
        one = marked.where(several).groupBy("key").agg(F.min_by(F.struct("page_id", "url", "html", "n"), place).alias("r")).select("r.*", "key")
        held = marked.where(~several).select("page_id", "url", "html", "n", "key").unionByName(one).withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK)).cast("int"))
        cut = held.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).withColumn("part", F.substring("html", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK)))
        responses = cut.select("page_id", "url", "key", "n", F.lit(None).cast("long").alias("uid"), F.lit(None).cast("long").alias("refers_to"), "n_chunks", "chunk_no", "part")
        responses.unionByName(again).mapInArrow(_written, _TABLE).write.option("compression", "zstd").parquet(folder)


class _Reader:
    """Takes a record's rows in order; at its last row, what the record says and what its payload gave."""

    def __init__(self) -> None:
        self.sha, self.n, self.next, self.head, self.left = hashlib.sha1(), 0, 0, {}, 0

    def take(self, chunk_no: int, n_chunks: int, so_far: bytes, data: memoryview) -> tuple | None:
        if chunk_no == 0:
            raw = bytes(data)  # the first row holds the whole header, however long
            head = raw[: raw.index(b"\r\n\r\n")]
            self.head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
            data = data[len(head) + 4 + len(_HTTP) :]
            self.sha, self.n, self.next, self.left = hashlib.sha1(), 0, 0, int(self.head["Content-Length"]) - len(_HTTP)
        if chunk_no != self.next:
            raise ValueError(f"chunk {self.next} of {self.head.get('WARC-Record-ID')} is missing")
        part = data[: min(len(data), self.left)]
        self.sha.update(part)
        self.n, self.left, self.next = self.n + len(part), self.left - len(part), self.next + 1
        if self.sha.digest() != so_far:
            raise ValueError(f"chunk {chunk_no} of {self.head['WARC-Record-ID']} is damaged")
        if self.next < n_chunks:
            return None
        kind, stated = self.head["WARC-Type"], self.head["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "revisit":
            target = self.head["X-Refers-To-Page"]
            return int(self.head["X-Payload-Length"]), stated, kind, int(target) if target else None
        if self.left or _base32(self.sha.digest()) != stated:
            raise ValueError(f"{self.head['WARC-Record-ID']} is damaged")
        return self.n, _base32(self.sha.digest()), kind, None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _Reader()
    for batch in batches:
        out = []
        pages, numbers, counts = (batch.column(c).to_pylist() for c in ("page_id", "chunk_no", "n_chunks"))
        for page, c, n, so_far, data in zip(pages, numbers, counts, batch.column("so_far"), batch.column("data"), strict=True):
            found = reader.take(c, n, so_far.as_py(), memoryview(data.as_buffer()))
            if found:
                out.append((page, *found))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _READ.split(", ")])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Per record of the table: page_id, payload_bytes, payload_digest (of the full payload, also for revisits), record_type, refers_to.

    Records of one row are read where they lie; only rows of larger ones move, to be digested in order.
    """
    ship_code(spark)
    rows = spark.read.schema(_TABLE).parquet(folder)
    small = rows.where("n_chunks = 1")
    large = rows.where("n_chunks > 1").repartition("record").sortWithinPartitions("record", "chunk_no")
    return small.mapInArrow(_read, _READ).unionByName(large.mapInArrow(_read, _READ))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder)


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, h, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
bits AS (SELECT page_id, h, first, list_transform(range(32), lambda k: list_reduce(list_transform(range(5), lambda j:
    CAST(((strpos('0123456789abcdef', substr(x, CAST((5 * k + j) // 4 AS INTEGER) + 1, 1)) - 1) >> CAST(3 - (5 * k + j) % 4 AS INTEGER)) & 1 AS INTEGER)), lambda a, b: 2 * a + b)) AS five FROM d)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(five, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM bits
"""
