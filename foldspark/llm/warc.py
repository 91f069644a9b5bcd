"""WARC archives: writing, reading back, and revisit resolution by payload digest.

Records are built and written by Spark's text writer, whose line separator is the blank lines that end a WARC record, so
every output file is one gzipped archive of whole records (one gzip member a file). Files are bounded by bytes: a task
sorts its records by classes of payload size and numbers them, and the larger the class the fewer go to a file, all in
one pass over the records. Reading parses records by their Content-Length, file by file in tasks, one
record in memory at a time, and recomputes every payload's digest.

Resolution shuffles headers only: records of equal digest and at least ``min_bytes`` bytes are grouped with partial
aggregation, the smallest id becomes the response and the other records revisit it. Payloads are not shuffled while the
table of repeated digests is small (its bytes, urls included, decide); above ``BROADCAST_BYTES`` of them the join shuffles
the rows, where adaptive execution splits a digest that very many records share.

Headers are written afresh: the time of writing, a record id made from page id, digest and type (``urn:uuid:``), and in
revisits the id, url and time of the response. The page id has a header of its own.

Edge cases: a null payload is empty; short payloads are always responses. A record without id takes part as a revisit if
another record of its digest has an id, else it is a response. Repeated rows with the smallest id are all responses. A
page id may repeat with other payloads: responses are told apart by id and digest. A null url has no target line; control
characters and blanks in urls are percent-encoded, each by its own value. No rows: no records.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import BROADCAST_BYTES, cut, new_path

#: Record syntax.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PAGE = "X-Page-ID"
#: Records of one archive file at most (a power of two), and bytes of a payload up to which a file holds that many. For
#: every doubling of the payload a file holds half as many, one at least.
FILE_RECORDS, SMALL = 2048, 1 << 16
_RECORDS = (
    "page_id bigint, url string, record_type string, refers_to bigint, refers_url string, payload_digest string, "
    "payload_bytes bigint, payload string"
)


def with_headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    page, url = F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url")
    rows = pages.select(page, url, payload.alias("payload"))
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha2("payload", 256)})


def originals(headers: DataFrame, min_bytes: int) -> DataFrame:
    """payload_digest, response_id, response_url: of digests that occur more than once, the record that holds it."""
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    grouped = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), first)
    found = grouped.where("n > 1 and first is not null")
    found = found.select("payload_digest", F.col("first.page_id").alias("response_id"), F.col("first.url").alias("response_url"))
    return cut(found, "originals")


def resolve(records: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Add record_type, refers_to and refers_url to rows of ``with_headers``."""
    first = originals(records.select("page_id", "url", "payload_digest", "payload_bytes"), min_bytes)
    # A row is its digest, id and url, and about 100 bytes of a hash table.
    size = first.agg(F.sum(F.octet_length("payload_digest") + F.coalesce(F.octet_length("response_url"), F.lit(0)) + 100)).first()[0] or 0
    joined = records.join(F.broadcast(first) if size <= BROADCAST_BYTES else first, "payload_digest", "left")
    again = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("response_id")).alias("refers_to"),
        F.when(again, F.col("response_url")).alias("refers_url"),
    )


def header_url(url: Column) -> Column:
    """``url`` with control characters and blanks percent-encoded, each by its own value."""
    plain = [*range(33), 127]
    coded = F.array(*(F.struct(F.lit(chr(c)).alias("c"), F.lit(f"%{c:02X}").alias("p")) for c in plain))
    whole = F.aggregate(coded, url, lambda held, x: F.replace(held, x["c"], x["p"]))
    return F.when(F.regexp_like(url, F.lit("[\\x00-\\x20\\x7f]")), whole).otherwise(url)


def record_id(page_id: Column, digest: Column, kind: str) -> Column:
    """A name-based UUID of a record; records that repeat in every part have equal ids."""
    name = F.sha1(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("none")), digest))
    hexes = F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4))), F.concat(F.lit("5"), F.substring(name, 14, 3)), F.concat(F.lit("8"), F.substring(name, 18, 3)), F.substring(name, 21, 12))
    return F.concat(F.lit("<urn:uuid:"), hexes, F.lit(">"))


def write_archives(records: DataFrame, path: str, date: str | None = None, file_records: int = FILE_RECORDS) -> None:
    """Write rows of ``resolve`` as gzipped WARC files, with fresh headers; ``date`` is the time of writing if null."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("record_type") == "revisit"
    end = F.lit("\r\n")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, end), F.lit(""))

    digest = F.col("payload_digest")
    own = F.when(revisit, record_id(F.col("page_id"), digest, "revisit")).otherwise(record_id(F.col("page_id"), digest, "response"))
    referred = F.concat(
        line("WARC-Refers-To", record_id(F.col("refers_to"), digest, "response")),
        line("WARC-Refers-To-Target-URI", header_url(F.col("refers_url"))),
        line("WARC-Refers-To-Date", F.lit(date)),
        line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        line("WARC-Profile", F.lit(PROFILE)),
    )
    record = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", own),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", header_url(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        line(PAGE, F.col("page_id").cast("string")),
        F.when(revisit, referred).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.when(revisit, 0).otherwise(F.col("payload_bytes")) + len(HTTP)).cast("string")),
        end,
        F.lit(HTTP),
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    doublings = F.ceil(F.log2(F.greatest(F.col("payload_bytes"), F.lit(SMALL)) / SMALL)).cast("int")
    rows = records.select(record.alias("value"), F.when(revisit, 0).otherwise(doublings).alias("size"))
    # Rows of a task are numbered in the order of their classes; as many as fit go to one file.
    rows = rows.sortWithinPartitions("size").withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    most = F.greatest(F.lit(1.0), F.floor(file_records / F.pow(F.lit(2.0), F.col("size"))))
    rows = rows.select("value", "size", F.floor(F.col("row") / most).alias("file"))
    rows.write.partitionBy("size", "file").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _inflate(content: bytes) -> Iterator[bytes]:
    """Pieces of a gzip file of one or more members."""
    at, step = 0, 1 << 20
    while at < len(content):
        member = zlib.decompressobj(wbits=31)
        while at < len(content) and not member.eof:
            piece = content[at : at + step]
            yield member.decompress(piece)
            at += len(piece)
        if not member.eof:
            raise ValueError("a gzip member ends early")
        at -= len(member.unused_data)


class _Reader(io.RawIOBase):
    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not len(self.held):
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.held = memoryview(piece)
        n = min(len(into), len(self.held))
        into[:n], self.held = self.held[:n], self.held[n:]
        return n


def parse_archive(content: bytes) -> Iterator[dict]:
    """The records of one gzipped archive: headers by lower-case name, and ``block``."""
    f = io.BufferedReader(_Reader(_inflate(content)), 1 << 16)
    while line := f.readline():
        if not line.strip():
            continue
        if line.strip() != VERSION.encode():
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        headers = {}
        while line := f.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode()
        length = int(headers["content-length"])
        block = f.read(length)
        if len(block) != length:
            raise ValueError("a record ends early")
        yield headers | {"block": block}


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row for each record, revisits with the length of the response they refer to; payload null unless asked for."""

    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("refers_url", pa.string()),
            ("payload_digest", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload", pa.string()),
        ]
    )

    def row(r: dict) -> dict:
        payload = r["block"].partition(b"\r\n\r\n")[2]
        own, other = (r.get(h.lower()) for h in (PAGE, "X-Refers-To-Page-ID"))
        digest = r["warc-payload-digest"].removeprefix("sha256:")
        response = r["warc-type"] == "response"
        if response and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the digest of {r['warc-record-id']} doesn't fit its payload")
        return {
            "page_id": own and int(own),
            "url": r.get("warc-target-uri"),
            "record_type": r["warc-type"],
            "refers_to": other and int(other),
            "refers_url": r.get("warc-refers-to-target-uri"),
            "payload_digest": digest,
            "payload_bytes": len(payload) if response else None,
            "payload": payload.decode() if payloads and response else None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for r in parse_archive(content.as_py()):
                    rows.append(row(r))
                    held += len(r["block"]) * payloads
                    if len(rows) >= 1000 or held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True)
    return files.load(path).select("content").mapInArrow(run, _RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records read back, each revisit joined to its response (by id and digest) for the payload's length."""
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes")
    responses = records.where("record_type = 'response'")
    lengths = responses.where(F.col("page_id").isNotNull()).groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
    lengths = lengths.agg(F.max("payload_bytes").alias("payload_bytes"))
    return responses.unionByName(revisits.join(lengths, ["refers_to", "payload_digest"], "left"))


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 100) -> DataFrame:
    """Rewrite archives so that each payload is stored once; returns the new records."""
    read = read_archives(spark, source, payloads=True)
    known = resolved(read)
    full = read.where("record_type = 'response'").select("page_id", "url", F.col("payload").alias("html"))
    kept = ("payload_bytes", "payload_digest", "record_type", "refers_to", "refers_url")
    old = known.where("record_type = 'revisit'").select("page_id", "url", F.lit("").alias("payload"), *kept)
    write_archives(resolve(with_headers(full), min_bytes).unionByName(old), target)
    return resolved(cut(read_archives(spark, target), "records"))


def archive_pages(
    pages: DataFrame,
    min_bytes: int = 100,
    path: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> DataFrame:
    """Write one record for every page, payloads once, then read the archives back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to and url as the archives hold them.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(resolve(with_headers(pages, id_col, url_col, payload_col), min_bytes), path)
    records = cut(read_archives(spark, path).drop("payload"), "records")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
