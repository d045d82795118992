"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own. The writer deduplicates payloads: of the
records with equal payloads the one with the largest page_id is a response, the
others revisit it.

The reader deals out byte ranges of ``SPLIT`` bytes. A task looks for gzip's magic
bytes from its start, and accepts a candidate only if its member's first bytes
inflate to a WARC header: inside compressed data the magic turns up by chance. It
owns the records that start in its range, and reads the last of them beyond its end.
A damaged member is skipped to the next one. Nothing of a file is read whole: a task
holds a window of the file and one record.

Null html is an empty payload. A page without a page_id is a response of its own.
Rows that repeat a page_id are records each: if it is the largest of its payload, all
of them are responses. Empty tables give no archives. A record is held in memory whole,
so html may be as long as a row can be. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import open_file, scratch, small, stored, write_file

MAGIC = b"\x1f\x8b\x08"
SPLIT, WINDOW, HEADER = 8 << 20, 1 << 20, 1 << 16
#: Records of one archive file, at most about so many bytes.
FILE_BYTES = 64 << 20
RECORD = "file string, start long, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A gzip member with a response, its payload in an HTTP message, or a revisit, which has only the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {re.sub('[\r\n]', ' ', uri)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def write(records: DataFrame, uri: str) -> DataFrame:
    """Writes archives below ``uri``; file and bytes of each. ``records``: kind, record_id, refers_to, uri, digest, payload (binary)."""

    def run(it):
        from pyspark import TaskContext

        part, parts, size, made = TaskContext.get().partitionId(), [], 0, 0

        def flush():
            name = f"{uri}/archive-{part:05d}-{made:05d}.warc.gz"
            n = write_file(name, parts)
            return pa.RecordBatch.from_pydict({"file": [name], "bytes": pa.array([n], pa.int64())})

        for batch in it:
            for kind, rid, ref, target, digest, payload in zip(*(batch.column(k) for k in range(6)), strict=True):
                parts.append(record(kind.as_py(), rid.as_py(), target.as_py() or "", payload.as_py(), digest.as_py(), ref.as_py()))
                size += len(parts[-1])
                if size >= FILE_BYTES:
                    yield flush()
                    parts, size, made = [], 0, made + 1
        if parts:
            yield flush()

    return records.select("kind", "record_id", "refers_to", "uri", "digest", "payload").mapInArrow(run, "file string, bytes long")


class Reader:
    """A file by ranges, through a window of its bytes."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.held = source, size, 0, b""

    def bytes(self, start: int, n: int) -> bytes:
        if not (self.at <= start and start + n <= self.at + len(self.held)):
            self.source.seek(start)
            self.at, self.held = start, self.source.read(min(max(n, WINDOW), self.size - start))
        return self.held[start - self.at : start - self.at + n]

    def find(self, start: int, end: int) -> int:
        """Place of the next magic bytes that start in this range, or -1."""
        while start < end:
            n = min(WINDOW, self.size - start)
            i = self.bytes(start, n).find(MAGIC)
            if i >= 0:
                return start + i if start + i < end else -1
            start += max(1, n - len(MAGIC) + 1)
        return -1

    def member(self, start: int, most: int | None = None) -> tuple[bytes, int] | None:
        """What the member at ``start`` holds (``most`` bytes of it), and where it ends (-1 if not reached); None if it does not inflate."""
        inflate, out, at, size = zlib.decompressobj(31), [], start, 0
        try:
            while at < self.size and not inflate.eof:
                part = self.bytes(at, min(HEADER, self.size - at))
                out.append(inflate.decompress(part, most - size if most else 0))
                size += len(out[-1])
                at += len(part)
                if most and size >= most:
                    return b"".join(out), -1
            return (b"".join(out), at - len(inflate.unused_data)) if inflate.eof else None
        except zlib.error:
            return None


def _headers(block: bytes) -> tuple[dict[str, str], int] | None:
    """Named fields of a WARC header, and where its block starts."""
    if not re.match(rb"WARC/\d\.\d\r\n", block) or (end := block.find(b"\r\n\r\n")) < 0:
        return None
    lines = block[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return (fields, end + 4) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def records_in(source, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Start, header fields and block of each record that starts in this range."""
    file = Reader(source, size)
    while (at := file.find(start, end)) >= 0:
        start = at + 1
        head = file.member(at, HEADER // 8)
        if head is None or not head[0].startswith(b"WARC/"):
            continue
        whole = file.member(at)
        if whole is None or (got := _headers(whole[0])) is None:
            continue
        fields, body = got
        yield at, fields, whole[0][body : body + int(fields["content-length"])]
        start = whole[1]


def _ref(x: str | None) -> str | None:
    return x.strip("<>") if x else None


def archives(spark: SparkSession, path: str) -> DataFrame:
    """file and bytes of the archives below a path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def read(spark: SparkSession, files: DataFrame, split: int = SPLIT) -> DataFrame:
    """Records (``RECORD``) of archives. ``files``: file, bytes. Payloads are what follows the HTTP header; a revisit's is null."""
    ranges = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))

    def run(it):
        for batch in it:
            for name, size, start in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                rows, held = [], 0

                def flush():
                    columns = list(zip(*rows, strict=True)) or [()] * 8
                    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.binary()]
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RECORD.split(", ")])

                with open_file(name) as source:
                    for at, fields, block in records_in(source, size, start, min(size, start + split)):
                        kind = fields["warc-type"]
                        http = block.find(b"\r\n\r\n") + 4
                        body = None if kind == "revisit" else block[http:] if block.startswith(b"HTTP/") and http > 3 else block
                        rows.append((name, at, kind, _ref(fields.get("warc-record-id")), _ref(fields.get("warc-refers-to")), fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, body))
                        held += len(block)
                        if held > WINDOW:
                            yield flush()
                            rows, held = [], 0
                yield flush()

    dealt = ranges.repartition(max(1, min(100_000, ranges.count())), F.xxhash64("file", "start"))
    return dealt.mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, uri: str, page_id: str = "page_id", html: str = "html", url: str = "url", least: int = 0) -> DataFrame:
    """Archives of pages, deduplicated from ``least`` payload bytes on; file and bytes of each."""
    raw = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("uri"), raw.alias("payload"))
    # only ids and digests are grouped: a payload that a third of all pages share is one partial maximum a task
    digests = stored(p.where(F.col("page_id").isNotNull() & (F.length("payload") >= least)).select("page_id", F.sha1("payload").alias("sha"), F.length("payload").alias("size")), "digests", uri)
    best = digests.groupBy("sha", "size").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1").select("sha", "size", "best")
    best = small(stored(best, "best", uri))  # stored, so that Spark can split the pages of a frequent payload where it is not broadcast
    refers = digests.join(best, ["sha", "size"]).where("page_id < best").select("page_id", "sha", "best").distinct()
    refers = small(stored(refers, "refers", uri))  # where they are few no payload is shuffled
    marked = p.withColumn("sha", F.sha1("payload")).join(refers, ["page_id", "sha"], "left")
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))

    def base32(it):
        for batch in it:
            shas = [base64.b32encode(bytes.fromhex(x)).decode() for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shas, pa.string()), batch.column(5)], ["kind", "record_id", "refers_to", "uri", "digest", "payload"])

    rows = marked.select(F.when(F.col("best").isNull(), "response").otherwise("revisit").alias("kind"), name.alias("record_id"), F.concat(F.lit("urn:page:"), F.col("best").cast("string")).alias("refers_to"), "uri", F.col("sha").alias("digest"), "payload")
    made = write(rows.mapInArrow(base32, "kind string, record_id string, refers_to string, uri string, digest string, payload binary"), uri)
    return stored(made, "files", uri)


def resolved(records: DataFrame) -> DataFrame:
    """record_id, record_type, refers_to, and length and digest of the full payload, which a revisit takes from its response."""

    def run(it):
        for batch in it:
            bodies = batch.column(3).to_pylist()
            n = [None if x is None else len(x) for x in bodies]
            d = [given if x is None else digest_of(x) for x, given in zip(bodies, batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(d, pa.string())], ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    r = records.select("record_id", "record_type", "refers_to", "payload", "payload_digest").mapInArrow(run, "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string")
    uri = scratch(records.sparkSession, "warc")
    r = stored(r, "records", uri)
    full = r.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full_bytes"))
    out = r.join(stored(full, "full", uri), ["refers_to", "payload_digest"], "left")  # stored for the revisits of a frequent payload
    return out.select("record_id", "record_type", "refers_to", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"), "payload_digest")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    files = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch(spark, "archives"))
    got = resolved(read(spark, files))
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS long)")
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT html, max(page_id) AS best FROM p GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (5 * i // 4 + 1)::INT, 2))::INT >> (3 - 5 * i % 4)::INT) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM p JOIN b ON p.html = b.html
"""
