"""Line deduplication with two Bloom filters, for keys seen once and seen twice.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys
of ``min_chars`` code points that ``min_docs`` documents hold lose their lines in
all of them but the one with the largest doc_id. Rows of one doc_id are one document,
rows without doc_id are a document each.

1. Each task hashes its keys and sends, for each segment of the filters, the bits
   it saw once and twice. A segment's owner merges them: a bit that two tasks saw
   once was seen twice. Segments hold about as many bits at any size of the input;
   where one gets the bits of many more keys than that, parts of them are made into
   bitmaps first and these are merged.
2. Each task maps the twice-seen segments into memory and sends only suspected
   repeats, as SHA-256 digest and doc_id. Counts by digest and doc_id, then by
   digest, confirm them exactly and pick the document that keeps the line.
3. Confirmed keys become sorted hash arrays in the shared folder, and each task
   rewrites its texts by them. No text is ever shuffled.

Past ``MAX_BITS`` the filter grows no more: more lines are suspected then, and
results stay the same.

Null and empty texts are one empty line. A null doc_id never keeps a line that
another document holds. Rows that repeat the largest doc_id all keep the line. A text is
split as a whole, so it may be as long as a row can be. Empty tables give no rows. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import HashArrays, bits_for, map_file, scratch, tidy, write_file

SPACE = " \t\n\x0b\x0c\r"
BITS_PER_KEY, MIN_SEGMENT_BITS, MAX_SEGMENT_BITS, MAX_BITS = 8, 20, 23, 36
#: Keys of a segment that one task turns into bits, roughly.
MERGED = 1 << 22


def _keys(text: str | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """Number and key of each line that is long enough."""
    for i, line in enumerate((text or "").split("\n")):
        if len(line) >= min_chars and len(bare := line.strip(SPACE)) >= min_chars:
            yield i, bare.encode("utf-8", "surrogatepass").lower()


class TwiceSeen:
    """Bloom filter of keys that were seen twice at least, in segments of 2**segment_bits bits."""

    def __init__(self, uri: str, total_bits: int):
        self.uri, self.total = uri, total_bits
        self.segment_bits = min(total_bits, max(MIN_SEGMENT_BITS, min(MAX_SEGMENT_BITS, total_bits - 10)))

    def path(self, segment: int) -> str:
        return f"{self.uri}/twice-{segment:05d}.bin"

    def bits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segment of each hash, and its two bits there, as columns."""
        rest = self.total - self.segment_bits
        segment = (hashes >> np.uint64(64 - rest)).astype(np.int64) if rest else np.zeros(len(hashes), np.int64)
        low = np.uint64((1 << self.segment_bits) - 1)
        other = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return segment, np.stack([hashes & low, (other >> np.uint64(20)) & low], 1).astype(np.uint32)

    def partials(self, hashes: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """Of the hashes that one task saw: segment, bits seen once, bits seen twice."""
        unique, n = np.unique(hashes, return_counts=True)
        segment, bits = self.bits(unique)
        cuts = np.flatnonzero(np.diff(segment)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(unique)], strict=True):
            if b > a:
                yield int(segment[a]), bits[a:b].tobytes(), bits[a:b][n[a:b] > 1].tobytes()

    def seen(self, once: list[bytes], twice: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of a segment's bits seen once at least, and twice at least."""
        count = np.zeros(1 << self.segment_bits, np.uint8)
        for x in once:
            at = np.unique(np.frombuffer(x, np.uint32))
            count[at] = np.minimum(count[at] + 1, 2)
        for x in twice:
            count[np.frombuffer(x, np.uint32)] = 2
        return np.packbits(count >= 1, bitorder="little"), np.packbits(count >= 2, bitorder="little")

    def write(self, segment: int, maps: list[tuple[np.ndarray, np.ndarray]]) -> int:
        """Merges bitmaps and writes a segment's twice-seen bits; how many are set."""
        once, twice = (np.zeros(max(1, (1 << self.segment_bits) // 8), np.uint8) for _ in range(2))
        for a, b in maps:
            twice |= b | (once & a)
            once |= a
        write_file(self.path(segment), [twice])
        return int(np.bitwise_count(twice).sum())

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        segment, bits = self.bits(hashes)
        order = np.argsort(segment, kind="stable")
        cuts = np.flatnonzero(np.diff(segment[order])) + 1
        for at in np.split(order, cuts):
            if len(at) and (raw := map_file(self.path(int(segment[at[0]])))) is not None:
                b = bits[at]
                out[at] = ((raw[b >> 3] >> (b & 7)) & 1).all(1)
        return out


def _build(docs: DataFrame, text: str, seen: TwiceSeen, min_chars: int, lines: int) -> int:
    """Writes the filter; how many bits it has."""
    def partials(batches):
        held: list[np.ndarray] = []
        count = 0

        def flush():
            rows = list(seen.partials(np.concatenate(held))) if held else []
            held.clear()
            return pa.RecordBatch.from_pydict({"segment": pa.array([r[0] for r in rows], pa.int64()), "once": pa.array([r[1] for r in rows], pa.binary()), "twice": pa.array([r[2] for r in rows], pa.binary())})

        for batch in batches:
            for x in batch.column(0):
                own = {xxhash.xxh3_64_intdigest(k) for _, k in _keys(x.as_py(), min_chars)}
                if own:
                    held.append(np.fromiter(own, np.uint64, len(own)))
                    count += len(own)
            if count > 1 << 21:
                yield flush()
                count = 0
        yield flush()

    def merge(table: pa.Table) -> pa.Table:
        k = table["segment"][0].as_py()
        n = seen.write(k, [seen.seen(table["once"].to_pylist(), table["twice"].to_pylist())])
        return pa.table({"segment": pa.array([k], pa.int64()), "n": pa.array([n], pa.int64())})

    def part(table: pa.Table) -> pa.Table:
        once, twice = seen.seen(table["once"].to_pylist(), table["twice"].to_pylist())
        return pa.table({"segment": pa.array([table["segment"][0].as_py()], pa.int64()), "once": pa.array([once.tobytes()], pa.binary()), "twice": pa.array([twice.tobytes()], pa.binary())})

    def join(table: pa.Table) -> pa.Table:
        k = table["segment"][0].as_py()
        n = seen.write(k, [tuple(np.frombuffer(table[c][i].as_py(), np.uint8) for c in ("once", "twice")) for i in range(table.num_rows)])
        return pa.table({"segment": pa.array([k], pa.int64()), "n": pa.array([n], pa.int64())})

    rows = docs.select(text).mapInArrow(tidy(partials), "segment long, once binary, twice binary")
    parts = -(-lines // (MERGED << (seen.total - seen.segment_bits)))  # into which a segment's keys are dealt by the tasks that saw them
    if parts > 1:
        dealt = rows.withColumn("part", F.spark_partition_id() % F.lit(parts))
        made = dealt.groupBy("segment", "part").applyInArrow(part, "segment long, once binary, twice binary").groupBy("segment").applyInArrow(join, "segment long, n long")
    else:
        made = rows.groupBy("segment").applyInArrow(merge, "segment long, n long")
    return made.agg(F.sum("n")).first()[0] or 0


def _confirm(docs: DataFrame, doc_id: str, text: str, seen: TwiceSeen, min_chars: int, min_docs: int, uri: str, bits: int) -> HashArrays:
    """Sorted arrays of the confirmed lines. ``bits`` of the filter tell how many there may be: a repeated line has two."""

    def suspects(batches):
        for batch in batches:
            ids, keys, hashes = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k in {k for _, k in _keys(x.as_py(), min_chars)}:
                    ids.append(i)
                    keys.append(k)
                    hashes.append(xxhash.xxh3_64_intdigest(k))
            kept = np.flatnonzero(seen.may_hold(np.array(hashes, np.uint64)))
            yield pa.RecordBatch.from_pydict({"digest": pa.array([hashlib.sha256(keys[j]).digest() for j in kept], pa.binary()), "doc_id": pa.array([ids[j] for j in kept], pa.int64())})

    repeats = docs.select(doc_id, text).mapInArrow(tidy(suspects), "digest binary, doc_id long")
    held = repeats.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))  # a frequent line is counted by many tasks
    counted = held.groupBy("digest").agg(F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(1)).alias("n"), F.max("doc_id").alias("keeper"))
    confirmed = counted.where(F.col("n") >= min_docs)
    arrays = HashArrays(uri, "lines", bits_for(bits / 2, 1 << 20), {"b": "<u8", "c": "<u8", "d": "<u8", "keeper": "<i8"})

    def write(batches):
        shard, held = None, []

        def flush():
            table = pa.Table.from_batches(held)
            raw = np.frombuffer(b"".join(table["digest"].to_pylist()), ">u8").reshape(-1, 4)
            at = np.argsort(raw[:, 0], kind="stable")
            keeper = table["keeper"].fill_null(-(1 << 63)).to_numpy()
            arrays.write(shard, raw[at, 0].astype(np.uint64), {"b": raw[at, 1], "c": raw[at, 2], "d": raw[at, 3], "keeper": keeper[at]})
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64())})

        for batch in batches:
            shards = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if held and shards[a] != shard:
                        yield flush()
                        held.clear()
                    shard = int(shards[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    top = F.shiftrightunsigned(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - arrays.bits)
    confirmed.select("digest", "keeper", top.alias("shard")).repartition("shard").sortWithinPartitions("shard").mapInArrow(write, "shard long").agg(F.count("*")).collect()
    return arrays


def _dropped(keys: list[bytes], ids: list[int | None], arrays: HashArrays) -> np.ndarray:
    """Of each key and its document: whether the line goes."""
    out = np.zeros(len(keys), bool)
    if not keys:
        return out
    raw = np.frombuffer(b"".join(hashlib.sha256(k).digest() for k in keys), ">u8").reshape(-1, 4).astype(np.uint64)
    unique, at, back = np.unique(raw, axis=0, return_index=True, return_inverse=True)
    found, values = arrays.find(unique[:, 0], {name: unique[:, j] for j, name in enumerate("bcd", 1)})
    back = back.reshape(-1)
    own = np.array([-(1 << 63) if i is None else i for i in ids], np.int64)
    return found[back] & (values["keeper"][back] != own)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, carry: str | None = None) -> DataFrame:
    """doc_id, kept_text, n_lines and n_dropped of each row; a text is kept whole where no line goes. ``carry``: a column that goes along."""
    spark = docs.sparkSession
    uri = scratch(spark, "lines")
    more = [T.StructField(carry, docs.schema[carry].dataType)] if carry else []
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(F.col(carry).alias("carry") for _ in more))
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    seen = TwiceSeen(uri, min(MAX_BITS, max(16, int(np.ceil(np.log2(max(1, lines * BITS_PER_KEY)))))))
    bits = _build(docs, "text", seen, min_chars, lines)
    arrays = _confirm(docs, "doc_id", "text", seen, min_chars, min_docs, uri, bits)

    def rewrite(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys, owners, places = [], [], []
            for r, x in enumerate(texts):
                for i, k in _keys(x, min_chars):
                    keys.append(k)
                    owners.append(ids[r])
                    places.append((r, i))
            goes: dict[int, set[int]] = {}
            for j in np.flatnonzero(_dropped(keys, owners, arrays)):
                goes.setdefault(places[j][0], set()).add(places[j][1])
            out = [x or "" for x in texts]
            n = [x.count("\n") + 1 for x in out]
            for r, gone in goes.items():
                out[r] = "\n".join(line for i, line in enumerate(out[r].split("\n")) if i not in gone)
            dropped = [len(goes.get(r, ())) for r in range(len(out))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), *batch.columns[2:]], ["doc_id", "kept_text", "n_lines", "n_dropped", *(f.name for f in more)])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), *more])
    return docs.mapInArrow(tidy(rewrite), schema)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    got = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


OP10_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
