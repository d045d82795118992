"""Best-fit packing of tokenised documents into sequences under several capacities.

Residual tokens, document count and attention cost (the sum of squared piece
lengths) are a bin's capacities. All three needs of a piece follow from its length,
so a histogram of at most ``capacity`` lengths describes the input, whatever its
size. ``plan`` packs that histogram: from the longest pieces down it puts each run
of equal pieces into the run of equal bins that fits best, by weighted dot product
of need and residual or by norm of what would be left, and only if every capacity
holds. Pieces then find their place by their rank among pieces of their length,
which Spark counts in two steps, by stored numbers of pieces, so that no length is one
task's, whatever ids its documents have.

A document is its token ids and an end id. Longer ones than ``capacity`` are cut
into full pieces; the first piece takes what is over.

Null and empty texts are the end id alone. Rows that repeat a doc_id are packed each
by itself; a null doc_id too. Long texts are tokenised in parts, cut where no token can
cross, so memory follows ``PART`` and not the text; long white space has a tokenizer of
its own (see ``Tokenizer``). Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import scratch, stored, tidy

CAPACITY, END_ID = 1024, 2
#: Characters of a text that are tokenised at a time, at least; white space from which on the slower tokenizer is used.
PART, LONG_SPACE = 1 << 18, 10_000
#: Pieces of one length that are ranked together, roughly.
RANKED = 2_000
PIECES = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(k, T.LongType() if k not in ("piece",) else T.IntegerType()) for k in ("piece", "start", "length", "ids_crc32")])


class Tokenizer:
    """Ids of texts by a byte-level BPE vocabulary; strings of special tokens are ordinary text.

    Texts of Latin letters go through the vocabulary's rank file, others through the
    JSON file, whose library knows other Unicode tables. Both give the same ids. The
    first one's matcher goes as deep as a run of white space is long and breaks off on
    very long ones, so these go through the JSON file too.
    """

    _plain = regex.compile("[^\x00-ɏ‐-‧]")
    _space = regex.compile(r"[\s\x1c-\x1f]{%d}" % LONG_SPACE)
    #: A single space or line end between letters or digits starts a token; a Chinese comma or full stop after a Chinese character does.
    _seam = regex.compile(r"(?<=[\p{L}\p{N}])[ \n](?=[\p{L}\p{N}])|(?<=[\u4e00-\u9fff])(?=[，。])")
    _made: dict[tuple[str, str, str], "Tokenizer"] = {}

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path

    @cached_property
    def full(self):
        from tokenizers import Tokenizer as Json

        out = Json.from_file(self.json_path)
        out.encode_special_tokens = True
        return out

    @classmethod
    def of(cls, spec: tuple[str, str, str]) -> "Tokenizer":
        if spec not in cls._made:
            cls._made[spec] = cls(*spec)
        return cls._made[spec]

    def parts(self, text: str) -> Iterator[str]:
        """Parts of ``PART`` characters and what it takes to reach a place where no token can cross."""
        at = 0
        while len(text) - at > PART and (seam := self._seam.search(text, at + PART)):
            yield text[at : seam.start()]
            at = seam.start()
        yield text[at:]

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= PART:
            return self._ids(text)
        return np.concatenate([self._ids(x) for x in self.parts(text)])

    def _ids(self, text: str) -> np.ndarray:
        if self._plain.search(text) or (len(text) >= LONG_SPACE and self._space.search(text)):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def default_tokenizer() -> tuple[str, str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def cut(total: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of each piece of a document of so many ids."""
    start = 0
    while start < total:
        length = (total - start) % capacity or capacity
        yield start, length
        start += length


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of all pieces. ``docs``: doc_id, text."""
    spec = tokenizer or default_tokenizer()

    def run(it):
        encode = Tokenizer.of(spec).ids
        for batch in it:
            rows: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                rows += [(i, k, a, n, zlib.crc32(ids[a : a + n])) for k, (a, n) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)], PIECES.names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), PIECES)


@dataclass
class Capacities:
    tokens: int = CAPACITY
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"

    def limits(self) -> np.ndarray:
        """Without a limit of its own, a bin takes as many documents and as much attention as its tokens allow."""
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


def plan(counts: dict[int, int], capacities: Capacities) -> np.ndarray:
    """Places of all pieces: rows of length, first rank, number, first bin and offset, sorted by the first two.

    ``counts``: number of pieces of each length. Equal bins are kept together as runs
    of bin numbers, so work and result follow the number of lengths and of kinds of
    bins, not of pieces.
    """
    limits = capacities.limits()
    scale = np.array(capacities.weights) ** 0.5 / limits
    places: list[tuple[int, int, int, int, int]] = []
    kinds: dict[tuple[int, int, int], deque] = {}  # residuals: runs of bins
    keys: list[tuple[int, int, int]] = []
    held = np.zeros((0, 3), np.int64)
    opened = 0
    for length in sorted(counts, reverse=True):
        need, n, rank = np.array([length, 1, length**2], np.int64), counts[length], 0
        if (need > limits).any():
            raise ValueError(f"a piece of {length} exceeds a capacity")
        while n:
            fits = np.flatnonzero((held >= need).all(1))
            if len(fits):
                if capacities.rule == "dot":
                    best = fits[np.argmax((held[fits] * scale) @ (need * scale))]
                else:
                    best = fits[np.argmin((((held[fits] - need) * scale) ** 2).sum(1))]
                key = keys[best]
            else:
                key = tuple(int(x) for x in limits)
                new = -(-n // int((limits // need).min()))
                kinds[key] = deque([(opened, new)])
                keys.append(key)
                opened += new
                best = len(keys) - 1
            runs = kinds[key]
            left = tuple(int(a - b) for a, b in zip(key, need, strict=True))
            moved = []
            while n and runs:
                first, size = runs.popleft()
                k = min(n, size)
                places.append((length, rank, k, first, int(limits[0]) - key[0]))
                moved.append((first, k))
                if k < size:
                    runs.appendleft((first + k, size - k))
                n, rank = n - k, rank + k
            if not runs:
                del kinds[key]
                keys.pop(best)
            if min(left) > 0:
                if left not in kinds:
                    kinds[left] = deque()
                    keys.append(left)
                kinds[left].extend(moved)
            held = np.array(keys, np.int64).reshape(-1, 3)
    return np.array(sorted(places), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacities: Capacities | None = None, tokenizer: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    capacities = capacities or Capacities()
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    numbered = pieces(docs, capacities.tokens, tokenizer).withColumn("k", F.monotonically_increasing_id())
    cuts = stored(numbered, "pieces", scratch(spark, "packing"))
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # as many rows as lengths at most
    places = plan(counts, capacities)
    parts = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in counts.items()], "length long, parts long")
    salted = cuts.join(F.broadcast(parts), "length").withColumn("salt", F.pmod(F.xxhash64("k"), F.col("parts")))
    groups = Window.partitionBy("length", "salt")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = salted.withColumn("rank", F.row_number().over(groups.orderBy("k")) - 1)
    ranked = ranked.join(sizes.select("length", "salt", before.alias("before")), ["length", "salt"])

    def place(it):
        start = (places[:, 0] << 44) | places[:, 1]
        for batch in it:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(start, (length << 44) | rank, side="right") - 1
            out = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(places[at, 3] + rank - places[at, 1]), pa.array(places[at, 4])], [*PIECES.names, "sequence_id", "offset"])

    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*PIECES.names, (F.col("rank") + F.col("before")).cast("long").alias("rank")).mapInArrow(place, schema)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
