"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and kept as sorted hash arrays.

1. Each task counts its n-grams in blocks of ``BLOCK`` tokens: word hashes in sorted
   runs of equal prefixes. Blocks go to shards by some bits of the prefix' hash and
   some of the last word's, so a frequent prefix is split over many shards.
2. A shard adds up its n-grams, writes them as a sorted array of keys with counts, and
   sends on to the next lower order: each n-gram's suffix, which it continues by one
   word to the left, and of each prefix how often it was followed, and by how many
   words once, twice and more often.
3. Shards of each lower order add these up and write their table, down to words.
4. Scoring maps the tables into memory and looks up a batch's distinct n-grams of each
   order in key order. Probabilities come from counts and the discounts of the whole
   model: a handful of numbers, the only ones that the driver sees.

``<s>`` precedes each text and is never predicted, ``</s>`` ends it. N-grams that start
with ``<s>`` have no word to their left: their count is how often they occur. Every word
has a probability, as the continuation counts of words are interpolated with an even
share for each known word and one unknown. No n-gram is cut off. Counts are 64 bits wide.

Null and empty texts have no words but an end; long ones are counted in blocks and scored
as one row. A null doc_id is held out. Rows that repeat a doc_id are texts each, learned
and scored by themselves. A model of no rows gives every word the same probability. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import HashArrays, bits_for, scratch, tidy
from .words import BASE, SPACED, batches, hashes, mix

ORDER, BLOCK = 2, 3 << 20
START, END = mix(np.array([0x5354415254, 0x454E44], np.uint64))
PAD = np.uint64(0)  # before <s>
CONTEXT = ("total", "n1", "n2", "n3")


def sequences(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all rows between <s> and </s>, and each row's bounds: a row of n words has n + 2."""
    words, at = hashes(data, bounds, SPACED)
    cut = at + 2 * np.arange(len(bounds))
    out = np.empty(cut[-1], np.uint64)
    inner = np.ones(len(out), bool)
    for place, word in ((cut[:-1], START), (cut[1:] - 1, END)):
        out[place], inner[place] = word, False
    out[inner] = words
    return out, cut


def folded(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of an n-gram, of its prefix' key and its last word. A single word is its own key."""
    with np.errstate(over="ignore"):
        return mix(prefix * BASE + word)


def key_of(columns: list[np.ndarray]) -> np.ndarray:
    out = columns[0]
    for word in columns[1:]:
        out = folded(out, word)
    return out


class Grid:
    """Shards of the longest n-grams: top bits of the prefix' key, then of the last word's hash. Keys carry the shard on top."""

    def __init__(self, bits: int):
        self.bits, self.a, self.b = bits, bits - bits // 2, bits // 2

    def shard(self, prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(prefix), np.int64)
        hi = prefix >> np.uint64(64 - self.a)
        return ((hi << np.uint64(self.b)) | (last >> np.uint64(64 - self.b)) if self.b else hi).astype(np.int64)

    def keys(self, prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
        key = folded(prefix, last)
        return key if not self.bits else (self.shard(prefix, last).astype(np.uint64) << np.uint64(64 - self.bits)) | (key >> np.uint64(self.bits))


def _pack(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """N-grams sorted by prefix: the prefixes of its runs and their lengths, then last words and counts."""
    other = np.zeros(len(n) - 1, bool)
    for c in columns[:-1]:
        other |= c[1:] != c[:-1]
    run = np.flatnonzero(np.concatenate([[True], other]))
    size = np.diff(np.append(run, len(n))).astype("<u4")
    return np.array([len(run), len(n)], "<u4").tobytes() + b"".join(c[run].tobytes() for c in columns[:-1]) + size.tobytes() + columns[-1].tobytes() + n.astype("<u4").tobytes()


def _unpack(raw: bytes, order: int) -> tuple[np.ndarray, ...]:
    """The columns and the counts."""
    runs, rows = (int(x) for x in np.frombuffer(raw, "<u4", 2))
    at = 8 + 8 * runs * (order - 1)
    size = np.frombuffer(raw, "<u4", runs, at)
    prefix = [np.repeat(np.frombuffer(raw, "<u8", runs, 8 + 8 * runs * k), size) for k in range(order - 1)]
    at += 4 * runs
    return *prefix, np.frombuffer(raw, "<u8", rows, at), np.frombuffer(raw, "<u4", rows, at + 8 * rows)


def _counted(pieces: list[tuple[np.ndarray, int]], order: int, grid: Grid):
    """Packed block of each shard of these pieces' n-grams. A piece is words, and how many at its start are only what others follow."""
    words = np.concatenate([x for x, _ in pieces])
    begin = np.cumsum([0, *(len(x) for x, _ in pieces[:-1])])
    place = np.arange(len(words))
    fresh = words == START
    said = ~fresh
    for at, (_, skip) in zip(begin, pieces, strict=True):
        said[at : at + skip] = False
    fresh[begin] = True
    depth = place - np.maximum.accumulate(np.where(fresh, place, 0))
    kinds, back = np.unique(words, return_inverse=True)
    del fresh, words
    back = (back + 1).astype(np.uint64)  # 0 is PAD
    said = np.flatnonzero(said)

    def before(j: int) -> np.ndarray:
        """Numbers of the words j before."""
        out = back[said - np.minimum(j, said)]
        out[depth[said] < j] = 0
        return out

    key, pairs = before(order - 1), []
    for j in range(order - 2, -1, -1):
        key = (key << np.uint64(32)) | before(j)
        if j:
            kept, key = np.unique(key, return_inverse=True)
            pairs.append(kept)
            key = key.astype(np.uint64)
    del said, depth, back
    key = np.sort(key)
    if not len(key):
        return
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n, key = np.diff(np.append(at, len(key))), key[at]
    columns = []
    while True:
        columns.append((key & np.uint64(0xFFFFFFFF)).astype(np.int64))
        key = key >> np.uint64(32)
        if not pairs:
            break
        key = pairs.pop()[key.astype(np.int64)]
    kinds = np.concatenate([[PAD], kinds])
    columns = [kinds[x] for x in [key.astype(np.int64), *reversed(columns)]]
    shard = grid.shard(key_of(columns[:-1]), columns[-1])
    by = np.argsort(shard, kind="stable")
    shard, n, columns = shard[by], n[by], [c[by] for c in columns]
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for i, j in zip([0, *cuts], [*cuts, len(shard)], strict=True):
        yield int(shard[i]), _pack([c[i:j] for c in columns], n[i:j])


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys, the place of one row of each, and the sums of each column."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], order[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values)


class Level:
    """N-grams of an order below the model's: their table, and records on the way to it."""

    def __init__(self, order: int, arrays: HashArrays):
        self.order, self.arrays = order, arrays
        self.names = ["n", *CONTEXT] + ["c"] * (order == 1)
        self.sent = {"n": "<u4" if order == 1 else "<u8", "total": "<u8", "n1": "<u4", "n2": "<u4", "n3": "<u4", "c": "<u8"}

    def blocks(self, words: list[np.ndarray], values: dict[str, np.ndarray]):
        """Shard and packed records, added up by key. Values that are not given are 0."""
        key = key_of(words)
        zero = np.zeros(len(key), np.uint64)
        key, at, *sums = _summed(key, *(values.get(k, zero) for k in self.names))
        home = self.arrays.shard_of(key)
        cuts = [0, *(np.flatnonzero(np.diff(home)) + 1), len(key)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield int(home[i]), b"".join(w[at[i:j]].tobytes() for w in words) + b"".join(x[i:j].astype(self.sent[k]).tobytes() for k, x in zip(self.names, sums, strict=True))

    def read(self, blocks: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], dict[str, np.ndarray]]:
        """Distinct keys, their words and sums."""
        kinds = ["<u8"] * self.order + [self.sent[k] for k in self.names]
        width = sum(np.dtype(d).itemsize for d in kinds)
        columns: list[list[np.ndarray]] = [[] for _ in kinds]
        for x in blocks:
            n, at = len(x) // width, 0
            for k, d in enumerate(kinds):
                columns[k].append(np.frombuffer(x, d, n, at).astype(np.uint64))
                at += n * np.dtype(d).itemsize
        whole = [np.concatenate(x) for x in columns]
        words = whole[: self.order]
        key, at, *sums = _summed(key_of(words), *whole[self.order :])
        return key, [w[at] for w in words], dict(zip(self.names, sums, strict=True))


def _passed_on(words: list[np.ndarray], n: np.ndarray, top: bool, levels: dict[int, Level]):
    """Order, shard and block of what distinct n-grams with these counts tell lower orders."""
    order, real = len(words), words[0] != PAD
    one, two, more = (x.astype(np.uint64) for x in (n == 1, n == 2, n > 2))
    level = levels[order - 1]
    key, at, *sums = _summed(key_of([w[real] for w in words[:-1]]), *(x[real] for x in (n, one, two, more)))
    prefix = [w[real][at] for w in words[:-1]]
    values = {"n": np.where(real, 1, n).astype(np.uint64)} | ({"c": n} if top and order == 2 else {})
    key, at, *more = _summed(key_of(words[1:]), *values.values())
    suffix = [w[at] for w in words[1:]]
    a, b = (np.zeros(len(x[0]), np.uint64) for x in (prefix, suffix))
    both = {k: np.concatenate([v, b]) for k, v in zip(CONTEXT, sums, strict=True)} | {k: np.concatenate([a, v]) for k, v in zip(values, more, strict=True)}
    for shard, block in level.blocks([np.concatenate(x) for x in zip(prefix, suffix, strict=True)], both):
        yield order - 1, shard, block
    if top and order > 2:
        for shard, block in levels[1].blocks(words[-1:], {"c": n}):
            yield 1, shard, block


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's, of the numbers of n-grams with counts 1 to 4; fixed ones where those are too few."""
    if min(n[:3]) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))


def _less(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts."""
    return np.maximum(n - np.choose(np.minimum(n, 3).astype(np.int64), [0.0, *d]), 0)


@dataclass
class Model:
    """``tables``: of order 1, 2 and so on. ``pairs``: the sum of words' continuation counts."""

    tables: list[HashArrays]
    grid: Grid
    tokens: int
    types: int
    pairs: int
    discounts: list[tuple[float, float, float]]
    rest: float

    def score(self, words: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each word after those before it in its row, and its count in training; both 0 at <s>."""

        def found(table: HashArrays, keys: np.ndarray) -> dict[str, np.ndarray]:
            unique, back = np.unique(keys, return_inverse=True)
            return {k: v[back].astype(np.float64) for k, v in table.lookup(unique)[1].items()}

        def shifted(x: np.ndarray) -> np.ndarray:
            return np.concatenate([x[:1], x[:-1]])

        depth = np.arange(len(words)) - np.repeat(cut[:-1], np.diff(cut))
        key, got = words, found(self.tables[0], words)
        seen, p = got["c"], np.full(len(words), self.rest / (self.types + 1))
        if self.pairs:
            p += _less(got["n"], self.discounts[0]) / self.pairs
        for order in range(2, len(self.tables) + 1):
            before, d = {k: shifted(got[k]) for k in CONTEXT}, self.discounts[order - 1]
            last = order == len(self.tables)
            key = (self.grid.keys if last else folded)(shifted(key), words)
            got = found(self.tables[order - 1], key)
            total = np.maximum(before["total"], 1)
            gamma = (d[0] * before["n1"] + d[1] * before["n2"] + d[2] * before["n3"]) / total
            p = np.where((depth >= order - 1) & (before["total"] > 0), _less(got["n"], d) / total + gamma * p, p)
        log = np.log10(p)
        log[cut[:-1]] = 0
        return log, seen


def train(docs: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Counts all of ``docs``, n-grams of 2 words or more. Files go to the shared folder."""
    if order < 2:
        raise ValueError("order is 2 at least")
    spark = docs.sparkSession
    uri = scratch(spark, "ngrams")
    docs = docs.select(F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    grid = Grid(bits_for(size / 6, 1 << 20))
    highest = HashArrays(uri, f"order{order}", grid.bits, {"n": "<u4"})
    levels = {k: Level(k, HashArrays(uri, f"order{k}", bits_for(size / 6, 1 << 20), dict.fromkeys(["n", *CONTEXT], "<u4"))) for k in range(2, order)}
    levels[1] = Level(1, HashArrays(uri, "order1", bits_for(size / 60, 1 << 18), dict.fromkeys(["n", *CONTEXT], "<u4") | {"total": "<u8", "c": "<u8"}))
    schema = "level int, shard long, block binary"  # level 0: sums

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["level", "shard", "block"])

    def sums(k: int, n: np.ndarray, tokens: int = 0, types: int = 0) -> tuple[int, int, bytes]:
        """Order, n-grams, those with counts 1 to 4, the sum of counts, tokens and types."""
        return 0, k, np.array([k, len(n), *(int((n == x).sum()) for x in (1, 2, 3, 4)), int(n.sum()), tokens, types], "<u8").tobytes()

    def count(it):
        held, n = [], 0
        for batch in it:
            for _, _, data, bounds in batches(batch, "text"):
                words, _ = sequences(data, bounds)
                for k in range(0, len(words), BLOCK):
                    skip = min(k, order - 1)
                    held.append((words[k - skip : k + BLOCK], skip))
                    n += len(held[-1][0]) - skip
                    if n >= BLOCK:
                        yield rows_of([(order, *x) for x in _counted(held, order, grid)])
                        held, n = [], 0
        if held:
            yield rows_of([(order, *x) for x in _counted(held, order, grid)])

    def add_highest(table: pa.Table) -> pa.Table:
        blocks = [_unpack(x.as_py(), order) for x in table["block"]]
        *words, n = (np.concatenate(x) for x in zip(*blocks, strict=True))
        del blocks
        key, at, n = _summed(grid.keys(key_of(words[:-1]), words[-1]), n.astype(np.uint64))
        words = [w[at] for w in words]
        real = words[0] != PAD
        highest.write(table["shard"][0].as_py(), key[real], {"n": n[real]})
        return pa.Table.from_batches([rows_of([*_passed_on(words, n, True, levels), sums(order, n[real])])])

    def add_level(k: int):
        def run(table: pa.Table) -> pa.Table:
            if table["level"][0].as_py() != k:
                return table
            key, words, got = levels[k].read([x.as_py() for x in table["block"]])
            real, n = words[0] != PAD, got["n"]
            levels[k].arrays.write(table["shard"][0].as_py(), key[real], {c: v[real] for c, v in got.items()})
            some = n > 0
            if k == 1:
                return pa.Table.from_batches([rows_of([sums(1, n[some], int(got["c"].sum()), int((got["c"] > 0).sum()))])])
            return pa.Table.from_batches([rows_of([*_passed_on([w[some] for w in words], n[some], False, levels), sums(k, n[some & real])])])

        return run

    made = docs.mapInArrow(tidy(count), schema).groupBy("level", "shard").applyInArrow(add_highest, schema)
    for k in range(order - 1, 0, -1):
        made = made.groupBy("level", "shard").applyInArrow(add_level(k), schema)

    def read_sums(it):
        for batch in it:
            got = np.array([np.frombuffer(x.as_py(), "<i8") for x in batch.column(2)], np.int64).reshape(-1, 9)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in got.T], [f"x{i}" for i in range(9)])

    found = made.mapInArrow(read_sums, ", ".join(f"x{i} long" for i in range(9))).groupBy("x0").agg(*(F.sum(f"x{i}").alias(f"x{i}") for i in range(1, 9))).collect()
    by = {r["x0"]: [r[f"x{i}"] for i in range(1, 9)] for r in found}  # a row for each order
    none = [0] * 8
    discounts = [_discounts(by.get(k, none)[1:5]) for k in range(1, order + 1)]
    types, one, two, _, _, pairs, tokens, known = by.get(1, none)
    rest = sum(d * n for d, n in zip(discounts[0], (one, two, types - one - two), strict=True)) / pairs if pairs else 1.0
    return Model([*(levels[k].arrays for k in range(1, order)), highest], grid, tokens, known, pairs, discounts, rest)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10) and perplexity of each row."""

    def run(it):
        unit = np.log10(model.tokens + 0.1 * (model.types + 1))
        for batch in it:
            for a, b, data, bounds in batches(batch, "text", 2 << 20):
                words, cut = sequences(data, bounds)
                p, c = model.score(words, cut)
                base = np.log10(c + 0.1) - unit
                base[cut[:-1]] = 0
                n = np.diff(cut) - 1
                total = np.add.reduceat(p, cut[:-1])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "n_tokens": n, "n_known": np.add.reduceat((c > 0).astype(np.int64), cut[:-1]), "base_score": np.add.reduceat(base, cut[:-1]), "score": total, "perplexity": 10.0 ** np.minimum(-total / n, 300)})

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text divides by 10; so does a missing id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 10 == 0, F.lit(True))


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
