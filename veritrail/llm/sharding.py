"""Sharding by best-fit decreasing: indivisible groups of rows enter fixed-capacity shards.

Groups sorted by size enter the shard with the tightest remaining capacity that holds
them, found in a balanced tree of capacities. Groups of one size are interchangeable,
and so are shards with equal remaining capacity: ``plan`` packs the histogram of sizes
into runs of shards, a step for each size and kind of shard, and gives what packing
group by group would. Its input has a row for each different size: n of them need
groups of n * (n + 1) / 2 in total, so 100 TB have 14 million at most. Spark adds up
the sizes, ranks the groups of each size in salted parts and looks up each rank's shard.

``assign`` opens as few shards of a given capacity as it can, or, given a number of
shards, looks for the least capacity that needs no more.

Rows of groups that hold much of the input are joined with their shard by a broadcast
of a bounded number of groups, others by a shuffle. A null group is a group; a null size
is 0, and groups without size enter shard 0. A group above the capacity gets a shard of
its own. Groups are equal texts in ``shard_documents``, null being one of its own. Rows
that repeat a doc_id or text belong to one group; a null doc_id is a row like any other.
Slots go by doc_id, then checksum and size of the text; rows that are alike in these get
theirs in any order. Columns of the input keep their values, whatever their names, but
for ``shard`` and ``slot``, which are replaced. Empty tables give no rows.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import map_file, scratch, small, stored, write_file

#: A group of more than this part of all bytes or rows is joined by broadcasting: at most twice as many.
HOT = 4096
#: Rows or groups that are ranked together, roughly.
RANKED = 20_000


class Capacities:
    """Remaining capacities of shards in an AVL tree, ordered by capacity, then shard number."""

    class Node:
        __slots__ = ("key", "left", "right", "height")

        def __init__(self, key):
            self.key, self.left, self.right, self.height = key, None, None, 1

    def __init__(self):
        self.root = None

    @staticmethod
    def _height(node) -> int:
        return node.height if node else 0

    def _fix(self, node):
        node.height = 1 + max(self._height(node.left), self._height(node.right))
        lean = self._height(node.left) - self._height(node.right)
        if lean > 1:
            if self._height(node.left.left) < self._height(node.left.right):
                node.left = self._rotate(node.left, "right", "left")
            return self._rotate(node, "left", "right")
        if lean < -1:
            if self._height(node.right.right) < self._height(node.right.left):
                node.right = self._rotate(node.right, "left", "right")
            return self._rotate(node, "right", "left")
        return node

    def _rotate(self, node, up: str, down: str):
        top = getattr(node, up)
        setattr(node, up, getattr(top, down))
        setattr(top, down, node)
        for x in (node, top):
            x.height = 1 + max(self._height(x.left), self._height(x.right))
        return top

    def add(self, key) -> None:
        def put(node):
            if node is None:
                return self.Node(key)
            if key < node.key:
                node.left = put(node.left)
            else:
                node.right = put(node.right)
            return self._fix(node)

        self.root = put(self.root)

    def remove(self, key) -> None:
        def take(node, key):
            if key < node.key:
                node.left = take(node.left, key)
            elif key > node.key:
                node.right = take(node.right, key)
            elif node.left is None or node.right is None:
                return node.left or node.right
            else:
                low = node.right
                while low.left:
                    low = low.left
                node.key = low.key
                node.right = take(node.right, low.key)
            return self._fix(node)

        self.root = take(self.root, key)

    def tightest(self, size: int):
        """The least (capacity, shard) whose capacity is at least size, or None."""
        node, best = self.root, None
        while node:
            if node.key[0] >= size:
                best, node = node.key, node.left
            else:
                node = node.right
        return best


def plan(counts: dict[int, int], capacity: int, most: int | None = None) -> tuple[np.ndarray, int] | None:
    """Shards of all groups, and their number: rows of size, first rank, number, first shard and groups a shard, sorted by the first two.

    ``counts``: number of groups of each size. The group of rank k is in shard
    ``first + (k - first rank) // groups a shard``. None if it takes more than ``most`` shards.
    """
    tree, runs, places, opened = Capacities(), {}, [], 0  # runs: remaining capacity -> runs of shards (first, number)

    def put(left: int, first: int, n: int) -> None:
        if left > 0:
            if left not in runs:
                runs[left] = deque()
                tree.add((left, 0))
            runs[left].append((first, n))

    for size in sorted(counts, reverse=True):
        n, rank = counts[size], 0
        if size <= 0:
            places.append((size, 0, n, 0, n))
            opened = max(opened, 1)
            continue
        while n:
            at = tree.tightest(size)
            if at is None:
                left, first = capacity, opened
                shards = -(-n // max(1, capacity // size))
                opened += shards
                if most is not None and opened > most:
                    return None
            else:
                left = at[0]
                first, shards = runs[left].popleft()
                if not runs[left]:
                    del runs[left]
                    tree.remove(at)
            each = max(1, left // size)
            full = min(shards, n // each)
            if full:
                places.append((size, rank, full * each, first, each))
                put(left - each * size, first, full)
                n, rank, first, shards = n - full * each, rank + full * each, first + full, shards - full
            if n and shards:
                places.append((size, rank, n, first, n))
                put(left - n * size, first, 1)
                n, first, shards = 0, first + 1, shards - 1
            if shards:
                put(left, first, shards)
    return np.array(sorted(places), np.int64).reshape(-1, 5), opened


def even_plan(counts: dict[int, int], shards: int) -> np.ndarray:
    """The plan with the least capacity found for which best fit needs no more than so many shards."""
    total = sum(size * n for size, n in counts.items())
    low = max(-(-total // shards), 1) - 1  # too little, or next to it
    step = max(1, low // 4096)
    while (best := plan(counts, low + step, shards)) is None:
        low, step = low + step, 2 * step
    high = low + step
    while high - low > 1:
        mid = (low + high) // 2
        if (got := plan(counts, mid, shards)) is None:
            low = mid
        else:
            high, best = mid, got
    return best[0]


def _ranked(rows: DataFrame, key: str, parts: DataFrame, order: list) -> DataFrame:
    """``rows`` and rank, from 0 within each key. ``parts``: key and parts, into how many its rows are dealt by their number k."""
    salted = rows.join(parts, key).withColumn("salt", F.pmod(F.xxhash64("k"), F.col("parts"))).drop("parts")
    sizes = salted.groupBy(key, "salt").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(key, "salt").orderBy(*order)) - 1
    out = salted.withColumn("rank", rank).join(sizes.select(key, "salt", before.alias("before")), [key, "salt"])
    return out.withColumn("rank", (F.col("rank") + F.col("before")).cast("long")).drop("salt", "before")


def assign(rows: DataFrame, group: str, size: str, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """``rows`` and the shard of each, by ``shards`` even ones or as few as hold ``capacity`` each."""
    spark = rows.sparkSession
    uri = scratch(spark, "groups")
    packed = rows.select(F.struct(*(c for c in rows.columns if c != "shard")).alias("row"), F.col(group).alias("g"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))
    sums = packed.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    groups = stored(sums.withColumn("k", F.monotonically_increasing_id()), "groups", uri)
    kinds = stored(groups.groupBy("n").agg(F.count("*").alias("m")), "kinds", uri)
    counts = {r["n"]: r["m"] for r in kinds.collect()}  # different sizes: see above
    all_bytes, all_rows = (groups.agg(F.sum("n"), F.sum("c")).first()[k] or 0 for k in (0, 1))
    places = even_plan(counts, shards) if shards else plan(counts, capacity)[0]
    name = f"{uri}/places.bin"
    write_file(name, [np.ascontiguousarray(places)])

    def place(it):
        at = map_file(name).view(np.int64).reshape(-1, 5)
        for batch in it:
            n, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            last = np.searchsorted(at[:, 0], n, side="right")
            row = _last_at_most(at, np.searchsorted(at[:, 0], n), last, rank)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at[row, 3] + (rank - at[row, 1]) // at[row, 4]), batch.column(3)], ["g", "shard", "hot"])

    parts = small(kinds.select("n", F.ceil(F.col("m") / RANKED).alias("parts")))
    hot = (F.col("n") * HOT > all_bytes) | (F.col("c") * HOT > all_rows)
    ranked = _ranked(groups, "n", parts, ["k"]).select("g", "n", "rank", hot.alias("hot"))
    kind = rows.schema[group].dataType.simpleString()
    placed = stored(ranked.mapInArrow(place, f"g {kind}, shard long, hot boolean"), "placed", uri)
    large, rest = F.broadcast(placed.where("hot").select("g", "shard")), placed.where("NOT hot").select("g", "shard")
    same = lambda a, b: a["g"].eqNullSafe(b["g"])
    others = packed.join(large, same(packed, large), "left_anti")
    out = packed.join(large, same(packed, large)).select("row", "shard").unionByName(others.join(rest, same(others, rest)).select("row", "shard"))
    return out.select("row.*", F.col("shard").cast("int").alias("shard"))


def _last_at_most(at: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The last row of ``at`` within [low, high) whose first rank is at most rank."""
    low, high = low.copy(), high.copy()
    while (wide := high - low > 1).any():
        mid = (low + high) // 2
        ok = at[np.minimum(mid, len(at) - 1), 1] <= rank
        low, high = np.where(wide & ok, mid, low), np.where(wide & ~ok, mid, high)
    return low


def numbered(rows: DataFrame, shard: str, *order: str) -> DataFrame:
    """``rows`` and a gapless slot from 0 in each shard, in the order of these columns. Ranks are counted in salted parts, so a shard is not one task's."""
    packed = rows.select(F.struct(*(c for c in rows.columns if c != "slot")).alias("row"), F.col(shard).alias("of"), F.struct(*order).alias("by"))
    packed = stored(packed.withColumn("k", F.monotonically_increasing_id()), "rows", scratch(rows.sparkSession, "slots"))
    parts = packed.groupBy("of").agg(F.ceil(F.count("*") / RANKED).alias("parts"))
    got = _ranked(packed, "of", small(stored(parts, "parts", scratch(rows.sparkSession, "slots"))), ["by", "k"])
    return got.select("row.*", F.col("rank").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row: equal texts share a shard, shards are near equal in bytes."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    group = F.when(F.col(text).isNotNull(), F.unhex(F.sha2(raw, 256)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), group.alias("grp"))
    rows = stored(rows, "sizes", scratch(docs.sparkSession, "shards"))
    return numbered(assign(rows, "grp", "size", shards=shards).drop("grp"), "shard", "doc_id", "text_crc32", "size")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    got = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
