"""Near-duplicate documents by SetSketch registers, banded, then confirmed on full shingle sets.

A register holds ``clip(floor(1 - log_b(min x)), 0, q + 1)``, where x are exponential
variates of rate a, one of each shingle: exponentially spaced, truncated minima.
Registers of a union are the element-wise maxima; two registers agree with a
probability near the Jaccard similarity for b near 1.

1. Each document becomes a fingerprint of its shingle set, the set's size and its
   registers. Documents of one fingerprint are one class, whatever their number;
   a class goes on under a number, its texts are read from its smallest doc_id.
2. Bands of registers put classes into buckets. In each bucket the smallest class
   leads. Each class is first compared with the leader that it shares most buckets
   with: one pair a class, however large its buckets.
3. A pair's similarity is estimated by joint likelihood of both register arrays;
   hopeless pairs go. The rest is confirmed on full shingle sets.
4. Links make components. Buckets whose classes then lie in several components are
   looked at again: the classes outside of a bucket's largest component meet all others
   there, in blocks. Sketches tell which may have a partner in another component, and
   the full sets of these are compared in their block's task. It gives the links that
   join components, one less than it joins: nothing is lost to the choice of leaders,
   and no rows stand for other pairs. A bucket of one component, as a large group of
   near copies makes it, costs nothing here.

Hot keys: buckets are joined with stored tables, so Spark can split them; a leader of
more than ``LED`` classes is copied, and its classes are dealt out among the copies.

Texts without words are linked with nothing. A null doc_id takes part in no link.
Rows that repeat a doc_id are one document: whatever any of them is linked with, it is
linked with. Classes that share a doc_id are linked, whatever their texts. Long texts
are sketched in parts that merge. Empty tables give no rows. Other columns are not looked
at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import component_roots
from .shared import scratch, small, stored, tidy
from .words import SPACED, batches, grams, hashes, mix

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Parameters of the sketch: base, rate and largest register of 16 bits.
B, A, Q = 1.001, 20.0, (1 << 16) - 2
#: A pair goes unconfirmed only if its estimate is so many standard errors too low.
SIGMAS = 6.0
#: Classes and shingles of a block of a bucket: two blocks are compared at a time.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Classes that are compared with one copy of their leader.
LED = 1024

with np.errstate(over="ignore"):
    _seeds = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MUL, _ADD = _seeds[:REGISTERS] | np.uint64(1), _seeds[REGISTERS:]


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; with fewer words the whole sequence is the only shingle."""
    words, at = hashes(data, bounds, SPACED)
    shingles, cut = grams(words, at, tuple(range(k)))
    out = []
    with np.errstate(over="ignore"):
        for r in range(len(bounds) - 1):
            n = int(at[r + 1] - at[r])
            if n >= k:
                x = np.sort(shingles[cut[r] : cut[r + 1]])
                out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            elif n:
                whole = np.uint64(0)
                for w in words[at[r] : at[r + 1]]:
                    whole = whole * np.uint64(0xD6E8FEB86659FD93) + w
                out.append(mix(np.array([whole + np.uint64(n)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of non-empty sets, one row each."""
    out = np.empty((len(sets), REGISTERS), np.uint16)
    size = np.array([len(x) for x in sets])
    step, a = 1 << 16, 0
    while a < len(sets):
        b, total = a + 1, size[a]
        while b < len(sets) and total + size[b] <= step:
            total += size[b]
            b += 1
        if b == a + 1 and total > step:  # merge the sketches of the parts
            lows = np.min([_minima(sets[a][i : i + step], np.zeros(1, np.int64)) for i in range(0, total, step)], axis=0)
        else:
            lows = _minima(np.concatenate(sets[a:b]), np.concatenate([[0], np.cumsum(size[a : b - 1])]))
        x = -np.log1p(-(lows.astype(np.float64) + 0.5) * 2.0**-64) / A
        out[a:b] = np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, Q + 1)
        a = b
    return out


def _minima(elements: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Least hash of each set under each register's hash function."""
    lows = np.empty((len(starts), REGISTERS), np.uint64)
    value = np.empty_like(elements)
    with np.errstate(over="ignore"):
        for i in range(REGISTERS):
            np.multiply(elements, _MUL[i], out=value)
            value ^= value >> np.uint64(32)
            value *= _ADD[i] | np.uint64(1)
            lows[:, i] = np.minimum.reduceat(value, starts)
    return lows


def joint_similarity(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs by maximum likelihood of their register comparisons, set sizes known."""
    above, below = (u > v).sum(1).astype(float), (u < v).sum(1).astype(float)
    same = u.shape[1] - above - below
    p, q = nu / (nu + nv), nv / (nu + nv)
    top = np.minimum(p / q, q / p)
    grid = np.linspace(0, 1, 65)[None, :] * top[:, None]

    def likelihood(j):
        def at_base(x):
            return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

        hi, lo = at_base(p[:, None] - q[:, None] * j), at_base(q[:, None] - p[:, None] * j)
        tiny = 1e-12
        return above[:, None] * np.log(hi + tiny) + below[:, None] * np.log(lo + tiny) + same[:, None] * np.log(np.maximum(1 - hi - lo, 0) + tiny)

    best = likelihood(grid).argmax(1)
    rows = np.arange(len(u))
    low, high = grid[rows, np.maximum(best - 1, 0)], grid[rows, np.minimum(best + 1, 64)]
    fine = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, 17)[None, :]
    return fine[rows, likelihood(fine).argmax(1)]


def _least(threshold: float) -> float:
    return threshold - SIGMAS * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fingerprint and registers; the last two are null without words. ``docs``: doc_id, text."""

    def run(it):
        for batch in it:
            for a, b, data, bounds in batches(batch, "text"):
                sets = shingle_sets(data, bounds)
                some = [i for i, x in enumerate(sets) if len(x)]
                sketch = registers([sets[i] for i in some]) if some else []
                prints: list[bytes | None] = [None] * (b - a)
                regs: list[bytes | None] = [None] * (b - a)
                for j, i in enumerate(some):
                    prints[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    regs[i] = sketch[j].tobytes()
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "n_shingles": pa.array([len(x) for x in sets], pa.int64()), "fingerprint": pa.array(prints, pa.binary()), "registers": pa.array(regs, pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, fingerprint binary, registers binary")


def _buckets(registers: pa.Array) -> np.ndarray:
    """The bucket of each class in each band, one after the other."""
    regs = np.frombuffer(b"".join(registers.to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, r])
    return key.reshape(-1).view(np.int64)


def _banded(classes: DataFrame) -> DataFrame:
    """Bucket, band and class: a row for each band."""

    def run(it):
        for batch in it:
            if n := batch.num_rows:
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(_buckets(batch.column(1))), "band": pa.array(np.tile(np.arange(BANDS, dtype=np.int8), n)), "rep": pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))})

    return classes.select("rep", "registers").mapInArrow(tidy(run), "bucket long, band byte, rep long")


def _leaders(classes: DataFrame) -> DataFrame:
    """bucket and its smallest class, of buckets with two classes at least.

    Most buckets hold one class, so partial sums of a task would be a large table that
    saves little. Only what a batch holds of a bucket is added up before the shuffle: a
    row of a frequent bucket for each batch.
    """

    def run(it):
        for batch in it:
            if batch.num_rows:
                bucket, rep = _buckets(batch.column(1)), np.repeat(batch.column(0).to_numpy(), BANDS)
                order = np.lexsort((rep, bucket))
                bucket, rep = bucket[order], rep[order]
                at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[at]), "a": pa.array(rep[at]), "m": pa.array(np.diff(np.append(at, len(bucket))))})

    parts = classes.select("rep", "registers").mapInArrow(tidy(run), "bucket long, a long, m long").repartition("bucket")
    return parts.groupBy("bucket").agg(F.min("a").alias("a"), F.sum("m").alias("m")).where("m > 1").select("bucket", "a")


def _with_leader(pairs: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """``pairs`` (a, b; stored, n rows) with the columns of ``table``, one of which is a. A leader of many has copies."""
    if n <= LED:
        return pairs.join(table, "a")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / LED).cast("int").alias("copies")).where("copies > 1")
    many = small(many)
    copies = F.coalesce("copies", F.lit(1))
    salted = pairs.join(many, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), copies).cast("int")).drop("copies")
    copied = table.join(many, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    return salted.join(copied, ["a", "salt"]).drop("salt")


def _estimated(pairs: DataFrame, classes: DataFrame, threshold: float, rows: int) -> DataFrame:
    """Pairs whose sizes and sketches allow the similarity."""
    c = classes.select("rep", "n", "registers")
    both = _with_leader(pairs, c.toDF("a", "na", "ra"), rows).join(c.toDF("b", "nb", "rb"), "b").where(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))
    least = _least(threshold)

    def run(it):
        for batch in it:
            if batch.num_rows:
                u, v = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
                j = joint_similarity(u, v, batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy().astype(float))
                yield batch.select([0, 1]).filter(pa.array(j >= least))

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(tidy(run), "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep and shingles of wanted classes (stored: rep, lead, fingerprint). Only the texts of their leads are worked on, only their sets move."""

    def run(it):
        for batch in it:
            for _, _, data, bounds in batches(batch, "text"):
                sets = shingle_sets(data, bounds)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), lists], ["fingerprint", "shingles"])

    texts = docs.join(small(wanted.select(F.col("lead").alias("doc_id")).distinct()), "doc_id", "left_semi").select("text")
    return texts.mapInArrow(tidy(run), "fingerprint binary, shingles array<long>").join(small(wanted.select("rep", "fingerprint")), "fingerprint").select("rep", "shingles")


def _wanted(reps: DataFrame, classes: DataFrame, label: str, uri: str, rows: int) -> DataFrame:
    return stored(classes.join(small(reps.distinct()), "rep", "left_semi").select("rep", "lead", "fingerprint"), label, uri, rows)


def _same_documents(named: DataFrame, classes: DataFrame, uri: str) -> DataFrame:
    """Links a, b between the classes that share a doc_id: each with the one of least fingerprint."""
    several = named.groupBy("doc_id").agg(F.min("fingerprint").alias("lo"), F.max("fingerprint").alias("hi")).where("lo < hi").select("doc_id", "lo")
    several = small(stored(several, "several", uri))
    links = named.select("doc_id", "fingerprint").join(several, "doc_id").where("fingerprint > lo").select("lo", "fingerprint").distinct()
    c = classes.select("fingerprint", "rep")
    return links.join(c.toDF("lo", "a"), "lo").join(c.toDF("fingerprint", "b"), "fingerprint").select("a", "b")


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, uri: str, rows: int) -> DataFrame:
    """Pairs whose full shingle sets are similar enough."""
    sets = _sets(docs, _wanted(pairs.select(F.explode(F.array("a", "b")).alias("rep")), classes, "wanted0", uri, rows))
    both = _with_leader(pairs, sets.toDF("a", "sa"), rows).join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    ok = F.lit(100) * shared >= F.lit(percent) * (F.size("sa") + F.size("sb") - shared)
    return both.where(ok).select("a", "b").distinct()


def _pairs(low: np.ndarray, high: np.ndarray, most: int):
    """Index pairs of each row x and all of low[x] to high[x] - 1, about ``most`` at a time."""
    left, row = high - low, np.arange(len(low))
    cuts = np.searchsorted(np.cumsum(left), np.arange(most, left.sum() + most, most))
    for i, j in zip([0, *(cuts + 1)], [*(cuts + 1), len(row)], strict=True):
        n = left[i:j]
        if n.sum():
            yield np.repeat(row[i:j], n), np.repeat(low[i:j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _whole_cells(it, least: int = 1 << 14):
    """Tables of rows sorted by bucket and cell, cut only between cells."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in it:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held)
            bucket, cell = table["bucket"].to_numpy(), table["cell"].to_numpy()
            other = np.flatnonzero((bucket != bucket[-1]) | (cell != cell[-1]))
            end = int(other[-1]) + 1 if len(other) else 0
            if end:
                yield table.slice(0, end)
            held, rows = table.slice(end).to_batches(), table.num_rows - end
    if held:
        yield pa.Table.from_batches(held)


def _starts(bucket: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])]))


def _suspects(bands: DataFrame, labels: DataFrame, classes: DataFrame, threshold: float, uri: str, rows: int) -> DataFrame:
    """bucket, cell, rep, component: classes that have a partner in another component in their bucket, as far as sketches tell.

    A bucket's classes are dealt out in blocks: ``few`` of those outside of its largest
    component, ``most`` of the others. Each of the first meets each of the second in a
    cell, and each other one of the first in another; side 1 of a cell is compared with
    side 0, and with itself where the cell is the first of its block. A pair that shares
    several buckets is looked at in the first of their bands.
    """
    held = bands.select("bucket", "band", "rep").join(labels, "rep").join(classes.select("rep", "n"), "rep")
    each = held.groupBy("bucket", "component").agg(F.struct(F.count("*").alias("c"), F.sum("n").alias("s"), F.col("component").alias("top")).alias("x"))
    mixed = each.groupBy("bucket").agg(F.max("x").alias("x"), F.sum("x.c").alias("c"), F.sum("x.s").alias("s"), F.count("*").alias("k")).where("k > 1")
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")
    mixed = mixed.select("bucket", "x.top", blocks(F.col("x.c"), F.col("x.s")).alias("most"), blocks(F.col("c") - F.col("x.c"), F.col("s") - F.col("x.s")).alias("few"))
    members = held.join(small(stored(mixed, "mixed", uri, rows)), "bucket").withColumn("own", F.col("component") != F.col("top"))
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("own"), F.col("few")).otherwise(F.col("most"))).cast("int"))
    block, few, most = F.col("block"), F.col("few"), F.col("most")
    cell = lambda number, side, inner: F.struct(number.cast("int").alias("cell"), side.cast("byte").alias("side"), inner.alias("inner"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    none = F.lit(False)
    theirs = F.transform(upto(few), lambda i: cell(i * most + block, F.lit(0), none))
    ours = F.transform(upto(most), lambda j: cell(block * most + j, F.lit(1), j == 0))
    others = F.transform(F.filter(upto(few), lambda i: i != block), lambda i: cell(few * most + F.least(i, block) * few + F.greatest(i, block), i < block, none))
    dealt = members.join(classes.select("rep", "registers"), "rep").withColumn("x", F.explode(F.when(F.col("own"), F.concat(ours, others)).otherwise(theirs)))
    dealt = dealt.select("bucket", "band", "x.cell", "x.side", "x.inner", "rep", "component", "n", "registers")
    least = _least(threshold)

    def run(it):
        for table in _whole_cells(it):
            rep, comp, n, band, bucket, cell, side, inner = (table[k].to_numpy() for k in ("rep", "component", "n", "band", "bucket", "cell", "side", "inner"))
            regs = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
            starts = _starts(bucket, cell)
            sizes, place = np.diff(np.append(starts, len(rep))), np.arange(len(rep))
            end = np.repeat(starts + sizes, sizes)
            zero = np.repeat(starts + np.add.reduceat((side == 1).astype(np.int64), starts), sizes)  # where side 0 begins
            low = np.where(side == 1, np.where(inner, place + 1, zero), end)
            flagged = np.zeros(len(rep), bool)
            for x, y in _pairs(low, end, 1 << 17):
                ok = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]))
                x, y = x[ok], y[ok]
                for i in range(0, len(x), 4096):
                    u, v = x[i : i + 4096], y[i : i + 4096]
                    same = regs[u] == regs[v]
                    first = same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[u]
                    u, v = (k[first & (same.sum(1) >= REGISTERS * (least - 0.15))] for k in (u, v))  # neither another band's nor hopeless
                    if len(u):
                        good = joint_similarity(regs[u], regs[v], n[u].astype(float), n[v].astype(float)) >= least
                        flagged[u[good]] = flagged[v[good]] = True
            got = table.select(["bucket", "cell", "rep", "component"]).filter(pa.array(flagged)).combine_chunks()
            yield from got.to_batches()

    return dealt.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", F.desc("side")).mapInArrow(tidy(run), "bucket long, cell int, rep long, component long")


def _across(suspects: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, uri: str, rows: int) -> DataFrame:
    """Links a, b between components, of full sets: in each cell as many as join all that can be joined there, fewer than it has components."""
    sets = _sets(docs, _wanted(suspects.select("rep"), classes, "wanted1", uri, rows))
    full = suspects.join(sets, "rep").select("bucket", "cell", "rep", "component", "shingles")

    def links(rep, comp, sets, size):
        at = np.repeat(np.arange(len(rep)), size)
        order = np.argsort(sets, kind="stable")
        keys, first = np.unique(sets[order], return_index=True)
        holder, end = at[order], np.append(first[1:], len(sets))
        cut = np.concatenate([[0], np.cumsum(size)])
        names, comp, members = np.unique(comp, return_inverse=True, return_counts=True)
        joined = np.arange(len(names))  # the set of each component, by its number
        for x in np.flatnonzero(comp != members.argmax()):  # the largest component's rows are the others' partners
            k = np.searchsorted(keys, sets[cut[x] : cut[x + 1]])
            n = end[k] - first[k]
            spots = np.repeat(first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            shared = np.bincount(holder[spots], minlength=len(rep))
            found = np.flatnonzero((joined[comp] != joined[comp[x]]) & (100 * shared >= percent * (size + size[x] - shared)))
            for y in found[np.unique(joined[comp[found]], return_index=True)[1]]:
                joined[joined == joined[comp[y]]] = joined[comp[x]]
                yield rep[x], rep[y]

    def run(it):
        for table in _whole_cells(it, 1):
            rep, comp, bucket, cell = (table[k].to_numpy() for k in ("rep", "component", "bucket", "cell"))
            lists = table["shingles"].combine_chunks()
            size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            cut = np.concatenate([[0], np.cumsum(size)])
            starts = _starts(bucket, cell)
            got = [p for i, j in zip(starts, [*starts[1:], len(rep)], strict=True) for p in links(rep[i:j], comp[i:j], flat[cut[i] : cut[j]], size[i:j])]
            yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in got], pa.int64()), "b": pa.array([p[1] for p in got], pa.int64())})

    return full.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").mapInArrow(tidy(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept of each row."""
    spark, threshold = docs.sparkSession, percent / 100
    uri = scratch(spark, "near")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = stored(sketches(docs), "sketches", uri)
    named = sketched.where("doc_id IS NOT NULL AND fingerprint IS NOT NULL")
    grouped = named.groupBy("fingerprint").agg(F.min("doc_id").alias("lead"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = stored(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes", uri)
    n = classes.count()
    banded = _banded(classes)
    leaders = stored(_leaders(classes), "leaders", uri)
    bands = stored(banded.join(leaders, "bucket").select("bucket", "band", "rep", "a"), "bands", uri)
    led = bands.where("a < rep").groupBy(F.col("rep").alias("b"), "a").agg(F.count("*").alias("m"))
    stars = stored(led.groupBy("b").agg(F.max_by("a", F.struct("m", -F.col("a"))).alias("a")).select("a", "b"), "stars", uri, n)
    likely = stored(_estimated(stars, classes, threshold, n), "likely", uri, n)
    links = _confirmed(likely, docs, classes, percent, uri, n).unionByName(_same_documents(named, classes, uri))
    roots = component_roots(stored(links, "links0", uri, n), f"{uri}/components0", n)
    labels = stored(classes.select("rep").join(roots, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component")), "labels0", uri, n)
    suspects = stored(_suspects(bands, labels, classes, threshold, uri, n), "suspects", uri, n)
    found = stored(_across(suspects, docs, classes, percent, uri, n), "links1", uri, n)
    ends = found.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = component_roots(ends, f"{uri}/components1", n).toDF("component", "root")
    labels = labels.join(roots, "component", "left").select("rep", F.coalesce("root", "component").alias("component"))
    by_class = stored(classes.select("fingerprint", "lead", "rep").join(labels, "rep").select("fingerprint", "lead", "component"), "labels1", uri, n)
    least = by_class.groupBy("component").agg(F.min("lead").alias("least"), F.count("*").alias("m")).where("m > 1").select("component", "least")
    by_print = by_class.join(small(stored(least, "least", uri, n)), "component", "left").select("fingerprint", F.coalesce("least", "lead").alias("component"))
    by_print = stored(by_print, "components", uri, n)
    wordless = small(sketched.where("doc_id IS NOT NULL AND fingerprint IS NULL").select("doc_id").distinct())
    other = named.join(wordless, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("fingerprint").alias("other"))  # of rows that repeat a wordless one's id
    rows = sketched.select("doc_id", "n_shingles", "fingerprint").join(small(stored(other, "other", uri, n)), "doc_id", "left")
    out = rows.select("doc_id", "n_shingles", F.coalesce("fingerprint", "other").alias("fingerprint")).join(by_print, "fingerprint", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
c(a, b) AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT a, min(b) AS lo FROM c GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(lo, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(lo, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
