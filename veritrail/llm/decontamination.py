"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

1. ``Index`` stores term, row and position of each word of a corpus, for any benchmark.
   It is written as the scan goes, so no text or posting is shuffled to build it. Terms
   are 64-bit hashes. A posting without term ends each row: it holds the row's doc_id
   and its number of words, so texts are read once.
2. Each window of a benchmark item (``window`` words in a row, or a shorter item's
   all) names its two rarest terms by their frequency in the index. The postings of
   these terms, less their offset in the item, are where the item would start: its
   diagonal in the document. A diagonal goes on if two of its anchors meet on it.
3. The other terms' postings on these diagonals are joined by row and position.
   Runs of consecutive item words are windows that occur; all positions in them are
   hit. A passage makes one diagonal, not one match for each window.

Each pass reads only the columns that it needs; counting frequencies reads terms alone.
Small sides (the benchmark's terms, its anchors; candidate rows) are broadcast if their
bytes are below a limit. Beyond it a join shuffles two stored tables, whose hot terms
Spark can split.

Items are matched by number, one for each distinct pair of id and text, and get their
ids when matches are collected: copies count once, other texts of an id are looked for too.

Null and empty texts have no words, and long ones are no other: their postings stream.
Without items nothing is contaminated; without documents there are no rows. Other columns
of the inputs are not looked at, whatever their names. Null ids of items are dropped. Rows
are looked at each by itself, whether they repeat a doc_id or have none. Two words with the same hash
would count as one: for a benchmark of 10^5 words and a corpus of 10^9 that has a
probability of 10^-5, and all of a window's words must agree.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import scratch, small, stored

#: What stands between words, after lower-casing A-Z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10


def words(text: Column) -> Column:
    """Lower-cased words in order; none for null. ``lower`` equals the ASCII mapping where all is ASCII."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(low, F.lit("")), BETWEEN), lambda w: w != "")


class Index:
    """Stored postings of a corpus: t (term), row and pos; where t is null: doc_id and the column ``carry`` of the row, and as pos its number of words."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: str | None = None):
        self.uri = scratch(docs.sparkSession, "index")
        more = [F.col(carry).alias("carry")] if carry else []
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), *more, F.concat(words(F.col(text)), F.array(F.lit(""))).alias("w"))
        flat = rows.select("row", "doc_id", *["carry"] * len(more), F.posexplode("w").alias("pos", "term"))
        end = F.col("term") == ""
        self.all = stored(flat.select(F.when(~end, F.xxhash64("term")).alias("t"), "row", "pos", *(F.when(end, F.col(c)).alias(c) for c in ("doc_id", *["carry"] * len(more)))), "postings", self.uri)
        self.postings = self.all.where("t IS NOT NULL").select("t", "row", "pos")
        self.rows = self.all.where("t IS NULL").withColumnRenamed("pos", "n_words").drop("t")


class Matches:
    """A benchmark's items in an index."""

    def __init__(self, index: Index, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW):
        self.index, self.window = index, window
        self.uri = scratch(items.sparkSession, "matches")
        rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
        self.numbered = stored(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "numbered", self.uri)
        each = self.numbered.select("item", words(F.col("text")).alias("w")).select("item", F.size("w").alias("n"), F.posexplode("w").alias("j", "term"))
        self.items = stored(each.select("item", "n", "j", F.xxhash64("term").alias("t")), "items", self.uri)
        self.size = self.items.count()

    def named(self, found: DataFrame) -> DataFrame:
        """``found`` with the item_id of its item; texts of one id are one item."""
        return found.join(small(self.numbered.select("item", "item_id")), "item")

    @cached_property
    def frequency(self) -> DataFrame:
        """t and f of the benchmark's terms in the index."""
        held = self.index.postings.select("t").join(small(self.items.select("t").distinct()), "t")
        return stored(held.groupBy("t").agg(F.count("*").alias("f")), "frequency", self.uri, self.size)

    def windows(self) -> DataFrame:
        """item, s (first word), and the rarest two words of each window that has no term outside the index: j, t, r (1 or 2)."""
        k = F.least(F.col("n"), F.lit(self.window))
        starts = self.items.groupBy("item").agg(F.max("n").alias("n")).select("item", k.alias("k"), F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("s"))
        inside = starts.withColumn("j", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("k") - 1))).join(self.items.select("item", "j", "t"), ["item", "j"]).join(self.frequency, "t", "left")
        whole = F.count("f").over(Window.partitionBy("item", "s"))
        rarest = F.row_number().over(Window.partitionBy("item", "s").orderBy("f", "j"))
        return inside.withColumns({"found": whole, "r": rarest}).where("found = k AND r <= 2").select("item", "s", "k", "j", "t", "r")

    def diagonals(self) -> DataFrame:
        """item, row and start (the position of the item's word 0, also below 0) where anchors meet."""
        anchors = self.windows().select("item", F.least("k", F.lit(2)).alias("need"), "j", "t").distinct()
        hits = self.index.postings.join(small(stored(anchors, "anchors", self.uri, 2 * self.size)), "t")
        on = hits.groupBy("item", "row", (F.col("pos") - F.col("j")).alias("start")).agg(F.count("*").alias("c"), F.max("need").alias("need"))
        return on.where("c >= need").select("item", "row", "start")

    @cached_property
    def runs(self) -> DataFrame:
        """item, row, start, first and last: item words first to last occur in a row, at start + first on, and hold a window."""
        found = stored(self.diagonals(), "diagonals", self.uri)
        near = self.index.postings.join(small(found.select("row").distinct()), "row", "left_semi")
        path = found.join(small(self.items), "item").withColumn("pos", F.col("start") + F.col("j"))
        met = path.join(near, ["row", "pos", "t"])
        run = F.col("j") - F.row_number().over(Window.partitionBy("item", "row", "start").orderBy("j"))
        runs = met.select("item", "row", "start", "n", "j").withColumn("run", run)
        runs = runs.groupBy("item", "row", "start", "run").agg(F.min("j").alias("first"), F.max("j").alias("last"), F.max("n").alias("n"))
        whole = F.col("last") - F.col("first") + 1 >= F.least(F.col("n"), F.lit(self.window))
        return stored(runs.where(whole).select("item", "row", "start", "first", "last"), "runs", self.uri, found.count())

    def phrases(self) -> DataFrame:
        """Exact matches: item_id, row, doc_id, pos (of the first word) and length of each longest run."""
        found = self.named(self.runs).select("item_id", "row", (F.col("start") + F.col("first")).alias("pos"), (F.col("last") - F.col("first") + 1).alias("length")).distinct()
        return found.join(self.index.rows.select("row", "doc_id"), "row")

    def near(self, slop: int) -> DataFrame:
        """Proximity matches: item_id, s, row and doc_id where a window's words stand within ``slop`` of their places relative to its rarest word, each item word at a word of its own.

        Places of a term are tried from the first on, each item word taking the first
        that is free and near enough: as all reach equally far, that finds a way if there
        is one.
        """
        w = stored(self.windows(), "windows", self.uri, 2 * self.size)
        rare = w.where("r = 1").select("item", "s", "k", F.col("j").alias("j1"), "t")
        second = w.where("r = 2").select("item", "s", F.col("j").alias("j2"), F.col("t").alias("t2"))
        postings = self.index.postings
        at = postings.join(small(rare), "t").select("item", "s", "k", "j1", "row", (F.col("pos") - F.col("j1")).alias("d1"))
        shift = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
        both = at.join(small(second), ["item", "s"], "left")
        met = both.withColumn("shift", shift).withColumn("pos", F.col("d1") + F.col("j2") + F.col("shift")).join(postings.withColumnRenamed("t", "t2"), ["row", "pos", "t2"])
        one = ["item", "s", "k", "row", "d1"]
        cands = met.select(*one).unionByName(both.where("j2 IS NULL").select(*one)).distinct()
        path = cands.withColumn("j", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("k") - 1))).join(small(self.items.select("item", "j", "t")), ["item", "j"])
        there = path.withColumn("shift", shift).withColumn("pos", F.col("d1") + F.col("j") + F.col("shift")).join(postings, ["row", "pos", "t"])
        lists = there.groupBy(*one, "t").agg(F.array_sort(F.collect_set("j")).alias("js"), F.array_sort(F.collect_set("pos")).alias("ps"))
        free = lambda acc, low: F.get(F.filter("ps", lambda p: (p > acc.last) & (p >= low)), 0)

        def take(acc: Column, j: Column) -> Column:
            place = free(acc, F.col("d1") + j - slop)
            ok = F.coalesce(place <= F.col("d1") + j + slop, F.lit(False))
            return F.struct(F.when(ok, place).otherwise(acc.last).alias("last"), (acc.n + ok.cast("int")).alias("n"))

        taken = F.aggregate("js", F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n")), take).n
        full = lists.withColumn("n", taken).groupBy(*one).agg(F.sum("n").alias("n")).where("n = k")
        found = self.named(full).select("item_id", "s", "row").distinct()
        return found.join(self.index.rows.select("row", "doc_id"), "row")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: str | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids as strings) and contaminated of each row. ``carry``: a column that goes along."""
    index = Index(docs, doc_id, text, carry)
    matches = Matches(index, items, item_id, item_text, window)
    runs = matches.runs
    hit = runs.select("row", F.explode(F.sequence(F.col("start") + F.col("first"), F.col("start") + F.col("last"))).alias("pos")).distinct()
    hits = hit.groupBy("row").agg(F.count("*").alias("n_hit"))
    held = matches.named(runs.select("row", "item").distinct()).groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = small(stored(hits.join(held, "row"), "found", index.uri, runs.count()))
    out = index.rows.join(found, "row", "left")
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    more = [F.col("carry").alias(carry)] if carry else []
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), (n > 0).alias("contaminated"), *more)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    got = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT item_id, least(len(w), 10) AS k, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS p FROM v),
kinds AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM d, kinds WHERE len(w) >= k),
m AS (SELECT p.doc_id, p.s, p.k, g.item_id FROM p JOIN g ON p.k = g.k AND array_to_string(p.w[p.s : p.s + p.k - 1], ' ') = g.p),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS pos FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
