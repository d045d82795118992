"""Connected components of a graph of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import stored


#: Links up to which one task may hold those of a hub.
HUB = 1_000_000


def component_roots(links: DataFrame, uri: str, rows: int | None = None) -> DataFrame:
    """rep and component (the smallest rep that its links reach) of each linked node but the roots. ``links``: a, b. ``rows``: a bound on their number.

    Alternates large-star and small-star steps (Kiveris et al. 2014): each round
    hangs neighbours below their smallest one, until all of a component hang below
    its least node. The number of links never grows; rounds are few even for long
    chains. A node's step is a minimum over its links, so a hub costs one partial
    aggregation. Each round is written below ``uri``. Of many links the minima are
    written too: a join of two stored tables is one whose hot keys Spark can split.
    """
    def stars(edges: DataFrame) -> bool:
        """Whether every node is a root or hangs below one root."""
        ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("a", F.lit(0), F.lit(1)))
        sums = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        return not sums.agg(F.max((F.col("below") > 1) | (F.col("below") > 0) & (F.col("above") > 0))).first()[0]

    def kept(minima: DataFrame, label: str) -> DataFrame:
        return stored(minima, label, uri) if n > HUB else minima

    def large(edges: DataFrame) -> DataFrame:
        ends = edges.union(edges.select("b", "a"))
        low = kept(ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"large{k}")
        return ends.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b")

    def small(edges: DataFrame) -> DataFrame:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        if n > HUB:
            down = stored(down, f"down{k}", uri)
        low = kept(down.groupBy("a").agg(F.min("b").alias("m")), f"small{k}")
        made = down.join(low, "a").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        return made.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    edges, k = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "r0", uri, rows), 0
    n = edges.count()
    while not stars(edges):
        k += 1
        edges = stored(small(large(edges)), f"r{k}", uri, n)
        n = edges.count()
    return edges.select(F.col("b").alias("rep"), F.col("a").alias("component"))
