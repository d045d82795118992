"""Entity alignment: exact and alias names, similar vectors with compatible times, connected components.

All types are aligned at once; the type is part of every key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ALIASES, ALIGNABLE_TYPES, AlignConfig
from ..functions.text import normalize_name
from ..functions.time import overlap
from ..store import scratch, small, stored
from .components import component_roots

#: Names of a block: the similarities of two blocks are one task's.
BLOCK = 4096
SEP = "\x1f"


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with degree: edges that touch it, a loop counted once."""
    heads = edges.select(F.col("head_name").alias("name"), F.col("head_type").alias("type"))
    tails = edges.where("NOT (head_name <=> tail_name AND head_type <=> tail_type)").select(F.col("tail_name").alias("name"), F.col("tail_type").alias("type"))
    n = heads.unionByName(tails).groupBy("name", "type").agg(F.count("*").alias("degree"))
    return nodes.join(n, ["name", "type"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def group_name(name: Column) -> Column:
    """Normalised name, an alias in its target's place. Names without ASCII letters or digits all become empty."""
    norm = normalize_name(name)
    aliases = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    return normalize_name(F.coalesce(F.try_element_at(aliases, norm), norm))


def exact_groups(nodes: DataFrame, guard_empty: bool = False) -> DataFrame:
    """Nodes with group (type and normalised name) and the group's representative: highest degree, then name."""
    g = group_name(F.col("name"))
    g = F.when((g == "") & F.lit(guard_empty), F.col("name")).otherwise(g)
    named = nodes.withColumn("norm", g)
    reps = named.groupBy("type", "norm").agg(F.min_by("name", F.struct(-F.col("degree"), "name")).alias("rep"), F.count("*").alias("members"))
    return named.join(stored(reps, "reps"), ["type", "norm"])  # stored: Spark can split the rows of a large group


def multiplied(asks: DataFrame, rows: DataFrame, k: int, others: bool) -> DataFrame:
    """type, i (of asks), j (of rows) and sim: of each ask the best k rows of its type in each block of rows, ``others`` than itself.

    ``asks``, ``rows``: type, i, embedding. Each type is cut into blocks; pairs of blocks
    are multiplied as matrices on the executors, and each ask keeps its best k before
    anything moves.
    """
    import numpy as np
    import pyarrow as pa

    blocks = lambda df, name: df.groupBy("type").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = small(stored(blocks(asks, "gq").join(blocks(rows, "gr"), "type"), "blocks"))

    def dealt(df: DataFrame, side: int, own: str, other: str) -> DataFrame:
        each = df.select("type", "i", "embedding").join(sizes, "type").withColumn("_own", F.pmod(F.xxhash64("i"), F.col(own)).cast("int"))
        each = each.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        a, b = ("_own", "_other") if side == 0 else ("_other", "_own")
        return each.select("type", F.col(a).alias("a"), F.col(b).alias("b"), F.lit(side).alias("side"), F.col("i").cast("long").alias("i"), "embedding")

    def run(t: pa.Table) -> pa.Table:
        side, ids = t["side"].to_numpy(), t["i"].to_numpy()
        v = np.array(t["embedding"].to_pylist(), np.float64)
        q, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out: list[list] = [[], [], []]
        for s in range(0, len(q) if len(r) else 0, 512):
            part = q[s : s + 512]
            sim = np.zeros((len(part), len(r)))
            for d in range(v.shape[1]):  # in this order, as a fold over the array would
                sim += v[part, d][:, None] * v[r, d][None, :]
            if others:
                sim[ids[part][:, None] == ids[r][None, :]] = -np.inf
            for row, x in enumerate(part):
                best = np.lexsort((ids[r], -sim[row]))[:k]
                best = best[np.isfinite(sim[row][best])]
                for held, found in zip(out, ([ids[x]] * len(best), ids[r[best]], sim[row][best]), strict=True):
                    held.extend(found)
        kind = t["type"][0].as_py()
        return pa.table({"type": pa.array([kind] * len(out[0]), pa.string()), "i": pa.array(out[0], pa.int64()), "j": pa.array(out[1], pa.int64()), "sim": pa.array(out[2], pa.float64())})

    cells = dealt(asks, 0, "gq", "gr").unionByName(dealt(rows, 1, "gr", "gq"))
    return cells.groupBy("type", "a", "b").applyInArrow(run, "type string, i long, j long, sim double")


def bucketed(vectors: DataFrame, planes: int, tables: int, seed: int = 0) -> DataFrame:
    """``vectors`` once for each of ``tables`` sets of random planes; the sides of the planes that a vector is on become part of its type."""
    import numpy as np
    import pyarrow as pa

    def run(it):
        normals = None
        for batch in it:
            if not batch.num_rows:
                continue
            v = np.array(batch.column(2).to_pylist(), np.float64)
            if normals is None:
                normals = np.random.default_rng(seed).normal(size=(v.shape[1], tables, planes))
            side = (np.tensordot(v, normals, 1) > 0) @ (1 << np.arange(planes))
            for t in range(tables):
                names = [f"{x}{SEP}{t}{SEP}{s}" for x, s in zip(batch.column(0).to_pylist(), side[:, t], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column(1), batch.column(2)], ["type", "i", "embedding"])

    rows = vectors.select("type", F.col("i").cast("long").alias("i"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.mapInArrow(run, "type string, i long, embedding array<float>")


def similar_pairs(vectors: DataFrame, k: int, threshold: Column | float, planes: int | None = None, tables: int = 16) -> DataFrame:
    """Pairs i, j of one type with similarity: j is among i's k - 1 nearest others, comes after i in order, and is similar enough.

    ``vectors``: type, i (order), embedding. Exact: a type of n names costs n * n
    products, and shuffles k * n / BLOCK rows a name. With ``planes`` only vectors that
    share a bucket of so many random planes in one of the tables are compared: each
    bucket has about n / 2**planes. Of pairs with a cosine of 0.85, eight planes and
    sixteen tables find 97 in 100; what they find has its exact similarity.
    """
    if planes:
        held = stored(bucketed(vectors, planes, tables), "buckets")
        near = multiplied(held, held, k, True).withColumn("type", F.substring_index("type", SEP, 1)).distinct()
    else:
        near = multiplied(vectors, vectors, k, True)
    rank = F.row_number().over(Window.partitionBy("type", "i").orderBy(F.desc("sim"), "j"))
    return near.withColumn("rank", rank).where((F.col("rank") <= k - 1) & (F.col("j") > F.col("i")) & (F.col("sim") >= threshold)).select("type", "i", "j", "sim")


def align(nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, config: AlignConfig = AlignConfig(), decided_at: Column | None = None, guard_empty: bool = False, types: tuple[str, ...] = ALIGNABLE_TYPES) -> tuple[DataFrame, DataFrame]:
    """Nodes with canonical_id, and decisions (entity_a, entity_b, type, method, similarity, temporal_check, temporal_reason, decision, timestamp).

    ``vectors``: name, type, embedding of names that may be representatives. Exact and
    alias matches have no temporal check; similar ones compare the representatives'
    spans. Nodes of other types than ``types``, and all without a match, keep their
    canonical_id, or get their name.
    """
    uri = scratch(nodes.sparkSession, "align")
    at = decided_at if decided_at is not None else F.current_timestamp()
    mine = degrees(nodes, edges).where(F.col("type").isin(*(t for t in types if t in ALIGNABLE_TYPES)))
    groups = stored(exact_groups(mine, guard_empty), "groups", uri)
    exact = groups.where("name <> rep").select(
        F.col("rep").alias("entity_a"), F.col("name").alias("entity_b"), "type", F.lit("exact_or_alias_match").alias("method"), F.lit(1.0).alias("similarity"),
        F.lit(True).alias("temporal_check"), F.lit(None).cast("string").alias("temporal_reason"), F.lit("merged").alias("decision"), at.alias("timestamp"),
    )
    reps = groups.where("name = rep")
    # numbers in the order of type, degree and name: partitions are ranges of it
    order = ["type", F.desc("degree"), "name"]
    ranged = reps.select("type", "name", "degree", "first_seen", "last_seen").repartitionByRange(*order).sortWithinPartitions(*order)
    reps = stored(ranged.withColumn("i", F.monotonically_increasing_id()), "representatives", uri)
    decisions, links = exact, None
    if vectors is not None:
        with_v = reps.join(vectors.select("name", "type", "embedding"), ["name", "type"])
        need = F.when(F.col("type").isin("Location", "Target"), config.place_threshold).otherwise(config.threshold)
        pairs = similar_pairs(with_v.select("type", "i", "name", "embedding"), config.neighbours, need, config.planes, config.tables)
        ends = reps.select("type", "i", "name", "first_seen", "last_seen")
        both = pairs.join(ends.toDF("type", "i", "na", "fa", "la"), ["type", "i"]).join(ends.toDF("type", "j", "nb", "fb", "lb"), ["type", "j"])
        checked = both.withColumn("t", overlap(F.to_date("fa"), F.to_date("la"), F.to_date("fb"), F.to_date("lb"), config.gap_days))
        checked = stored(checked, "pairs", uri)
        decisions = exact.unionByName(checked.select(
            F.col("na").alias("entity_a"), F.col("nb").alias("entity_b"), "type", F.lit("faiss_embedding").alias("method"), F.round("sim", 4).alias("similarity"),
            F.col("t.ok").alias("temporal_check"), F.col("t.reason").alias("temporal_reason"), F.when(F.col("t.ok"), "merged").otherwise("rejected").alias("decision"), at.alias("timestamp"),
        ))
        links = checked.where("t.ok").select("type", "i", "j")
    node = reps.select("type", "name", "degree", F.col("i").alias("rep_id"))
    if links is not None:
        roots = component_roots(links.select(F.col("i").alias("a"), F.col("j").alias("b")), f"{uri}/components").toDF("rep_id", "component")
        node = node.join(roots, "rep_id", "left")
    else:
        node = node.withColumn("component", F.lit(None).cast("long"))
    node = node.withColumn("component", F.coalesce("component", "rep_id"))
    canon = node.groupBy("type", "component").agg(F.min_by("name", F.struct(-F.col("degree"), "name")).alias("canonical"))
    of_rep = node.join(canon, ["type", "component"]).select("type", F.col("name").alias("rep"), "canonical")
    found = groups.select("type", "name", "rep").join(of_rep, ["type", "rep"]).select("type", "name", "canonical")
    out = nodes.join(found, ["type", "name"], "left")
    return out.select("name", "type", "raw_text", F.coalesce("canonical", "canonical_id", "name").alias("canonical_id"), "first_seen", "last_seen"), decisions


def by_type(nodes: DataFrame) -> DataFrame:
    """Total, canonical and merged of each type."""
    n, c = F.count("*"), F.count_distinct("canonical_id")
    return nodes.groupBy("type").agg(n.alias("total"), c.alias("canonical"), (n - c).alias("merged")).orderBy(F.desc("total"), "type")


def global_counts(nodes: DataFrame) -> DataFrame:
    """Nodes, distinct canonical ids whatever the type, and how much smaller that is in percent."""
    n, c = F.count("*"), F.count_distinct("canonical_id")
    return nodes.agg(n.alias("nodes"), c.alias("canonical"), F.coalesce(F.round(100.0 * (n - c) / F.nullif(n, F.lit(0)), 2), F.lit(0.0)).alias("compression_pct"))


def top_clusters(nodes: DataFrame, n: int = 20) -> DataFrame:
    """The largest clusters of at least two names. Members are gathered only for the clusters that are listed."""
    top = nodes.groupBy("type", "canonical_id").agg(F.count("*").alias("size")).where("size > 1").orderBy(F.desc("size"), "canonical_id", "type").limit(n)
    members = nodes.join(F.broadcast(top), ["type", "canonical_id"])
    return members.groupBy("type", "canonical_id", "size").agg(F.array_sort(F.collect_list("name")).alias("names")).orderBy(F.desc("size"), "canonical_id", "type")
