"""The graph from extractions: endpoints resolved, nodes and edges upserted by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ENTITY_TYPES, UNKNOWN_TYPE
from ..functions.text import blank, clean_entity_text, clean_relation
from ..functions.time import parse_temporal

NODE_KEY = ["name", "type"]
EDGE_KEY = ["head_name", "head_type", "rel_type", "tail_name", "tail_type", "source"]
EDGE_VALUES = ["tau", "tau_raw", "tau_precision", "evidence", "confidence"]


def entities(extractions: DataFrame) -> DataFrame:
    """id, ord, raw, name and type of listed entities that have a name."""
    e = extractions.select("id", F.posexplode("entities").alias("ord", "e"))
    raw, canonical = clean_entity_text(F.col("e.text")), clean_entity_text(F.col("e.canonical_name"))
    name = F.coalesce(F.nullif(canonical, F.lit("")), raw)
    kind = F.coalesce(F.nullif(F.trim("e.type"), F.lit("")), F.lit(UNKNOWN_TYPE))
    return e.select("id", "ord", raw.alias("raw"), name.alias("name"), kind.alias("type")).where("name <> ''")


def relations(extractions: DataFrame) -> DataFrame:
    """id, ord, head, tail and values of relations with both ends. A missing confidence is 1."""
    r = extractions.select("id", F.posexplode("relations").alias("ord", "r"))
    tau = parse_temporal(F.col("r.time"))
    out = r.select("id", "ord", clean_entity_text(F.col("r.head")).alias("head"), clean_entity_text(F.col("r.tail")).alias("tail"), clean_relation(F.col("r.relation")).alias("rel_type"), tau.alias("t"), F.coalesce("r.evidence", F.lit("")).alias("evidence"), F.coalesce("r.confidence", F.lit(1.0)).alias("confidence"))
    return out.where((F.col("head") != "") & (F.col("tail") != "")).select("*", "t.*").drop("t")


def lookup(listed: DataFrame) -> DataFrame:
    """id, key and the entity that a name means in its file: of entities with that text or name, case ignored, the last."""
    keys = listed.select("id", "ord", "name", "type", F.explode(F.array_distinct(F.array(F.lower("raw"), F.lower("name")))).alias("key"))
    return keys.where("key <> ''").groupBy("id", "key").agg(F.max_by(F.struct("name", "type"), "ord").alias("m"))


def resolve(rels: DataFrame, listed: DataFrame) -> DataFrame:
    """Relations with head_name, head_type, tail_name and tail_type. Ends that the file doesn't list keep their text, with type Unknown."""
    found = lookup(listed)
    out = rels
    for end in ("head", "tail"):
        m = found.select("id", F.col("key").alias("_key"), F.col("m").alias(f"_{end}"))
        out = out.withColumn("_key", F.lower(end)).join(m, ["id", "_key"], "left").drop("_key")
        out = out.withColumns({f"{end}_name": F.coalesce(f"_{end}.name", end), f"{end}_type": F.coalesce(f"_{end}.type", F.lit(UNKNOWN_TYPE)), f"{end}_missing": F.col(f"_{end}").isNull()}).drop(f"_{end}")
    return out


def warnings(resolved: DataFrame, listed: DataFrame) -> DataFrame:
    """id and message of ends that are not listed and of listed entities of other types."""
    ends = resolved.select("id", F.explode(F.filter(F.array(F.when(F.col("head_missing"), F.col("head")), F.when(F.col("tail_missing"), F.col("tail"))), lambda x: x.isNotNull())).alias("ref"))
    missing = ends.select("id", F.format_string("[%s] Entity reference '%s' not found in entities list. Defaulting type to 'Unknown'.", "id", "ref").alias("message"))
    odd = listed.where(~F.col("type").isin(*ENTITY_TYPES, UNKNOWN_TYPE)).select("id", F.format_string("[%s] Entity '%s' has non-standard type '%s'.", "id", "name", "type").alias("message"))
    return missing.unionByName(odd)


def file_nodes(listed: DataFrame, resolved: DataFrame) -> DataFrame:
    """id, name, type, raw_text (the first one's) and tau (of the first dated relation) of each file's nodes."""
    ends = resolved.select("id", "ord", "tau", F.explode(F.array(*(F.struct(F.col(f"{e}_name").alias("name"), F.col(f"{e}_type").alias("type"), F.col(e).alias("raw")) for e in ("head", "tail")))).alias("n"))
    rows = listed.select("id", "name", "type", "raw", F.struct(F.lit(0).alias("k"), "ord").alias("o"), F.lit(None).cast("timestamp").alias("tau"), F.lit(None).cast("int").alias("dated"))
    rows = rows.unionByName(ends.select("id", "n.name", "n.type", "n.raw", F.struct(F.lit(1).alias("k"), "ord").alias("o"), "tau", F.when(F.col("tau").isNotNull(), F.col("ord")).alias("dated")))
    return rows.groupBy("id", "name", "type").agg(F.min_by("raw", "o").alias("raw_text"), F.min_by("tau", "dated").alias("tau"))


def nodes(per_file: DataFrame) -> DataFrame:
    """Nodes over all files: first raw_text, first and last tau."""
    got = per_file.groupBy(*NODE_KEY).agg(F.min_by("raw_text", "id").alias("raw_text"), F.min("tau").alias("first_seen"), F.max("tau").alias("last_seen"))
    return got.select(*NODE_KEY, "raw_text", F.lit(None).cast("string").alias("canonical_id"), "first_seen", "last_seen")


def edges(resolved: DataFrame, created_at: Column) -> DataFrame:
    """Edges by key: the last one's values. ``source`` is the file."""
    rows = resolved.withColumn("source", F.col("id"))
    return upsert_edges(rows.withColumn("created_at", created_at), F.struct("id", "ord"))


def upsert_edges(rows: DataFrame, order: Column) -> DataFrame:
    """One edge for each key: the last values, the first created_at."""
    # aggregates of structs sort by key: a number in front of it is what they mostly compare
    keyed = rows.withColumn("_k", F.xxhash64(*EDGE_KEY)).groupBy("_k", *EDGE_KEY)
    return keyed.agg(F.max_by(F.struct(*EDGE_VALUES), order).alias("v"), F.min_by("created_at", order).alias("created_at")).select(*EDGE_KEY, "v.*", "created_at")


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old nodes keep raw_text and canonical_id; spans widen."""
    rows = old.select("*", F.lit(0).alias("_g")).unionByName(new.select("*", F.lit(1).alias("_g")))
    return rows.groupBy(*NODE_KEY).agg(F.min_by("raw_text", "_g").alias("raw_text"), F.min_by("canonical_id", F.when(F.col("canonical_id").isNotNull(), F.col("_g"))).alias("canonical_id"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """New values replace old ones; created_at and all other columns of an old edge (its trust) stay."""
    more = [c for c in old.columns if c not in (*EDGE_KEY, *EDGE_VALUES, "created_at")]
    n = new.select(*EDGE_KEY, F.struct(*EDGE_VALUES).alias("_n"), F.col("created_at").alias("_c"))
    both = old.join(n, EDGE_KEY, "full_outer")
    values = [F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) for c in EDGE_VALUES]
    return both.select(*EDGE_KEY, *values, F.coalesce("created_at", "_c").alias("created_at"), *more)


def build(extractions: DataFrame, created_at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and warnings of extractions."""
    listed, rels = entities(extractions), relations(extractions)
    resolved = resolve(rels, listed)
    return nodes(file_nodes(listed, resolved)), edges(resolved, created_at), warnings(resolved, listed)


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def dated(edges_: DataFrame) -> DataFrame:
    """Edges with and without tau."""
    return edges_.groupBy(F.when(F.col("tau").isNull(), "null").otherwise("populated").alias("tau_status")).agg(F.count("*").alias("n"))


def ingest_summary(extractions: DataFrame, nodes_: DataFrame, edges_: DataFrame, warned: DataFrame) -> DataFrame:
    counts = [df.agg(F.count("*").alias(n)) for df, n in ((extractions, "files"), (nodes_, "nodes"), (edges_, "edges"), (warned, "warnings"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(F.broadcast(c))  # one row each
    return out


def unnamed(extractions: DataFrame) -> DataFrame:
    """Listed entities without any name, by file."""
    e = extractions.select("id", F.explode("entities").alias("e"))
    return e.where(blank(F.col("e.text")) & blank(F.col("e.canonical_name"))).groupBy("id").agg(F.count("*").alias("n"))
