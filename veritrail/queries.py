"""Queries over the driver's tables: each feeds one operator through an adapter, with the same result in SQL.

The tables have no feeds, so adapters read a graph into them: suppliers act on kinds
of parts (relation by return flag, source by order), parts are names to align, the
stream of events are indicators. What an adapter does is stated in its SQL too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import time as Time
from .functions import trust as S
from .operators import align, context, extract, graph, retrieve, traverse, trust
from .operators.components import component_roots
from .sources import cves, events
from .store import scratch, stored
from .streaming.upsert import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- the graph of suppliers and parts

EDGES_SQL = """
raw AS (
  SELECT 'Supplier#' || l_suppkey AS head_name, CASE l_returnflag WHEN 'R' THEN 'USES' WHEN 'A' THEN 'HAS_HASH' ELSE 'BELONGS_TO_TACTIC' END AS rel_type,
    p_brand || ' ' || p_type AS tail_name, CASE left(o_orderpriority, 1) WHEN '1' THEN 'CVE-' || o_orderkey WHEN '5' THEN 'feed-' || o_orderkey ELSE concat(year(o_orderdate), '_', o_orderkey) END AS source,
    CASE WHEN l_linenumber <> 6 THEN CAST(l_shipdate AS DATE) END AS tau, CASE WHEN l_linenumber <> 7 THEN 1 - l_discount END AS confidence, 'line ' || l_linenumber AS evidence, l_linenumber, struct_pack(n := l_linenumber, p := l_partkey, s := l_suppkey, d := l_shipdate, c := l_discount) AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
edges AS (
  SELECT head_name, rel_type, tail_name, source, arg_max_null(tau, ord) AS tau, arg_max_null(confidence, ord) AS confidence, arg_max(evidence, ord) AS evidence
  FROM raw GROUP BY ALL)"""

SCORED_SQL = (
    EDGES_SQL
    + """,
stats AS (
  SELECT head_name, rel_type, tail_name, count(DISTINCT source) AS n, coalesce(datediff('day', min(tau), max(tau)) > 365, false) AS contra
  FROM edges GROUP BY ALL),
spans AS (SELECT head_name, min(tau) + 900 AS lo, max(tau) - 1300 AS hi FROM edges GROUP BY head_name),
factors AS (
  SELECT e.*, greatest(0::DOUBLE, least(1::DOUBLE, coalesce(e.confidence, 1))) AS s1,
    CASE WHEN starts_with(source, 'CVE-') THEN 0.9 WHEN starts_with(source, 'feed') THEN 0.5 WHEN rel_type = 'HAS_HASH' THEN 0.65 ELSE 0.8 END::DOUBLE AS s2,
    CASE rel_type WHEN 'HAS_HASH' THEN 0.3 WHEN 'BELONGS_TO_TACTIC' THEN 0.9 ELSE 0.5 END::DOUBLE AS s3,
    CASE WHEN n >= 3 THEN 1 WHEN n = 2 THEN 0.6 ELSE 0.3 END::DOUBLE AS s4,
    CASE WHEN tau IS NULL THEN 0.5 WHEN lo IS NULL THEN 1.0 WHEN tau BETWEEN lo AND hi + 365 THEN 1.0
      WHEN greatest(datediff('day', tau, lo), datediff('day', hi + 365, tau)) <= 180 THEN 0.7 ELSE 0.3 END::DOUBLE AS s5,
    CASE WHEN contra THEN 0.5 ELSE 0 END::DOUBLE AS s6
  FROM edges e JOIN stats USING (head_name, rel_type, tail_name) LEFT JOIN spans USING (head_name)),
sums AS (
  SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, 0.25::DOUBLE * s1 + 0.2::DOUBLE * s2 + 0.15::DOUBLE * s3 + 0.25::DOUBLE * s4 + 0.15::DOUBLE * s5 - 0.05::DOUBLE * s6)) AS x FROM factors),
scored AS (SELECT *, round(x, 4) AS trust, x >= 0.8::DOUBLE AS trusted FROM sums)"""
)


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    rel = F.when(F.col("l_returnflag") == "R", "USES").when(F.col("l_returnflag") == "A", "HAS_HASH").otherwise("BELONGS_TO_TACTIC")
    kind, key = F.left("o_orderpriority", F.lit(1)), F.col("o_orderkey").cast("string")
    source = F.when(kind == "1", F.concat(F.lit("CVE-"), key)).when(kind == "5", F.concat(F.lit("feed-"), key)).otherwise(F.concat_ws("_", F.year("o_orderdate"), key))
    day = F.when(F.col("l_linenumber") != 6, F.to_date("l_shipdate"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return rows.select(
        F.concat(F.lit("Supplier#"), F.col("l_suppkey").cast("string")).alias("head_name"), F.lit("ThreatActor").alias("head_type"), rel.alias("rel_type"),
        F.concat_ws(" ", "p_brand", "p_type").alias("tail_name"), F.lit("Malware").alias("tail_type"), source.alias("source"),
        day.cast("timestamp").alias("tau"), F.coalesce(day.cast("string"), F.lit("unknown")).alias("tau_raw"), F.when(day.isNull(), "unknown").otherwise("day").alias("tau_precision"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("evidence"), F.when(F.col("l_linenumber") != 7, 1 - F.col("l_discount")).alias("confidence"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"), "l_linenumber",
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_discount").alias("ord"),  # lines repeat; this orders all that differ
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.upsert_edges(raw_edges(spark, sf_dir), F.col("ord"))


def kept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored: for what reads them several times."""
    return stored(edges(spark, sf_dir), "edges")


def nodes_of(e: DataFrame, late: int = 0, early: int = 0) -> DataFrame:
    """Nodes of edges, aligned each to itself; spans begin so many days ``late`` and end so many ``early``, so that edges lie outside of them."""
    ends = e.select(F.explode(F.array(*(F.struct(F.col(f"{x}_name").alias("name"), F.col(f"{x}_type").alias("type")) for x in ("head", "tail")))).alias("n"), F.to_date("tau").alias("day"))
    spans = (F.date_add(F.min("day"), late).cast("timestamp").alias("first_seen"), F.date_sub(F.max("day"), early).cast("timestamp").alias("last_seen"))
    return ends.groupBy("n.name", "n.type").agg(*spans).select("name", "type", F.col("name").alias("raw_text"), F.col("name").alias("canonical_id"), "first_seen", "last_seen")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = kept_edges(spark, sf_dir)
    return trust.score_edges(e, nodes_of(e, 900, 1300))


@query(f"WITH {SCORED_SQL} SELECT rel_type, count(*) AS total, count(*) FILTER (WHERE trusted) AS trusted, round(100.0::DOUBLE * count(*) FILTER (WHERE trusted) / count(*), 2) AS trusted_pct, round(avg(trust), 6) AS avg_trust FROM scored GROUP BY rel_type")
def trust_by_rel_type(spark, sf_dir):
    return trust.by_relation(scored(spark, sf_dir))


@query(f"""WITH {SCORED_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE trusted) AS trusted, count(*) FILTER (WHERE NOT trusted) AS untrusted,
  round(100.0::DOUBLE * count(*) FILTER (WHERE trusted) / count(*), 2) AS trusted_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE NOT trusted) / count(*), 2) AS untrusted_pct,
  round(avg(trust), 6) AS mean, min(trust) AS min, max(trust) AS max, round(stddev_pop(trust), 6) AS std, count(*) FILTER (WHERE s6 > 0) AS contradictions FROM scored""")
def trust_summary(spark, sf_dir):
    return trust.run_summary(scored(spark, sf_dir))


@query(f"""WITH {SCORED_SQL} SELECT count(*) AS total, count(trust) AS scored, count(*) FILTER (WHERE trusted) AS trusted, count(*) FILTER (WHERE NOT trusted) AS untrusted,
  round(avg(trust), 6) AS mean, min(trust) AS min, max(trust) AS max, round(stddev_samp(trust), 6) AS std, count(*) FILTER (WHERE s6 > 0) AS contradictions FROM scored""")
def trust_verify(spark, sf_dir):
    return trust.verify_summary(scored(spark, sf_dir))


@query(f"WITH {SCORED_SQL} SELECT head_name, rel_type, tail_name, source, trust, trusted, s1 AS score_llm_confidence, s2 AS score_source_reliability, s3 AS score_attck_similarity, s4 AS score_cross_source, s5 AS score_temporal_consistency, s6 AS score_contradiction_penalty FROM scored")
def trust_edges(spark, sf_dir):
    return scored(spark, sf_dir).select("head_name", "rel_type", "tail_name", "source", "trust", "trusted", *trust.FACTORS)


@query(f"WITH {EDGES_SQL} SELECT head_name, rel_type, tail_name, source, tau, confidence, evidence FROM edges")
def edge_upsert(spark, sf_dir):
    return edges(spark, sf_dir).select("head_name", "rel_type", "tail_name", "source", F.to_date("tau").alias("tau"), "confidence", "evidence")


@query(f"""WITH {EDGES_SQL}, merged AS (SELECT head_name, rel_type, tail_name, source, arg_max_null(confidence, ord) AS confidence, bool_or(l_linenumber = 1) AS was_there FROM raw GROUP BY ALL)
SELECT head_name, rel_type, tail_name, source, confidence, CASE WHEN was_there THEN 0.5::DOUBLE END AS trust, CASE WHEN was_there THEN DATE '2023-01-01' ELSE DATE '2024-01-01' END AS created FROM merged""")
def edge_merge(spark, sf_dir):
    """Lines after the first of each order are merged into a graph of the first lines, whose trust and time of creation stay."""
    rows = raw_edges(spark, sf_dir)
    old = graph.upsert_edges(rows.where("l_linenumber = 1").withColumn("created_at", F.lit("2023-01-01").cast("timestamp")), F.col("ord")).withColumn("trust", F.lit(0.5))
    new = graph.upsert_edges(rows.where("l_linenumber > 1"), F.col("ord"))
    return graph.merge_edges(old, new).select("head_name", "rel_type", "tail_name", "source", "confidence", "trust", F.to_date("created_at").alias("created"))


@query(f"WITH {SCORED_SQL} SELECT head_name AS head_canonical, rel_type, tail_name AS tail_canonical, n AS src_cnt, contra AS contradiction FROM stats")
def triple_stats(spark, sf_dir):
    e = kept_edges(spark, sf_dir)
    return trust.triple_stats(e, nodes_of(e))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN '' WHEN 1 THEN 'CVE-2021-' || l_orderkey WHEN 2 THEN '2018_' || l_orderkey WHEN 3 THEN '2019_' || l_orderkey ELSE 'feed' END AS source,
  CASE l_returnflag WHEN 'R' THEN 'HAS_HASH' WHEN 'A' THEN 'USES' ELSE 'BELONGS_TO_TACTIC' END AS rel, CASE WHEN l_linestatus = 'O' THEN 'Malware' ELSE 'Unknown' END AS head_type FROM lineitem)
SELECT source, rel, head_type, count(*) AS n, CASE WHEN source = '' THEN 0.5 WHEN starts_with(source, 'CVE-') THEN 0.9 WHEN regexp_full_match(source, '[0-9]{4}_[0-9]+') THEN CASE WHEN rel = 'HAS_HASH' THEN 0.65 WHEN head_type = 'Malware' THEN 0.8 ELSE 0.65 END ELSE 0.5 END::DOUBLE AS reliability FROM s GROUP BY ALL""")
def source_reliability(spark, sf_dir):
    n, key = F.col("l_linenumber") % 5, F.col("l_orderkey").cast("string")
    source = F.when(n == 0, "").when(n == 1, F.concat(F.lit("CVE-2021-"), key)).when(n == 2, F.concat(F.lit("2018_"), key)).when(n == 3, F.concat(F.lit("2019_"), key)).otherwise("feed")
    rel = F.when(F.col("l_returnflag") == "R", "HAS_HASH").when(F.col("l_returnflag") == "A", "USES").otherwise("BELONGS_TO_TACTIC")
    rows = table(spark, sf_dir, "lineitem").select(source.alias("source"), rel.alias("rel"), F.when(F.col("l_linestatus") == "O", "Malware").otherwise("Unknown").alias("head_type"))
    counted = rows.groupBy("source", "rel", "head_type").agg(F.count("*").alias("n"))
    return counted.withColumn("reliability", S.source_reliability(F.col("source"), F.col("rel"), F.col("head_type"), F.lit("Unknown")))


@query("""WITH spans AS (SELECT l_suppkey, min(CAST(l_shipdate AS DATE)) + 900 AS lo, max(CAST(l_shipdate AS DATE)) - 1300 AS hi FROM lineitem GROUP BY l_suppkey),
t AS (SELECT l.l_suppkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS tau, CASE WHEN l_linenumber <> 5 THEN lo END AS lo, CASE WHEN l_linenumber = 1 THEN lo ELSE hi END AS hi FROM lineitem l LEFT JOIN spans s ON l.l_suppkey = s.l_suppkey),
c AS (SELECT CASE WHEN tau IS NULL THEN 0.5 WHEN lo IS NULL THEN 1.0 WHEN l_linenumber = 1 THEN CASE WHEN tau = lo THEN 1.0 ELSE 0.5 END WHEN tau BETWEEN lo AND hi + 365 THEN 1.0 WHEN greatest(datediff('day', tau, lo), datediff('day', hi + 365, tau)) <= 180 THEN 0.7 ELSE 0.3 END::DOUBLE AS consistency FROM t)
SELECT consistency, count(*) AS n FROM c GROUP BY consistency""")
def temporal_consistency(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", F.to_date("l_shipdate").alias("d"))
    spans = li.groupBy("l_suppkey").agg(F.date_add(F.min("d"), 900).alias("lo"), F.date_sub(F.max("d"), 1300).alias("hi"))
    n, lo = F.col("l_linenumber"), F.col("lo")
    kind = F.when(n == 1, "IOC").otherwise("ThreatActor")
    factor = S.temporal_consistency(F.when(n != 7, F.col("d")), kind, F.when(n != 5, lo), F.when(n == 1, lo).otherwise(F.col("hi")))
    return li.join(spans, "l_suppkey", "left").select(factor.alias("consistency")).groupBy("consistency").agg(F.count("*").alias("n"))


# -- scalar functions

@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN '2019-02-30' WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%dT10:00') ELSE 'Unknown' END AS raw, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN date_trunc('year', d) WHEN 1 THEN date_trunc('month', d) WHEN 2 THEN d WHEN 4 THEN d END::DATE AS tau, CASE WHEN o_orderkey % 6 = 5 THEN 'unknown' ELSE raw END AS tau_raw, CASE o_orderkey % 6 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' WHEN 4 THEN 'day' ELSE 'unknown' END AS tau_precision FROM r""")
def temporal_parse(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 3, "2019-02-30").when(k == 4, F.date_format("o_orderdate", "yyyy-MM-dd'T10:00'")).otherwise("Unknown")
    t = table(spark, sf_dir, "orders").select("o_orderkey", Time.parse_temporal(raw).alias("t"))
    return t.select("o_orderkey", F.to_date("t.tau").alias("tau"), "t.tau_raw", "t.tau_precision")


@query(r"""WITH r AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN replace(p_type, ' ', '--') WHEN 2 THEN p_size || ' ' || p_type ELSE '__ ' || p_brand || '!' END AS raw FROM part UNION SELECT ' - '),
c AS (SELECT raw, upper(trim(regexp_replace(regexp_replace(raw, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')) AS x FROM r)
SELECT raw, CASE WHEN x = '' THEN 'RELATES_TO' WHEN NOT regexp_matches(x, '^[A-Z]') THEN 'REL_' || x ELSE x END AS rel_type FROM c""")
def rel_clean(spark, sf_dir):
    k = F.col("p_size") % 4
    raw = F.when(k == 0, F.lower("p_type")).when(k == 1, F.replace("p_type", F.lit(" "), F.lit("--"))).when(k == 2, F.concat_ws(" ", "p_size", "p_type")).otherwise(F.concat(F.lit("__ "), F.col("p_brand"), F.lit("!")))
    rows = table(spark, sf_dir, "part").select(raw.alias("raw")).union(spark.createDataFrame([(" - ",)], "raw string")).distinct()
    return rows.withColumn("rel_type", X.clean_relation(F.col("raw")))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_discount, CASE l_linenumber % 4 WHEN 0 THEN concat(l_discount, ' - ', l_tax) WHEN 1 THEN concat(l_discount) WHEN 2 THEN 'high' ELSE concat(l_quantity) END AS k, l_tax, l_quantity FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(0::DOUBLE, least(1::DOUBLE, CASE l_linenumber % 4 WHEN 0 THEN (l_discount + l_tax) / 2 WHEN 1 THEN l_discount WHEN 2 THEN 0.8::DOUBLE ELSE l_quantity END)), 9) AS confidence FROM r""")
def confidence_parse(spark, sf_dir):
    k = F.col("l_linenumber") % 4
    raw = F.when(k == 0, F.concat(F.col("l_discount").cast("string"), F.lit(" - "), F.col("l_tax").cast("string"))).when(k == 1, F.col("l_discount").cast("string")).when(k == 2, "high").otherwise(F.col("l_quantity").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.parse_confidence(raw), 9).alias("confidence"))


@query(r"""WITH r AS (SELECT doc_id, 'text' AS form, text AS t FROM documents UNION ALL SELECT doc_id, 'hash', md5(coalesce(text, '')) FROM documents UNION ALL SELECT doc_id, 'file', lang || doc_id || '.EXE' FROM documents UNION ALL SELECT doc_id, 'address', concat('10.0.0.', doc_id % 256, ' ', lang) FROM documents), s AS (SELECT doc_id, form, string_split_regex(trim(coalesce(t, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \t\n\x0B\f\r]+') AS w FROM r)
SELECT doc_id, form, NOT (len(w) <= 2 AND (regexp_full_match(lower(w[1]), '[a-f0-9]{32,64}') OR regexp_matches(lower(w[1]), '^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') OR regexp_full_match(lower(w[1]), '[a-z0-9_\-\.]+\.(exe|dll|pdf|doc|docx|zip|rar|bin|apk|sh|py|vbs|bat|cab)'))) AS narrative FROM s""")
def narrative_filter(spark, sf_dir):
    """Every document's text, and besides it a bare hash, file name and address made of each."""
    number = F.col("doc_id").cast("string")
    forms = {"text": F.col("text"), "hash": F.md5(F.coalesce("text", F.lit(""))), "file": F.concat("lang", number, F.lit(".EXE")), "address": F.concat(F.lit("10.0.0."), (F.col("doc_id") % 256).cast("string"), F.lit(" "), F.col("lang"))}
    docs = table(spark, sf_dir, "documents")
    judged = [docs.select("doc_id", F.lit(k).alias("form"), X.is_narrative(t).alias("narrative")) for k, t in forms.items()]
    return reduce(DataFrame.unionByName, judged)


@query(r"""WITH s AS (SELECT doc_id, trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE floor(len(string_split_regex(t, '[ \t\n\x0B\f\r]+')) * 1.3::DOUBLE)::INT END AS tokens FROM s""")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_count(F.col("text")).alias("tokens"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(url, '')) , '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM (SELECT page_id AS doc_id, url FROM pages)""")
def name_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), X.normalize_name(F.col("url")).alias("norm"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN '' ELSE trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS said FROM conversations")
def think_strip(spark, sf_dir):
    k, t = F.col("turn") % 3, F.coalesce("text", F.lit(""))
    raw = F.when(k == 0, F.concat(F.lit("<think>so\n"), t, F.lit("</THINK>"), t)).when(k == 1, F.concat(t, F.lit("\n<think>left open "), t)).otherwise(F.concat(F.lit("<Think>"), t))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.strip_think(raw).alias("said"))


@query("""SELECT p_partkey, concat('part ', p_partkey) AS head, p_brand AS tail, CASE p_partkey % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.9 WHEN 2 THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence FROM part WHERE p_partkey % 5 <> 4""")
def json_repair(spark, sf_dir):
    """Answers with a range, a quoted pair, a missing and a spare comma, bare, fenced or within words; some are no JSON."""
    k, f = F.col("p_partkey") % 4, F.col("p_partkey") % 5
    conf = F.when(k == 0, '"confidence": 0.7-0.8').when(k == 1, '"confidence: 0.9"').when(k == 2, '"confidence": 0.6,').otherwise('"confidence": 0.5')
    body = F.concat(F.lit('{"relations": [{"head": "part '), F.col("p_partkey").cast("string"), F.lit('"\n"tail": "'), F.col("p_brand"), F.lit('", "relation": "made by", '), conf, F.lit("}]}"))
    raw = F.when(f == 0, F.concat(F.lit("<think>{}</think>"), body)).when(f == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone."))).when(f == 4, F.lit("no idea")).otherwise(F.concat(F.lit("It is "), body, F.lit(" I think.")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit("2024-01-01").cast("date").alias("date"), raw.alias("raw_response"))
    got = extract.parse_responses(rows).select(F.col("id").cast("long").alias("p_partkey"), F.explode("relations").alias("r"))
    return got.select("p_partkey", "r.head", "r.tail", F.round("r.confidence", 6).alias("confidence"))


# -- records and facts

@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '  ' ELSE 'CVE-2024-' || p_partkey END AS cve_id, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS description FROM part),
m AS (SELECT CASE WHEN trim(cve_id) = '' THEN 'Missing or empty cve_id' WHEN trim(description) = '' THEN 'Missing or empty description for CVE ' || cve_id END AS reason FROM r)
SELECT reason, count(*) AS n FROM m WHERE reason IS NOT NULL GROUP BY reason""")
def rejections(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 10 == 0, "  ").otherwise(F.concat(F.lit("CVE-2024-"), F.col("p_partkey").cast("string"))).alias("cve_id"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_name")).alias("description"))
    return cves.validate_cves(rows)[1].groupBy("reason").agg(F.count("*").alias("n"))


EVENT_SQL = """ev AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'url' WHEN 'view' THEN 'Domain' WHEN 'error' THEN 'md5' WHEN 'purchase' THEN 'filename' ELSE 'comment' END AS kind,
  json_extract_string(props, '$.k') AS value, event_type FROM events)"""


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "url").when(F.col("event_type") == "view", "Domain").when(F.col("event_type") == "error", "md5").when(F.col("event_type") == "purchase", "filename").otherwise("comment")
    note = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("seen "), F.col("event_id").cast("string"))).otherwise("")
    ioc = F.struct(F.lit("Other").alias("category"), kind.alias("type"), F.get_json_object("props", "$.k").alias("value"), note.alias("comment"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", ioc.alias("ioc"))


@query(f"""WITH {EVENT_SQL}, k AS (SELECT user_id, lower(kind) AS t, trim(value) AS v, min(event_id) AS first, min(event_id) FILTER (WHERE event_id % 3 = 0) AS noted FROM ev GROUP BY ALL)
SELECT user_id, t AS kind, v AS value, row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS pos, CASE WHEN noted IS NULL THEN '' ELSE 'seen ' || noted END AS comment FROM k""")
def ioc_dedup(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    got = events.dedup_iocs(rows, ["user_id"], F.col("event_id"))
    return got.select("user_id", F.posexplode("iocs").alias("pos", "i")).select("user_id", F.lower("i.type").alias("kind"), F.trim("i.value").alias("value"), F.col("pos").cast("long").alias("pos"), "i.comment")


@query(f"""WITH {EVENT_SQL}, k AS (SELECT user_id, lower(kind) AS t, trim(value) AS v, arg_min(kind, event_id) AS kind FROM ev GROUP BY ALL)
SELECT '2024_' || user_id AS id, 'Event_2024_' || user_id AS head, CASE t WHEN 'url' THEN 'uses_domain' WHEN 'domain' THEN 'uses_domain' WHEN 'md5' THEN 'has_hash' ELSE 'drops_file' END AS relation, v AS tail, '2024-01-31' AS time,
  'IOC of type ' || kind || ' found in event 2024_' || user_id AS evidence FROM k WHERE t <> 'comment'""")
def ioc_extract(spark, sf_dir):
    iocs = events.dedup_iocs(event_rows(spark, sf_dir), ["user_id"], F.col("event_id"))
    rows = iocs.select(F.concat(F.lit("2024_"), F.col("user_id").cast("string")).alias("id"), F.lit("2024-01-31").cast("date").alias("date"), F.lit(" ").alias("info_title"), "iocs")
    return extract.extract_iocs(rows).select("id", F.explode("relations").alias("r")).select("id", "r.head", "r.relation", "r.tail", "r.time", "r.evidence")


@query(f"""WITH {EVENT_SQL}, f AS (SELECT user_id, list(struct_pack(title := CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN event_type WHEN 2 THEN event_type || ' ' || value ELSE event_type || '_' || event_id END, date := CASE WHEN event_id % 5 = 0 THEN DATE '1970-01-01' ELSE CAST(ts AS DATE) END) ORDER BY lpad(event_id::VARCHAR, 12, '0')) AS l FROM ev GROUP BY user_id),
r AS (SELECT user_id, list_reduce(l, lambda a, x: CASE WHEN trim(x.title) <> '' AND (trim(a.title) = '' OR length(x.title) > length(a.title) OR (contains(x.title, ' ') AND NOT contains(a.title, ' '))) THEN struct_pack(title := x.title, date := CASE WHEN x.date <> DATE '1970-01-01' THEN x.date ELSE a.date END) ELSE a END) AS m FROM f)
SELECT '2024_' || user_id AS id, m.title AS info_title, m.date AS date, files FROM r JOIN (SELECT user_id, string_agg(DISTINCT lpad(event_id::VARCHAR, 12, '0'), ',' ORDER BY lpad(event_id::VARCHAR, 12, '0')) AS files FROM ev GROUP BY user_id) USING (user_id)""")
def title_fold(spark, sf_dir):
    """Events of one user are one record in many files, with titles of all kinds."""
    k = F.col("event_id") % 4
    title = F.when(k == 0, "").when(k == 1, F.col("event_type")).when(k == 2, F.concat_ws(" ", "event_type", "ioc.value")).otherwise(F.concat_ws("_", "event_type", "event_id"))
    rows = event_rows(spark, sf_dir).select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("file"), F.lit(2024).alias("year"), F.col("user_id").alias("event_id"),
        F.when(F.col("event_id") % 5 == 0, F.lit("1970-01-01").cast("date")).otherwise(F.to_date("ts")).alias("date"), title.alias("info_title"), F.array("ioc").alias("iocs"),
    )
    return events.merge_events(rows).select("id", "info_title", "date", F.array_join("source_files", ",").alias("files"))


RESOLVE_SQL = """raws AS (SELECT concat(year(o_orderdate), '_', o_orderkey) AS id, l_linenumber AS n, 'p' || l_partkey AS tail, CASE l_linenumber WHEN 2 THEN '{''text'': ''P' || l_partkey || '''}' WHEN 3 THEN ' ' ELSE 'P' || l_partkey END AS said,
  CASE WHEN p_size % 2 = 0 THEN 'Malware' ELSE 'Tool' END AS type, CASE WHEN l_linenumber = 3 THEN '' ELSE p_brand || ' ' || p_type END AS canonical, CASE WHEN l_linenumber = 5 THEN '  ' ELSE 'Supplier#' || l_suppkey END AS head,
  CASE WHEN l_linenumber = 4 THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS time FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
li AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n, said, type, canonical, head, tail, time) - 1 AS ord, upper(tail) AS raw, CASE WHEN time <> 'unknown' THEN time::DATE END AS tau FROM raws),
ents AS (SELECT id, ord, raw, canonical AS name, type FROM li WHERE n <> 3), keys AS (SELECT id, ord, name, type, unnest([lower(raw), lower(name)]) AS key FROM ents), m AS (SELECT id, key, arg_max(struct_pack(name := name, type := type), ord) AS e FROM keys GROUP BY id, key),
rels AS (SELECT li.id, li.ord, li.n, head, tail, tau, coalesce(m.e.name, tail) AS tail_name, coalesce(m.e.type, 'Unknown') AS tail_type, m.e IS NULL AS tail_missing FROM li LEFT JOIN m ON li.id = m.id AND m.key = tail WHERE n <> 5),
files AS (SELECT id, name, type, arg_min(raw, o) AS raw_text, arg_min(tau, o) FILTER (WHERE tau IS NOT NULL) AS tau FROM (SELECT id, name, type, raw, struct_pack(k := 0, o := ord) AS o, NULL::DATE AS tau FROM ents
  UNION ALL SELECT id, head, 'Unknown', head, struct_pack(k := 1, o := ord), tau FROM rels UNION ALL SELECT id, tail_name, tail_type, tail, struct_pack(k := 1, o := ord), tau FROM rels) GROUP BY id, name, type)"""


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extraction for each order: its parts are listed, its suppliers are only named in relations. Some texts are dicts' reprs, some names and ends are blank, some times and confidences missing."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    n, raw = F.col("l_linenumber"), F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    text = F.when(n == 2, F.concat(F.lit("{'text': '"), raw, F.lit("'}"))).when(n == 3, " ").otherwise(raw)
    kind = F.when(F.col("p_size") % 2 == 0, "Malware").otherwise("Tool")
    entity = F.struct(text.alias("text"), kind.alias("type"), F.when(n == 3, "").otherwise(F.concat_ws(" ", "p_brand", "p_type")).alias("canonical_name"), F.lit(0.9).alias("confidence"))
    head = F.when(n == 5, "  ").otherwise(F.concat(F.lit("Supplier#"), F.col("l_suppkey").cast("string")))
    time = F.when(n == 4, "unknown").otherwise(F.to_date("l_shipdate").cast("string"))
    relation = F.struct(head.alias("head"), F.lit("drops-file").alias("relation"), F.lower(raw).alias("tail"), time.alias("time"), F.lit("").alias("evidence"), F.when(n != 6, 0.9).alias("confidence"))
    got = rows.groupBy(F.concat_ws("_", F.year("o_orderdate"), "o_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", entity.alias("e"), relation.alias("r")))).alias("x"))
    return got.select("id", F.transform("x", lambda v: v.e).alias("entities"), F.transform("x", lambda v: v.r).alias("relations"))


def resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Listed entities, and relations with their ends."""
    x = extractions(spark, sf_dir)
    listed = graph.entities(x)
    return listed, graph.resolve(graph.relations(x), listed)


@query(f"WITH {RESOLVE_SQL} SELECT id, ord, head AS head_name, 'Unknown' AS head_type, tail_name, tail_type, true AS head_missing, tail_missing, CASE WHEN n = 6 THEN 1 ELSE 0.9 END::DOUBLE AS confidence FROM rels")
def resolve_endpoints(spark, sf_dir):
    return resolved(spark, sf_dir)[1].select("id", F.col("ord").cast("long").alias("ord"), "head_name", "head_type", "tail_name", "tail_type", "head_missing", "tail_missing", "confidence")


@query(f"WITH {RESOLVE_SQL}, refs AS (SELECT id, head AS ref FROM rels UNION ALL SELECT id, tail FROM rels WHERE tail_missing) SELECT id, '[' || id || '] Entity reference ''' || ref || ''' not found in entities list. Defaulting type to ''Unknown''.' AS message FROM refs")
def resolve_warnings(spark, sf_dir):
    listed, ends = resolved(spark, sf_dir)
    return graph.warnings(ends, listed)


@query(f"WITH {RESOLVE_SQL} SELECT id, name, type, raw_text, tau FROM files")
def file_nodes(spark, sf_dir):
    return graph.file_nodes(*resolved(spark, sf_dir)).select("id", "name", "type", "raw_text", F.to_date("tau").alias("tau"))


@query(f"WITH {RESOLVE_SQL} SELECT name, type, arg_min(raw_text, id) AS raw_text, min(tau) AS first_seen, max(tau) AS last_seen FROM files GROUP BY ALL")
def node_upsert(spark, sf_dir):
    got = graph.nodes(graph.file_nodes(*resolved(spark, sf_dir)))
    return got.select("name", "type", "raw_text", F.to_date("first_seen").alias("first_seen"), F.to_date("last_seen").alias("last_seen"))


@query(f"""WITH {RESOLVE_SQL}, edges AS (SELECT DISTINCT id, head, tail_name, tail_type FROM rels), warned AS (SELECT count(*) + count(*) FILTER (WHERE tail_missing) AS n FROM rels)
SELECT (SELECT count(DISTINCT id) FROM li) AS files, (SELECT count(DISTINCT (name, type)) FROM files) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT n FROM warned) AS warnings, (SELECT count(*) FROM li) AS entities, (SELECT count(*) FROM li) AS relations""")
def ingest_stats(spark, sf_dir):
    x = stored(extractions(spark, sf_dir), "extractions")
    nodes, made, warned = graph.build(x, F.lit("2024-01-01").cast("timestamp"))
    return graph.ingest_summary(x, nodes, made, warned).join(F.broadcast(extract.summary(x).select("entities", "relations")))  # one row each


@query(f"WITH {EDGES_SQL} SELECT CASE WHEN tau IS NULL THEN 'null' ELSE 'populated' END AS tau_status, count(*) AS n FROM edges GROUP BY ALL")
def tau_distribution(spark, sf_dir):
    return graph.dated(edges(spark, sf_dir))


@query(f"WITH {EDGES_SQL} SELECT rel_type, count(*) AS n FROM edges GROUP BY rel_type")
def edge_counts(spark, sf_dir):
    return graph.count_by(edges(spark, sf_dir), "rel_type")


@query(f"WITH {EDGES_SQL}, ends AS (SELECT head_name AS name, 'ThreatActor' AS type FROM edges UNION SELECT tail_name, 'Malware' FROM edges) SELECT type, count(*) AS n FROM ends GROUP BY type")
def node_counts(spark, sf_dir):
    return graph.count_by(nodes_of(edges(spark, sf_dir)), "type")


@query("SELECT round(1 - l_discount, 2) AS confidence, count(*) AS n FROM lineitem GROUP BY ALL")
def confidence_histogram(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    one = li.select(F.array(F.struct((1 - F.col("l_discount")).alias("confidence"))).alias("relations"))
    return extract.confidence_histogram(one)


# -- alignment of part names

NAMES_SQL = r"""named AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lower(p_type) || ' ' || p_brand WHEN 1 THEN p_type || '-' || p_brand ELSE p_type || ' ' || p_brand END AS name, CASE WHEN p_size % 2 = 0 THEN 'Malware' ELSE 'Tool' END AS type FROM part),
sold AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey),
names AS (SELECT name, type, sum(coalesce(n, 0))::BIGINT AS degree FROM named LEFT JOIN sold ON p_partkey = l_partkey GROUP BY ALL),
groups AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM names),
reps AS (SELECT type, norm, arg_min(name, struct_pack(d := -degree, n := name)) AS rep, count(*) AS members FROM groups GROUP BY ALL),
aligned AS (SELECT g.name, g.type, g.degree, r.rep AS canonical_id, r.members FROM groups g JOIN reps r USING (type, norm))"""


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    name = F.concat(F.when(k == 0, F.lower("p_type")).otherwise(F.col("p_type")), F.when(k == 1, "-").otherwise(" "), F.col("p_brand"))
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.when(F.col("p_size") % 2 == 0, "Malware").otherwise("Tool").alias("type")).join(sold, "p_partkey", "left")
    return rows.groupBy("name", "type").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("degree"))


def aligned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.exact_groups(part_names(spark, sf_dir)).withColumnRenamed("rep", "canonical_id")


@query(f"WITH {NAMES_SQL} SELECT name, type, canonical_id AS rep, members FROM aligned")
def exact_groups(spark, sf_dir):
    return align.exact_groups(part_names(spark, sf_dir)).select("name", "type", "rep", "members")


@query(f"WITH {NAMES_SQL} SELECT type, canonical_id, count(*) AS size, sum(degree)::BIGINT AS degree FROM aligned GROUP BY ALL")
def canonical_pick(spark, sf_dir):
    return aligned_names(spark, sf_dir).groupBy("type", "canonical_id").agg(F.count("*").alias("size"), F.sum("degree").alias("degree"))


@query(f"WITH {NAMES_SQL} SELECT type, count(*) AS total, count(DISTINCT canonical_id) AS canonical, count(*) - count(DISTINCT canonical_id) AS merged FROM aligned GROUP BY type")
def align_by_type(spark, sf_dir):
    return align.by_type(aligned_names(spark, sf_dir))


@query(f"WITH {NAMES_SQL} SELECT count(*) AS nodes, count(DISTINCT canonical_id) AS canonical, round(100.0::DOUBLE * (count(*) - count(DISTINCT canonical_id)) / count(*), 2) AS compression_pct FROM aligned")
def align_global(spark, sf_dir):
    return align.global_counts(aligned_names(spark, sf_dir))


@query(f"WITH {NAMES_SQL} SELECT type, canonical_id, count(*) AS size, array_to_string(list_sort(list(name)), '; ') AS names FROM aligned GROUP BY ALL HAVING count(*) > 1 ORDER BY size DESC, canonical_id, type LIMIT 20")
def top_clusters(spark, sf_dir):
    return align.top_clusters(aligned_names(spark, sf_dir)).withColumn("names", F.array_join("names", "; "))


@query(f"WITH {EDGES_SQL}, ends AS (SELECT head_name AS name, 'ThreatActor' AS type FROM edges UNION ALL SELECT tail_name, 'Malware' FROM edges) SELECT name, type, count(*) AS degree FROM ends GROUP BY ALL")
def node_degree(spark, sf_dir):
    e = kept_edges(spark, sf_dir)
    return align.degrees(nodes_of(e), e).select("name", "type", "degree")


KNN_SQL = """v AS (SELECT vec_id AS i, label::VARCHAR AS type, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.type, a.i, b.i AS j, list_inner_product(a.e, b.e) AS sim FROM v a JOIN v b ON a.type = b.type AND a.i <> b.i),
r AS (SELECT *, row_number() OVER (PARTITION BY type, i ORDER BY sim DESC, j) AS k FROM p),
near AS (SELECT type, i, j, sim FROM r WHERE k <= 49 AND j > i AND sim >= 0.3::DOUBLE)"""


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("type"), F.col("vec_id").alias("i"), "embedding")
    return align.similar_pairs(v, 50, 0.3)


@query(f"WITH {KNN_SQL} SELECT type, i, j, round(sim, 6) AS sim FROM near")
def knn_self(spark, sf_dir):
    return near_vectors(spark, sf_dir).withColumn("sim", F.round("sim", 6))


@query(f"WITH RECURSIVE {KNN_SQL}, u AS (SELECT i AS a, j AS b FROM near UNION ALL SELECT j, i FROM near), c(a, b) AS (SELECT a, b FROM u UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a), m AS (SELECT a, min(b) AS lo FROM c GROUP BY a) SELECT i AS rep, least(i, coalesce(lo, i)) AS component FROM v LEFT JOIN m ON i = a")
def components(spark, sf_dir):
    links = near_vectors(spark, sf_dir).select(F.col("i").alias("a"), F.col("j").alias("b"))
    roots = component_roots(links, scratch(spark, "components"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rep")).join(roots, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))


@query("""WITH q AS (SELECT vec_id AS ask, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), t AS (SELECT ask, vec_id, label::VARCHAR AS type, 'C' || (vec_id % 50) AS canonical_id, list_inner_product(embedding::DOUBLE[], q.e) AS sim FROM embeddings, q QUALIFY row_number() OVER (PARTITION BY ask ORDER BY sim DESC, vec_id) <= 20)
SELECT ask, vec_id, type, canonical_id, round(sim, 4) AS similarity FROM t QUALIFY row_number() OVER (PARTITION BY ask, type, canonical_id ORDER BY sim DESC, vec_id) = 1""")
def knn_query(spark, sf_dir):
    """Every hundredth row asks; all rows are searched."""
    v = table(spark, sf_dir, "embeddings")
    asks = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("ask"), "embedding")
    rows = v.select("vec_id", F.col("label").cast("string").alias("type"), F.concat(F.lit("C"), (F.col("vec_id") % 50).cast("string")).alias("canonical_id"), "embedding")
    return retrieve.nearest_each(rows, asks, 20, "vec_id")


@query("""WITH s AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS lo, min(CAST(o_orderdate AS DATE)) + (o_custkey % 60)::INT AS hi FROM orders GROUP BY o_custkey), n AS (SELECT c_custkey, lo, hi FROM customer LEFT JOIN s ON c_custkey = o_custkey),
p AS (SELECT a.c_custkey AS a, b.c_custkey AS b, a.lo AS fa, b.lo AS fb, greatest(datediff('day', a.hi, b.lo), datediff('day', b.hi, a.lo)) AS gap FROM n a JOIN n b ON b.c_custkey = a.c_custkey + 1)
SELECT a, b, fa IS NULL OR fb IS NULL OR gap <= 100 AS ok, CASE WHEN fa IS NULL OR fb IS NULL THEN 'No timeline constraint (missing dates)' WHEN gap > 100 THEN concat('Temporal gap of ', gap, ' days exceeds limit (100 days)') ELSE 'Temporal overlap/gap within 730 days' END AS reason FROM p""")
def temporal_overlap(spark, sf_dir):
    """Spans begin with a customer's first order and last a number of days by its key."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.to_date("o_orderdate")).alias("lo"))
    s = first.withColumn("hi", F.expr("date_add(lo, CAST(c_custkey % 60 AS INT))"))
    n = table(spark, sf_dir, "customer").select("c_custkey").join(s, "c_custkey", "left")
    a, b = n.toDF("a", "fa", "la"), n.toDF("b", "fb", "lb")
    both = a.join(b, F.col("b") == F.col("a") + 1)
    t = Time.overlap(F.col("fa"), F.col("la"), F.col("fb"), F.col("lb"), 100)
    return both.select("a", "b", t.alias("t")).select("a", "b", "t.ok", "t.reason")


# -- paths from a supplier

def _level(n: int) -> str:
    extend = f"SELECT p.start, s.dst, list_append(p.eids, s.eid), list_append(p.hops, s.hop), p.path_trust * s.trust, {n} FROM l{n - 1} p JOIN steps s ON s.src = p.dst WHERE p.length = {n - 1} AND NOT list_contains(p.eids, s.eid) AND p.path_trust * s.trust > 0"
    return f"l{n} AS (SELECT * FROM (SELECT * FROM l{n - 1} UNION ALL {extend}) ORDER BY path_trust DESC, length, eids, start LIMIT 100)"


PATHS_SQL = (
    EDGES_SQL
    + """,
scored AS (SELECT *, confidence AS trust, confidence >= 0.95::DOUBLE AS trusted FROM edges WHERE confidence IS NOT NULL),
e AS (SELECT head_name || '::ThreatActor::' || rel_type || '::' || tail_name || '::Malware::' || source AS eid, * FROM scored),
steps AS (SELECT head_name AS src, tail_name AS dst, eid, trust, struct_pack(a := head_name, ht := 'ThreatActor', r := rel_type, b := tail_name, tt := 'Malware', d := tau, ev := evidence, trust := trust, trusted := trusted, source := source, conf := confidence) AS hop FROM e
  UNION ALL SELECT tail_name, head_name, eid, trust, struct_pack(a := tail_name, ht := 'Malware', r := rel_type, b := head_name, tt := 'ThreatActor', d := tau, ev := evidence, trust := trust, trusted := trusted, source := source, conf := confidence) FROM e),
l1 AS (SELECT src AS start, dst, [eid] AS eids, [hop] AS hops, trust AS path_trust, 1 AS length FROM steps WHERE src = 'Supplier#1' AND trust > 0 ORDER BY path_trust DESC, length, eids, start LIMIT 100),
"""
    + ",\n".join(_level(n) for n in (2, 3, 4))
    + ", ranked AS (SELECT *, row_number() OVER (ORDER BY path_trust DESC, length, eids, start) AS rank FROM l4)"
)

FACTS_SQL = (
    PATHS_SQL
    + """,
h AS (SELECT rank, unnest(range(len(hops))) AS pos, unnest(hops) AS x FROM ranked),
f AS (SELECT rank, pos, x.*, concat_ws('::', x.a, x.r, x.b, x.source) AS fact_key FROM h QUALIFY row_number() OVER (PARTITION BY concat_ws('::', x.a, x.r, x.b, x.source) ORDER BY rank, pos) = 1),
facts AS (SELECT *, CASE r WHEN 'BELONGS_TO_TACTIC' THEN 2 WHEN 'USES' THEN 3 ELSE 6 END AS priority, row_number() OVER (ORDER BY CASE r WHEN 'BELONGS_TO_TACTIC' THEN 2 WHEN 'USES' THEN 3 ELSE 6 END, trust DESC, d DESC NULLS LAST, rank, pos) AS fact_rank FROM f)"""
)


def supplier_paths(spark: SparkSession, sf_dir: str, seeds: tuple[str, ...] = ("Supplier#1",)) -> DataFrame:
    """Confidence stands in for trust: some edges have all of it, so that longer paths rank high too, some have none. Edges and steps are stored: each hop joins them again."""
    e = edges(spark, sf_dir).withColumns({"trust": F.col("confidence"), "trusted": F.col("confidence") >= 0.95})
    e = stored(e, "edges", scratch(spark, "paths"))
    steps = stored(traverse.walkable(e, nodes_of(e)), "steps", scratch(spark, "paths"))
    return traverse.ranked_paths(traverse.best_paths(steps, spark.createDataFrame([(s,) for s in seeds], "canonical_id string"), 4, 100))


@query(f"WITH {PATHS_SQL} SELECT rank, start, array_to_string(eids, ' / ') AS eids, length, round(path_trust, 9) AS path_trust FROM ranked")
def paths_topk(spark, sf_dir):
    return supplier_paths(spark, sf_dir).select("rank", F.col("start.name").alias("start"), F.array_join("eids", " / ").alias("eids"), "length", F.round("path_trust", 9).alias("path_trust"))


@query(f"WITH {PATHS_SQL}, t AS (SELECT *, list_filter([x.d for x in hops], lambda d: d IS NOT NULL) AS ds FROM ranked) SELECT rank, len(hops)::INT AS length FROM t WHERE len(hops) >= 2 AND len(ds) >= 2 AND ds = list_sort(ds)")
def chronological_paths(spark, sf_dir):
    return supplier_paths(spark, sf_dir).where(traverse.chronological(F.col("hops"))).select("rank", "length")


@query(f"WITH {PATHS_SQL}, t AS (SELECT *, list_filter([x.d for x in hops], lambda d: d IS NOT NULL) AS ds FROM ranked), c AS (SELECT rank, 'temporal_causal' AS chain_type, 0 AS k FROM t WHERE len(hops) >= 2 AND len(ds) >= 2 AND ds = list_sort(ds) ORDER BY rank LIMIT 5), s AS (SELECT rank, 'structural' AS chain_type, 1 AS k FROM ranked ORDER BY rank LIMIT 5), u AS (SELECT * FROM c UNION ALL SELECT * FROM s) SELECT row_number() OVER (ORDER BY k, rank) AS position, chain_type, rank FROM u ORDER BY k, rank LIMIT 5")
def chain_pick(spark, sf_dir):
    return traverse.chains(supplier_paths(spark, sf_dir)).select("position", "chain_type", "rank")


@query(f"WITH {FACTS_SQL} SELECT fact_rank, fact_key, priority, trust, d AS tau_date FROM facts")
def fact_rank(spark, sf_dir):
    return traverse.facts(supplier_paths(spark, sf_dir)).select("fact_rank", "fact_key", "priority", "trust", "tau_date")


@query(f"""WITH {FACTS_SQL}, l AS (SELECT *, '- (' || ht || ': ' || a || ') ' || r || ' (' || tt || ': ' || b || ') [Trust=' || printf('%.2f', trust) || ', Conf=' || printf('%.2f', conf) || ', Source=' || source || ', Trusted=' || CASE WHEN trusted THEN 'YES' ELSE 'NO' END || ']' AS line FROM facts)
SELECT row_number() OVER w AS place, line, sum(len(string_split_regex(trim(line), '\\s+'))) OVER w::BIGINT AS words, floor((sum(len(string_split_regex(trim(line), '\\s+'))) OVER w + 4) * 1.3::DOUBLE) <= 512 AS fits FROM l WINDOW w AS (ORDER BY NOT trusted, fact_rank ROWS UNBOUNDED PRECEDING)""")
def context_budget(spark, sf_dir):
    facts = traverse.facts(supplier_paths(spark, sf_dir))
    return context.budgeted_facts(facts, "=== RETRIEVED GRAPH CONTEXT", 512).select("place", "line", "words", "fits")


@query("""SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS "end", event_type, count(*) AS n FROM events GROUP BY ALL""")
def window_counts(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")


@query("SELECT count(*) AS n, 1 - max(l_discount) AS lowest, 1 - min(l_discount) AS highest, round(avg(1 - l_discount), 6) AS mean FROM lineitem")
def confidence_summary(spark, sf_dir):
    return extract.confidence_summary(table(spark, sf_dir, "lineitem").select(F.array(F.struct((1 - F.col("l_discount")).alias("confidence"))).alias("relations")))


@query()
def fuzzy_terms(spark, sf_dir):
    """Part types against the tactics; ratios have no SQL form, tests hold them against the standard library."""
    from .config import TACTICS

    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("name")).union(spark.createDataFrame([("Initial Acces",), ("execution",)], "name string"))
    return trust.match_terms(names, list(TACTICS.values()))
