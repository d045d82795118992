"""More queries over the driver's tables: feeds and files made of their rows, models that answer from a rule, stored graphs."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ALIGNABLE_TYPES, ALIASES, TACTICS, AlignConfig, RetrievalConfig
from .functions import time as Time
from .functions.vector import unit
from .operators import align, context, extract, graph, retrieve, traverse, trust
from .plans.jobs import answer, event_facts
from .queries import EDGES_SQL, FACTS_SQL, NAMES_SQL, RESOLVE_SQL, SCORED_SQL, event_rows, extractions, kept_edges, nodes_of, part_names, query, supplier_paths, table
from .schemas import CVE_JSON, EXTRACTION
from .sources import cves, events, models, tables
from .sources import taxonomy as terms
from .store import scratch, stored

# -- event reports in XML: a file for each user, an event for each of their rows

FILES_SQL = """ev AS (SELECT *, event_id % 40 AS number, json_extract_string(props, '$.k') AS k, event_id % 3 AS form, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events WHERE user_id % 10 <> 9),
named AS (SELECT *, CASE user_id % 3 WHEN 0 THEN concat('feed_', 2000 + user_id % 25, '_', lpad(user_id::VARCHAR, 12, '0'), '.xml') ELSE concat('feed_', translate(user_id::VARCHAR, '0123456789', 'abcdefghij'), '.xml') END AS file, CASE user_id % 3 WHEN 0 THEN 2000 + user_id % 25 ELSE 1970 END::INT AS year FROM ev),
kept AS (SELECT * FROM named WHERE number <> 39 QUALIFY row_number() OVER (PARTITION BY file, number ORDER BY place DESC) = 1),
told AS (SELECT file, year, number AS event_id, CASE WHEN event_id % 7 = 0 THEN DATE '1970-01-01' ELSE ts::DATE END AS date, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type || ' <' || k || '>' END AS info_title,
  CASE form WHEN 0 THEN [struct_pack(t := 'md5', v := k, c := 'Other'), struct_pack(t := 'other', v := event_type, c := 'Net')] WHEN 1 THEN [struct_pack(t := 'url', v := k, c := 'Other')] ELSE [] END AS iocs FROM kept)"""


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file and content. Some names have a year, others the user in letters. Ids repeat within a file, some are no numbers; dates, titles and values are missing in some; every tenth file ends in the middle."""
    e = table(spark, sf_dir, "events")
    k, n, user = F.get_json_object("props", "$.k"), F.col("event_id"), F.col("user_id")
    number = F.when(n % 40 == 39, "none").otherwise((n % 40).cast("string"))
    day = F.when(n % 7 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    title = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("\n "), "event_type", F.lit(" &lt;"), k, F.lit("&gt; ")))
    nested = F.concat(F.lit("<Attribute><type>x</type><value>outer</value><item><type>md5</type><value> "), k, F.lit("</value></item><item><category>Net</category><value>"), F.col("event_type"), F.lit("</value></item></Attribute>"))
    plain = F.concat(F.lit("<Attribute><category/><type>url</type><value>"), k, F.lit("</value><comment/></Attribute>"))
    empty = F.lit("<Attribute><type>url</type><value> </value></Attribute><Wrap><Event><id>1</id></Event></Wrap>")
    own = F.concat(F.lit("<Event><id> "), number, F.lit("</id><date>"), day, F.lit("</date><info>"), title, F.lit("</info>"), F.when(n % 3 == 0, nested).when(n % 3 == 1, plain).otherwise(empty), F.lit("</Event>"))
    whole = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", own.alias("x")))), lambda v: v.x), "").alias("x"))
    name = F.when(user % 3 == 0, F.concat(F.lit("feed_"), (2000 + user % 25).cast("string"), F.lit("_"), F.lpad(user.cast("string"), 12, "0"))).otherwise(F.concat(F.lit("feed_"), F.translate(user.cast("string"), "0123456789", "abcdefghij")))
    return whole.select(F.concat(name, F.lit(".xml")).alias("file"), F.encode(F.concat(F.lit("<Set>"), "x", F.when(user % 10 == 9, "<Event>").otherwise("</Set>")), "utf-8").alias("content"))


@query(f"WITH {FILES_SQL} SELECT file, year, event_id, date, info_title, array_to_string(list_transform(iocs, lambda i: i.c || '/' || i.t || '/' || i.v), ';') AS iocs FROM told")
def event_scan(spark, sf_dir):
    """XML with escapes, nested items, repeated and missing ids, bad dates, events below others and files that end in the middle."""
    got = events.scanned_events(events.parse_files(event_files(spark, sf_dir)))
    line = F.array_join(F.transform("iocs", lambda i: F.concat_ws("/", i.category, i.type, i.value)), ";")
    return got.select("file", "year", "event_id", "date", "info_title", line.alias("iocs"))


@query(f"""WITH {FILES_SQL}, ids AS (SELECT DISTINCT year, event_id FROM told), best AS (SELECT year, event_id, string_agg(file, ',' ORDER BY file) AS files FROM told GROUP BY ALL),
n AS (SELECT year, event_id, count(DISTINCT (lower(i.t), i.v)) AS n FROM (SELECT year, event_id, unnest(iocs) AS i FROM told) GROUP BY ALL)
SELECT concat(year, '_', event_id) AS id, files, coalesce(n, 0)::INT AS n_iocs FROM best LEFT JOIN n USING (year, event_id)""")
def event_merge(spark, sf_dir):
    """Files of a year merged by event."""
    got = events.merge_events(events.scanned_events(events.parse_files(event_files(spark, sf_dir))))
    return got.select("id", F.array_join("source_files", ",").alias("files"), F.size("iocs").alias("n_iocs"))


@query("""WITH r AS (SELECT CASE WHEN event_id % 6 = 0 THEN 0 WHEN event_id % 6 <> 1 THEN event_id END AS n, CASE WHEN event_id % 5 <> 0 THEN ts::DATE END AS d, CASE WHEN event_id % 4 = 0 THEN ' ' WHEN event_id % 4 = 1 THEN NULL ELSE event_type END AS t, concat('2024_', event_id) AS id FROM events),
m AS (SELECT id, CASE WHEN n IS NULL OR n <= 0 THEN 'Missing or invalid event_id' WHEN d IS NULL THEN 'Missing date for CTI event ' || id WHEN t IS NULL OR trim(t) = '' THEN 'Missing or empty info_title for CTI event ' || id END AS reason FROM r)
SELECT id AS record_id, 'cti_event' AS record_type, reason FROM m WHERE reason IS NOT NULL""")
def event_rejections(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("2024_"), n.cast("string")).alias("id"), F.when(n % 6 == 0, F.lit(0).cast("long")).when(n % 6 != 1, n).alias("event_id"), F.when(n % 5 != 0, F.to_date("ts")).alias("date"),
        F.when(n % 4 == 0, " ").when(n % 4 != 1, F.col("event_type")).alias("info_title"),
    )
    return events.validate_events(rows)[1].select("record_id", "record_type", "reason")


@query("""WITH ev AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'url' WHEN 'view' THEN 'Domain' WHEN 'error' THEN 'md5' WHEN 'purchase' THEN 'filename' ELSE 'comment' END AS kind, json_extract_string(props, '$.k') AS v FROM events),
told AS (SELECT user_id, v, min(event_id) AS first FROM (SELECT user_id, lower(kind) AS t, v, min(event_id) AS event_id FROM ev GROUP BY ALL) WHERE t <> 'comment' GROUP BY ALL)
SELECT '2024_' || user_id AS id, 0 AS pos, 'Event_2024_' || user_id AS name, 'EvidenceSource' AS type FROM (SELECT DISTINCT user_id FROM ev)
UNION ALL SELECT '2024_' || user_id, row_number() OVER (PARTITION BY user_id ORDER BY first)::INT, v, 'IOC' FROM told""")
def ioc_entities(spark, sf_dir):
    """Each indicator's value once an event, after the event's source."""
    iocs = events.dedup_iocs(event_rows(spark, sf_dir), ["user_id"], F.col("event_id"))
    rows = iocs.select(F.concat(F.lit("2024_"), F.col("user_id").cast("string")).alias("id"), F.lit("2024-01-31").cast("date").alias("date"), F.lit("").alias("info_title"), "iocs")
    return extract.extract_iocs(rows).select("id", F.posexplode("entities").alias("pos", "e")).select("id", "pos", F.col("e.canonical_name").alias("name"), "e.type")


# -- CVE records in JSON, one for each part

CVES_SQL = """c AS (SELECT p_partkey AS k, 'CVE-2024-' || p_partkey AS cve_id, p_name, p_brand, p_size, TIMESTAMP '2024-01-01 10:00:00' + INTERVAL 1 DAY * (p_partkey % 300) AS t FROM part),
r AS (SELECT k, cve_id, CASE k % 7 WHEN 0 THEN date_trunc('day', t) WHEN 1 THEN TIMESTAMP '2020-02-02' ELSE t END AS date_published, CASE k % 6 WHEN 0 THEN date_trunc('day', t) WHEN 2 THEN t END AS date_public,
  CASE k % 4 WHEN 0 THEN 'en ' || p_name WHEN 1 THEN 'fr ' || p_name WHEN 2 THEN '' END AS description, CASE k % 3 WHEN 0 THEN 'CWE-' || p_size WHEN 1 THEN 'CWE-1' END AS cwe_id, CASE k % 3 WHEN 0 THEN 'text' END AS cwe_description,
  CASE k % 5 WHEN 0 THEN p_brand WHEN 2 THEN 'V' WHEN 4 THEN p_brand END AS vendor, CASE k % 5 WHEN 0 THEN lower(p_brand) WHEN 1 THEN p_name WHEN 2 THEN 'x' WHEN 4 THEN p_name END AS product,
  CASE WHEN k % 5 IN (0, 4) THEN '<9;1 < ' || p_size || ';3' ELSE '' END AS versions,
  CASE k % 4 WHEN 0 THEN 7.5 WHEN 1 THEN 6.5 WHEN 3 THEN 7.5 END::DOUBLE AS cvss_score, CASE k % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' END AS cvss_severity, CASE k % 4 WHEN 0 THEN '3.1' WHEN 1 THEN '4.0' WHEN 3 THEN '3.1' ELSE 'none' END AS cvss_version,
  CASE WHEN k % 2 = 0 THEN 'https://x/' || k ELSE '' END AS refs FROM c)"""


def cve_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and a JSON record of each part, with fields of all kinds there or missing."""
    k, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    t = F.expr("TIMESTAMP '2024-01-01 10:00:00' + make_dt_interval(CAST(p_partkey % 300 AS INT))")
    iso, day = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(t, "yyyy-MM-dd")
    text = lambda lang, c: F.struct(F.lit(lang).alias("lang"), c.alias("value"))
    en, blank = F.concat(F.lit(" en "), name, F.lit(" ")), F.lit("  ")
    descriptions = F.when(k % 4 == 0, F.array(text("de", name), text("en", en))).when(k % 4 == 1, F.array(text("fr", F.concat(F.lit("fr "), name)))).when(k % 4 == 2, F.array(text("en", blank), text("de", name)))
    weak = lambda i, d: F.struct(i.cast("string").alias("cweId"), F.lit(d).alias("description"))
    group = lambda *x: F.struct(F.array(*x).alias("descriptions"))
    problems = F.when(k % 3 == 0, F.array(group(weak(F.lit(None), "text"), weak(F.concat(F.lit("CWE-"), F.col("p_size").cast("string")), "")))).when(k % 3 == 1, F.array(group(weak(F.lit(""), "")), group(weak(F.lit("CWE-1"), ""))))
    version = lambda v, less: F.struct(F.lit(v).alias("version"), less.cast("string").alias("lessThan"))
    none = F.lit(None).cast("string")
    versions = F.array(version("0", F.lit("9")), version("1", F.col("p_size").cast("string")), version("3", none), version(" ", none))
    made = lambda v, p, w: F.struct(v.cast("string").alias("vendor"), p.cast("string").alias("product"), w.alias("versions"))
    no = versions.cast("array<struct<version: string, lessThan: string>>")
    no = F.filter(no, lambda _: F.lit(False))
    affected = F.when(k % 5 == 0, F.array(made(brand, F.lower(brand), versions))).when(k % 5 == 1, F.array(made(none, name, no))).when(k % 5 == 2, F.array(made(F.lit(""), F.lit("x"), no), made(F.lit("V"), none, no))).when(k % 5 == 4, F.array(made(brand, name, versions)))
    score = lambda x, s: F.struct(F.lit(x).alias("baseScore"), F.lit(s).alias("baseSeverity"), F.lit("v").alias("vectorString"))
    absent = F.lit(None).cast("struct<baseScore: double, baseSeverity: string, vectorString: string>")
    v3 = F.struct(score(7.5, "HIGH").alias("cvssV3_1"), absent.alias("cvssV4_0"))
    v4 = F.struct(absent.alias("cvssV3_1"), score(6.5, "MEDIUM").alias("cvssV4_0"))
    metrics = F.when(k % 4 == 0, F.array(v4, v3)).when(k % 4 == 1, F.array(v4)).when(k % 4 == 3, F.array(v3))
    link = lambda u: F.struct(u.alias("url"))
    cna = F.struct(
        F.when(k % 6 == 0, day).when(k % 6 == 2, iso).alias("datePublic"), descriptions.alias("descriptions"), problems.alias("problemTypes"), affected.alias("affected"), metrics.alias("metrics"),
        F.when(k % 2 == 0, F.array(link(F.concat(F.lit("https://x/"), k.cast("string"))), link(F.lit("")))).alias("references"),
    )
    meta = F.struct(F.concat(F.lit("CVE-2024-"), k.cast("string")).alias("cveId"), F.when(k % 7 > 1, iso).alias("datePublished"), F.when(k % 7 == 0, day).alias("dateReserved"))
    return table(spark, sf_dir, "part").select(k.alias("k"), F.to_json(F.struct(meta.alias("cveMetadata"), F.struct(cna.alias("cna")).alias("containers"))).alias("json"))


def cve_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = cve_texts(spark, sf_dir).select(F.col("k").cast("string").alias("file"), F.from_json("json", CVE_JSON).alias("r"))
    return cves.parse_cves(raw, "2020-02-02")


@query(f"WITH {CVES_SQL} SELECT cve_id, date_published, date_public, description, cwe_id, cwe_description, vendor, product, versions, cvss_score, cvss_severity, cvss_version, refs FROM r")
def cve_records(spark, sf_dir):
    return cve_rows(spark, sf_dir).select(
        "cve_id", "date_published", "date_public", "description", "cwe_id", "cwe_description", F.col("affected_vendor").alias("vendor"), F.col("affected_product").alias("product"),
        F.array_join("affected_versions", ";").alias("versions"), "cvss_score", "cvss_severity", "cvss_version", F.array_join("references", ";").alias("refs"),
    )


@query(f"""WITH {CVES_SQL} SELECT cve_id, CASE WHEN lower(vendor) = lower(product) THEN product WHEN vendor IS NOT NULL AND product IS NOT NULL THEN vendor || ' ' || product ELSE coalesce(product, vendor, cve_id) END AS head,
  'has_vulnerability' AS relation, cve_id AS tail, strftime(coalesce(date_public, date_published), '%Y-%m-%d') AS time, CASE WHEN coalesce(description, '') = '' THEN 'Vulnerability ' || cve_id ELSE left(repeat(description || ' ', 30), 200) END AS evidence FROM r""")
def cve_facts(spark, sf_dir):
    """Products and vulnerabilities; descriptions are made long, so that evidence is cut."""
    d = F.col("description")
    rows = cve_rows(spark, sf_dir).withColumn("description", F.when(F.coalesce(d, F.lit("")) != "", F.repeat(F.concat(d, F.lit(" ")), 30)))
    got = extract.extract_cves(rows).select("id", F.explode("relations").alias("r"))
    return got.select(F.col("id").alias("cve_id"), "r.head", "r.relation", "r.tail", "r.time", "r.evidence")


@query("""SELECT 'CVE-2024-' || n_regionkey AS cve_id, 'en ' || max_by(n_name, n_nationkey) AS description, count(*) AS files FROM nation GROUP BY n_regionkey""")
def cve_files(spark, sf_dir):
    """A JSON file for each nation below folders, none with a CVE's name: all are read, and of one id the last file by name."""
    at = scratch(spark, "cves") + "/json"
    text = F.array(F.struct(F.lit("en").alias("lang"), F.concat(F.lit("en "), "n_name").alias("value")))
    key = F.concat(F.lit("CVE-2024-"), F.col("n_regionkey").cast("string"))
    rows = table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("k"), F.struct(key.alias("cveId")).alias("cveMetadata"), F.struct(F.struct(text.alias("descriptions")).alias("cna")).alias("containers"))
    rows.coalesce(1).write.partitionBy("k").json(at)
    found = cves.parse_cves(cves.scan_cves(spark, at), "2020-02-02")
    n = found.groupBy("cve_id").agg(F.count("*").alias("files"))
    return cves.latest(found).join(n, "cve_id").select("cve_id", "description", "files")


# -- texts and dates

DATES_SQL = "d AS (SELECT o_orderkey AS k, o_orderdate AS t, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT10:30:00Z') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT10:30:00') WHEN 3 THEN 'on ' || strftime(o_orderdate, '%Y') END AS raw FROM orders)"


@query(f"WITH {DATES_SQL} SELECT k AS o_orderkey, CASE WHEN k % 5 < 3 THEN t::DATE END AS day, CASE WHEN k % 5 = 0 THEN t::DATE::TIMESTAMP WHEN k % 5 < 3 THEN t::DATE::TIMESTAMP + INTERVAL 630 MINUTE END AS moment FROM d")
def date_parse(spark, sf_dir):
    k, t = F.col("o_orderkey") % 5, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "yyyy-MM-dd'T10:30:00Z'")).when(k == 2, F.date_format(t, "yyyy-MM-dd'T10:30:00'")).when(k == 3, F.concat(F.lit("on "), F.date_format(t, "yyyy")))
    return table(spark, sf_dir, "orders").select("o_orderkey", Time.parse_date(raw).alias("day"), Time.parse_instant(raw).alias("moment"))


CHAT_SQL = """t AS (SELECT p_partkey AS k, concat('2024_', p_partkey) AS id, p_partkey % 6 AS form, p_brand FROM part),
a AS (SELECT *, form IN (0, 1, 2, 4) AS told FROM t)"""


def rule_chat(messages: list[dict]) -> str:
    """A model by rule: of the number that ends a title, some are answered at once, some in a fence, some after being asked again, some never, and some raise."""
    number = int(messages[0]["content"].rsplit(" ", 1)[1])
    found = {"entities": [{"text": f"Actor {number}", "type": "ThreatActor", "confidence": "0.7-0.9"}, {"text": "{'text': 'Tool'}", "canonical_name": "", "confidence": 2}, {"text": " ", "type": "Tool"}], "relations": [{"head": f"Actor {number}", "tail": "Tool", "time": "null"}, {"head": "", "tail": "x"}]}
    form, text = number % 6, json.dumps(found)
    if form == 5:
        raise KeyError("message")
    if form == 3 or (form == 2 and len(messages) == 1):
        return "I do not know."
    return f"Here:\n```json\n{text[:-1]},}}\n```" if form == 1 else f"<think>{{}}</think>{text}" if form == 4 else text


@query(f"""WITH {CHAT_SQL} SELECT id, 'Title of ' || k || '/EvidenceSource/1.0;' || k || '/IOC/1.0' || CASE WHEN told THEN ';Actor ' || k || '/ThreatActor/0.8;Tool/Unknown/1.0' ELSE '' END AS entities,
  'Title of ' || k || ' has_hash ' || k || ' 2024-01-31' || CASE WHEN told THEN ';Actor ' || k || ' relates_to Tool 2024-01-31' ELSE '' END AS relations FROM a""")
def chat_answers(spark, sf_dir):
    """Facts of titles by a model that is asked again, fails, thinks aloud and makes mistakes, after those of indicators."""
    k = F.col("p_partkey").cast("string")
    ioc = F.array(F.struct(F.lit("Other").alias("category"), F.lit("md5").alias("type"), k.alias("value"), F.lit("").alias("comment")))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("2024_"), k).alias("id"), F.lit("2024-01-31").cast("date").alias("date"), F.concat(F.lit("Title of "), k).alias("info_title"), ioc.alias("iocs"))
    got = event_facts(rows, rule_chat)
    entity = F.transform("entities", lambda e: F.concat_ws("/", e.canonical_name, e.type, e.confidence.cast("string")))
    relation = F.transform("relations", lambda r: F.concat_ws(" ", r.head, r.relation, r.tail, r.time))
    return got.select("id", F.array_join(entity, ";").alias("entities"), F.array_join(relation, ";").alias("relations"))


# -- stored tables

@query("""WITH n AS (SELECT concat(2000 + n_regionkey, '_', n_nationkey) AS id, n_nationkey AS k FROM nation), w AS (SELECT unnest(['2000_0', '7', '24', 'none']) AS wanted)
SELECT wanted, arg_min(id, struct_pack(e := id <> wanted, i := id)) AS id FROM w JOIN n ON id = wanted OR ends_with(id, '_' || wanted) GROUP BY wanted""")
def record_lookup(spark, sf_dir):
    """Extractions written as JSON and read again; records by their id or its end."""
    at = scratch(spark, "records") + "/json"
    key = F.concat_ws("_", 2000 + F.col("n_regionkey"), "n_nationkey")
    rows = table(spark, sf_dir, "nation").select(key.alias("id"))
    typed = spark.createDataFrame([], EXTRACTION)
    tables.write_table(typed.unionByName(rows, allowMissingColumns=True), at, "json")
    found = tables.read_extractions(spark, at)
    out = [tables.find_by_id(found, "id", w).select(F.lit(w).alias("wanted"), "id") for w in ("2000_0", "7", "24", "none")]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("""WITH c AS (SELECT 'G ' || p_brand AS g, 'S' || p_size || ';S' || (p_size + 1) AS s, 'T1' || lpad((p_size * 7)::VARCHAR, 3, '0') || '; ' || p_type AS t, NULL AS u FROM part),
x AS (SELECT g AS term, 'group' AS kind FROM c UNION SELECT s, 'software' FROM c UNION SELECT unnest(string_split(t, ';')), 'technique' FROM c)
SELECT DISTINCT trim(term) AS term, kind, lower(trim(term)) AS term_lower FROM x WHERE trim(term) <> ''
UNION SELECT unnest(%s), 'tactic', lower(unnest(%s))""" % (([*TACTICS, *TACTICS.values()],) * 2))
def taxonomy_terms(spark, sf_dir):
    """A taxonomy of four columns written as CSV, with the tactics and their ids."""
    at = scratch(spark, "taxonomy") + "/csv"
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("G "), "p_brand").alias("APT Group Name"), F.concat(F.lit("S"), size.cast("string"), F.lit(";S"), (size + 1).cast("string")).alias("Software ID"),
        F.concat(F.lit("T1"), F.lpad((size * 7).cast("string"), 3, "0"), F.lit("; "), "p_type").alias("Group Techniques"), F.lit(None).cast("string").alias("Software Techniques"),
    )
    rows.write.option("header", True).csv(at)
    return terms.taxonomy(spark, at).select("term", "kind", "term_lower")


@query("""WITH r AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'Initial ACCESS ' WHEN 1 THEN 'seen t1059.001 in ' || p_name WHEN 2 THEN repeat(p_name || ' of no such kind at all, ', 4) END AS name FROM part)
SELECT DISTINCT name, CASE k % 4 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE 1 END::DOUBLE AS score FROM r""")
def taxonomy_exact(spark, sf_dir):
    """Terms whatever their case, technique ids within names, names too long for any term, and none."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    made = F.when(k == 0, "Initial ACCESS ").when(k == 1, F.concat(F.lit("seen t1059.001 in "), name)).when(k == 2, F.repeat(F.concat(name, F.lit(" of no such kind at all, ")), 4))
    return trust.match_terms(table(spark, sf_dir, "part").select(made.alias("name")), [*TACTICS.values(), "T1059"])


@query(f"WITH {EDGES_SQL}, e AS (SELECT rel_type, count(*) AS edges FROM edges GROUP BY ALL), n AS (SELECT count(*) AS nodes FROM (SELECT DISTINCT head_name FROM edges UNION SELECT DISTINCT tail_name FROM edges)) SELECT rel_type, edges, nodes, 0::BIGINT AS broken FROM e, n")
def graph_store(spark, sf_dir):
    """The graph written and read again."""
    at = scratch(spark, "graph")
    e = kept_edges(spark, sf_dir)
    empty = tables.read_graph(spark, f"{at}/none")
    tables.write_graph(empty[0].unionByName(nodes_of(e)), empty[1].unionByName(e), f"{at}/v1")
    nodes, found = tables.read_graph(spark, f"{at}/v1")
    n = nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(tables.broken_keys(nodes).agg(F.count("*").alias("broken"))))
    return found.groupBy("rel_type").agg(F.count("*").alias("edges")).join(F.broadcast(n))  # one row


@query("""WITH l AS (SELECT 'A' || (o_orderkey % 90) AS entity_a, 'B' || o_orderkey AS entity_b, strftime(o_orderdate, '%Y-%m-%d') AS timestamp FROM orders) SELECT entity_a, entity_b, timestamp FROM l ORDER BY timestamp DESC, entity_a, entity_b LIMIT 20""")
def decision_log(spark, sf_dir):
    """Decisions appended in two parts; the last by time."""
    at = scratch(spark, "decisions") + "/log"
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("A"), (k % 90).cast("string")).alias("entity_a"), F.concat(F.lit("B"), k.cast("string")).alias("entity_b"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"))
    for half in (0, 1):
        tables.log_decisions(rows.where(F.substring("entity_b", 2, 20).cast("long") % 2 == half), at)
    return tables.last_decisions(spark, at, 20).select("entity_a", "entity_b", "timestamp")


@query("""SELECT concat(2000 + n_regionkey, '_', n_nationkey) AS id, n_name AS name, strftime(DATE '2024-01-01' + n_nationkey::INT, '%Y-%m-%d') AS date, concat('2000_', n_nationkey, '.json') = concat(2000 + n_regionkey, '_', n_nationkey, '.json') AS first FROM nation""")
def record_files(spark, sf_dir):
    """A JSON file for each record, named by its id, written and read again."""
    at = scratch(spark, "files") + "/json"
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(F.concat_ws("_", 2000 + F.col("n_regionkey"), k).alias("id"), F.col("n_name").alias("name"), F.date_add(F.lit("2024-01-01").cast("date"), k).alias("date"))
    tables.write_files(rows, "id", at)
    found = spark.read.option("multiLine", True).schema("id string, name string, date string").json(at)
    return found.select("id", "name", "date", F.col("_metadata.file_name").startswith("2000_").alias("first"))


# -- the graph

@query(f"WITH {SCORED_SQL} SELECT head_name, rel_type, tail_name, source, CASE WHEN tail_name LIKE '%STANDARD' THEN 0.123::DOUBLE ELSE trust END AS trust, CASE WHEN tail_name LIKE '%STANDARD' THEN NULL ELSE s4 END AS support FROM scored")
def score_missing(spark, sf_dir):
    """Edges that have trust keep it; the others' support counts all."""
    e = kept_edges(spark, sf_dir).withColumn("trust", F.when(F.col("tail_name").endswith("STANDARD"), 0.123))
    got = trust.score_missing(e, nodes_of(e, 900, 1300))
    return got.select("head_name", "rel_type", "tail_name", "source", "trust", F.col("score_cross_source").alias("support"))


@query(f"WITH {SCORED_SQL}, s AS (SELECT *, row_number() OVER (ORDER BY head_name, rel_type, tail_name, source) <= 50 AS mine FROM scored) SELECT mine AS scored, count(*) AS n, round(sum(CASE WHEN mine THEN trust END), 6) AS total FROM s GROUP BY mine")
def score_sample(spark, sf_dir):
    """Fifty edges are scored, all stay."""
    e = kept_edges(spark, sf_dir)
    got = trust.score_missing(e, nodes_of(e, 900, 1300), sample=50)
    return got.groupBy(F.col("trust").isNotNull().alias("scored")).agg(F.count("*").alias("n"), F.round(F.sum("trust"), 6).alias("total"))


@query(f"WITH {SCORED_SQL} SELECT count(*) AS edges, 0::BIGINT AS scored, count(s4) AS factors FROM scored")
def force_reset(spark, sf_dir):
    e = kept_edges(spark, sf_dir)
    return trust.reset(trust.score_edges(e, nodes_of(e))).agg(F.count("*").alias("edges"), F.count("trust").alias("scored"), F.count("score_cross_source").alias("factors"))


ALIAS_NAMES = ("Fancy-Bear", "sofacy", "APT28", "APT 28", "Cozy Bear!", "Lazarus Group", "lazarus", "ocean lotus", "Медведь", "熊", "Solo")
ALIGN_SQL = NAMES_SQL.split("groups AS")[0] + """more AS (SELECT name, type, 0::BIGINT AS degree FROM (SELECT unnest(%s) AS name), (SELECT unnest(['ThreatActor', 'IOC']) AS type)),
every AS (SELECT * FROM names UNION ALL SELECT * FROM more),
norms AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS raw FROM every),
groups AS (SELECT name, type, degree, lower(CASE raw %s ELSE raw END) AS norm FROM norms),
reps AS (SELECT type, norm, arg_min(name, struct_pack(d := -degree, n := name)) AS rep FROM groups WHERE type <> 'IOC' GROUP BY ALL)""" % (list(ALIAS_NAMES), " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items()))


@query(f"WITH {ALIGN_SQL} SELECT g.name, g.type, CASE WHEN g.type = 'IOC' AND g.name = 'Solo' THEN 'kept' ELSE coalesce(rep, g.name) END AS canonical_id FROM groups g LEFT JOIN reps r ON g.type = r.type AND g.norm = r.norm")
def align_names(spark, sf_dir):
    """Names and aliases of parts and of known groups, by degree; types that are not aligned keep what they have."""
    return align_by_names(spark, sf_dir)[0].select("name", "type", "canonical_id")


@query(f"WITH {ALIGN_SQL} SELECT rep AS entity_a, name AS entity_b, g.type, 'exact_or_alias_match' AS method, 1.0::DOUBLE AS similarity, 'merged' AS decision FROM groups g JOIN reps r ON g.type = r.type AND g.norm = r.norm WHERE name <> rep")
def align_decisions(spark, sf_dir):
    return align_by_names(spark, sf_dir)[1].select("entity_a", "entity_b", "type", "method", "similarity", "decision")


def align_by_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each line names a part once, as the tail of an edge."""
    more = spark.createDataFrame([(n, t) for n in ALIAS_NAMES for t in ("ThreatActor", "IOC")], "name string, type string")
    names = part_names(spark, sf_dir)
    every = names.select("name", "type").unionByName(more)
    none = F.lit(None)
    nodes = every.select("name", "type", F.col("name").alias("raw_text"), F.when((F.col("type") == "IOC") & (F.col("name") == "Solo"), "kept").alias("canonical_id"), none.cast("timestamp").alias("first_seen"), none.cast("timestamp").alias("last_seen"))
    sold = names.where("degree > 0").select(F.explode(F.sequence(F.lit(1), F.col("degree").cast("int"))).alias("n"), "name", "type")
    edges = sold.select(F.lit("x").alias("head_name"), F.lit("Product").alias("head_type"), F.col("name").alias("tail_name"), F.col("type").alias("tail_type"))
    return align.align(nodes, edges, decided_at=F.lit("2024-01-01").cast("timestamp"), types=ALIGNABLE_TYPES)


LETTERS = "0123456789aeionrst"
VECTOR_SQL = "list_transform([%s], lambda x: x::FLOAT)" % ", ".join(f"length(lower(t)) - length(replace(lower(t), '{c}', ''))" for c in LETTERS)


def letter_counts(texts: list[str]) -> np.ndarray:
    """A model by rule: how often a text holds each of some letters."""
    return np.array([[t.lower().count(c) for c in LETTERS] for t in texts], np.float32).reshape(len(texts), len(LETTERS))

INDEX_SQL = f""",
ends AS (SELECT head_name AS name, 'ThreatActor' AS type FROM edges UNION SELECT tail_name, 'Malware' FROM edges), m AS (SELECT name, type, type || ': ' || name AS t FROM ends),
v AS (SELECT name, type, {VECTOR_SQL} AS raw FROM m), q AS (SELECT {VECTOR_SQL} AS e FROM (SELECT 'Which threat actor uses standard tin brass?' AS t)),
u AS (SELECT name, type, list_transform(raw, lambda x: (x / CASE WHEN list_inner_product(raw::DOUBLE[], raw::DOUBLE[]) = 0 THEN 1 ELSE sqrt(list_inner_product(raw::DOUBLE[], raw::DOUBLE[])) END)::FLOAT) AS e FROM v),
s AS (SELECT name, type, list_inner_product(u.e::DOUBLE[], q.e::DOUBLE[]) AS sim FROM u, q), top AS (SELECT * FROM s ORDER BY sim DESC, type || '::' || name LIMIT %d)"""
QUESTION = "Which threat actor uses standard tin brass?"


@query(f"WITH {EDGES_SQL}{INDEX_SQL % 20} SELECT name, type, round(sim, 4) AS similarity FROM top")
def index_search(spark, sf_dir):
    """An index of the graph's nodes, written, read and searched with a model by rule."""
    e = kept_edges(spark, sf_dir)
    at = scratch(spark, "index") + "/v1"
    n = nodes_of(e)
    dated = n.unionByName(n.limit(1).withColumns({"type": F.lit("Time"), "name": F.lit("2020")}))  # a type that is not indexed
    retrieve.build_index(dated, at, letter_counts)
    got = retrieve.search(retrieve.load_index(spark, at), QUESTION, 20, letter_counts)
    return got.select("name", "type", "similarity")


VECTORS_SQL = (
    EDGES_SQL
    + f""",
ends AS (SELECT head_name AS name, 'ThreatActor' AS type, tau FROM edges UNION ALL SELECT tail_name, 'Malware', tau FROM edges),
n AS (SELECT name, type, count(*) AS degree, min(tau) + (length(name) % 3 * 1000)::INT AS first, type || ': ' || name AS t FROM ends GROUP BY name, type),
raws AS (SELECT *, {VECTOR_SQL} AS raw FROM n),
u AS (SELECT *, list_transform(raw, lambda x: (x / CASE WHEN list_inner_product(raw::DOUBLE[], raw::DOUBLE[]) = 0 THEN 1 ELSE sqrt(list_inner_product(raw::DOUBLE[], raw::DOUBLE[])) END)::FLOAT)::DOUBLE[] AS e, row_number() OVER (PARTITION BY type ORDER BY degree DESC, name) AS i FROM raws),
p AS (SELECT a.type, a.i, b.i AS j, list_inner_product(a.e, b.e) AS sim FROM u a JOIN u b ON a.type = b.type AND a.i <> b.i),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type, i ORDER BY sim DESC, j) AS k FROM p) WHERE k <= 49 AND j > i AND sim >= 0.95::DOUBLE),
decided AS (SELECT near.*, a.name AS entity_a, b.name AS entity_b, greatest(datediff('day', a.first, b.first), datediff('day', b.first, a.first)) AS gap FROM near JOIN u a ON near.type = a.type AND near.i = a.i JOIN u b ON near.type = b.type AND near.j = b.i)"""
)


def aligned_by_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and kinds of parts by a model by rule; what they are first seen is moved by their names' length, so that some are too far apart."""
    e = kept_edges(spark, sf_dir)
    n = nodes_of(e).withColumns({"first_seen": F.date_add(F.to_date("first_seen"), F.length("name") % 3 * 1000).cast("timestamp"), "last_seen": F.lit(None).cast("timestamp"), "canonical_id": F.lit(None).cast("string")})
    v = models.embed(n.select("name", "type", F.concat(F.col("type"), F.lit(": "), F.col("name")).alias("text")), "text", letter_counts)
    v = v.select("name", "type", unit(F.col("embedding")).alias("embedding"))
    return align.align(n, e, v, AlignConfig(threshold=0.95), F.lit("2024-01-01").cast("timestamp"))


@query(f"""WITH RECURSIVE {VECTORS_SQL}, l AS (SELECT type, i AS a, j AS b FROM decided WHERE gap <= 730 UNION ALL SELECT type, j, i FROM decided WHERE gap <= 730), c(type, a, b) AS (SELECT type, a, b FROM l UNION SELECT c.type, c.a, l.b FROM c JOIN l ON c.type = l.type AND c.b = l.a),
m AS (SELECT type, a, least(a, min(b)) AS lo FROM c GROUP BY type, a) SELECT u.name, u.type, coalesce(r.name, u.name) AS canonical_id FROM u LEFT JOIN m ON u.type = m.type AND u.i = m.a LEFT JOIN u r ON r.type = m.type AND r.i = m.lo""")
def align_full(spark, sf_dir):
    return aligned_by_vectors(spark, sf_dir)[0].select("name", "type", "canonical_id")


@query(f"""WITH {VECTORS_SQL} SELECT type, entity_a, entity_b, 'faiss_embedding' AS method, round(sim, 4) AS similarity, gap <= 730 AS temporal_check, CASE WHEN gap > 730 THEN concat('Temporal gap of ', gap, ' days exceeds limit (730 days)') ELSE 'Temporal overlap/gap within 730 days' END AS temporal_reason,
  CASE WHEN gap <= 730 THEN 'merged' ELSE 'rejected' END AS decision FROM decided""")
def align_similar(spark, sf_dir):
    return aligned_by_vectors(spark, sf_dir)[1].drop("timestamp")


def context_sql(facts: str, question: str) -> str:
    """The context's parts after SQL that ends with facts."""
    return facts + CONTEXT_SQL.replace("who acts?", question)


CONTEXT_SQL = """,
t AS (SELECT *, list_filter([x.d for x in hops], lambda d: d IS NOT NULL) AS ds FROM ranked), c AS (SELECT rank, 'Temporal Causal' AS label, 0 AS k FROM t WHERE len(hops) >= 2 AND len(ds) >= 2 AND ds = list_sort(ds) ORDER BY rank LIMIT 5),
picked AS (SELECT row_number() OVER (ORDER BY k, rank) AS position, label, rank FROM (SELECT * FROM c UNION ALL SELECT * FROM (SELECT rank, 'Structural', 1 FROM ranked ORDER BY rank LIMIT 5)) ORDER BY k, rank LIMIT 5),
plines AS (SELECT position, 'Path ' || position || ' (' || label || ', Trust=' || printf('%.2f', path_trust) || '):' || chr(10) || array_to_string(list_transform(hops, lambda h: '  (' || h.ht || ': ' || h.a || ') --[' || h.r || ']--> (' || h.tt || ': ' || h.b || ') | Date: ' || coalesce(strftime(h.d, '%Y-%m-%d'), 'Date Unknown') || ' | Evidence: "' || h.ev || '"'), chr(10)) AS line FROM picked JOIN ranked USING (rank)),
flines AS (SELECT *, '- (' || ht || ': ' || a || ') ' || r || ' (' || tt || ': ' || b || ') [Trust=' || printf('%.2f', trust) || ', Conf=' || printf('%.2f', conf) || ', Source=' || source || ', Trusted=' || CASE WHEN trusted THEN 'YES' ELSE 'NO' END || ']' AS line FROM facts),
paths AS (SELECT string_agg(line, chr(10) ORDER BY position) AS x, count(*) AS n FROM plines),
base AS (SELECT '=== RETRIEVED GRAPH CONTEXT ===' || chr(10) || chr(10) || '[Temporal & Causal Paths]' || chr(10) || x || chr(10) || chr(10) || '[Supporting Facts & Relations]' AS head, chr(10) || chr(10) || '[Query]' || chr(10) || 'who acts?' || chr(10) AS tail, n FROM paths),
w AS (SELECT f.*, row_number() OVER o AS place, sum(len(string_split_regex(trim(line), '\\s+'))) OVER o AS words FROM flines f WINDOW o AS (ORDER BY NOT trusted, fact_rank ROWS UNBOUNDED PRECEDING)),
fit AS (SELECT w.*, floor((words + (SELECT len(string_split_regex(trim(head || tail, chr(32) || chr(10)), '\\s+')) FROM base)) * 1.3::DOUBLE) <= 700 AS fits FROM w),
over AS (SELECT trusted FROM fit WHERE NOT fits ORDER BY place LIMIT 1),
told AS (SELECT head || coalesce(chr(10) || (SELECT string_agg(line, chr(10) ORDER BY place) FROM fit WHERE fits), '') || tail AS text, n AS paths_used, (SELECT count(*) FILTER (WHERE trusted) FROM fit) - (SELECT count(*) FROM over WHERE trusted) AS trusted_facts_used,
  (SELECT count(*) FILTER (WHERE NOT trusted) FROM fit) - (SELECT count(*) FROM over WHERE NOT trusted) AS untrusted_facts_used, (SELECT count(*) FROM fit WHERE fits) AS facts_included, (SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM fit) AS sources FROM base)"""


@query(f"WITH {context_sql(FACTS_SQL, 'who acts?')} SELECT * FROM told")
def context_text(spark, sf_dir):
    """The whole text of a question's context, cut to a budget, and what it says of itself."""
    paths = stored(supplier_paths(spark, sf_dir), "paths")
    text, stats = context.build_context("who acts?", traverse.chains(paths), traverse.facts(paths), 700)
    row = (text, stats["paths_used"], stats["trusted_facts_used"], stats["untrusted_facts_used"], stats["facts_included"], ",".join(stats["sources"]))
    return spark.createDataFrame([row], "text string, paths_used long, trusted_facts_used long, untrusted_facts_used long, facts_included long, sources string")


PATHS_OF_TOP = EDGES_SQL + INDEX_SQL % 3 + FACTS_SQL[len(EDGES_SQL) :].replace("src = 'Supplier#1'", "src IN (SELECT name FROM top)")


@query(f"WITH {context_sql(PATHS_OF_TOP, QUESTION)} SELECT (SELECT string_agg(name, ', ' ORDER BY name) FROM top) AS entities, text AS context, paths_used, facts_included, 'lines: ' || (length(text) - length(replace(text, chr(10), '')) + 3) AS answer FROM told")
def question_answer(spark, sf_dir):
    """A question from end to end: three seeds from the index, their paths and facts, the context, and a model by rule that thinks aloud."""
    e = stored(kept_edges(spark, sf_dir).withColumns({"trust": F.col("confidence"), "trusted": F.col("confidence") >= 0.95}), "trusted")
    n = nodes_of(e)
    at = scratch(spark, "index") + "/v1"
    retrieve.build_index(n, at, letter_counts)
    chat = lambda m: f"<think>well</think> lines: {m[0]['content'].count(chr(10)) + 1}"
    got = answer(spark, QUESTION, n, e, retrieve.load_index(spark, at), letter_counts, chat, RetrievalConfig(top_k=3, max_tokens=700))
    row = (", ".join(sorted(x["name"] for x in got["entities"])), got["context"], got["stats"]["paths_used"], got["stats"]["facts_included"], got["answer"])
    return spark.createDataFrame([row], "entities string, context string, paths_used long, facts_included long, answer string")


@query(f"WITH {FACTS_SQL.replace("src = 'Supplier#1'", "src IN ('Supplier#1', 'Supplier#7')")} SELECT rank, start, len(hops)::INT AS length, round(path_trust, 9) AS path_trust FROM ranked")
def paths_of_seeds(spark, sf_dir):
    """Two seeds, one of them given twice."""
    got = supplier_paths(spark, sf_dir, ("Supplier#1", "Supplier#7", "Supplier#1"))
    return got.select("rank", F.col("start.name").alias("start"), "length", F.round("path_trust", 9).alias("path_trust"))


@query(f"WITH {RESOLVE_SQL}, few AS (SELECT DISTINCT id FROM li ORDER BY id LIMIT 40) SELECT tail_type, count(*) AS edges FROM (SELECT DISTINCT id, head, tail_name, tail_type FROM rels WHERE id IN (SELECT id FROM few)) GROUP BY tail_type")
def ingest_limit(spark, sf_dir):
    """The first forty files by id."""
    some = stored(extractions(spark, sf_dir).orderBy("id").limit(40), "some")
    return graph.build(some, F.lit("2024-01-01").cast("timestamp"))[1].groupBy("tail_type").agg(F.count("*").alias("edges"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END ELSE 0.9 END::DOUBLE AS similarity FROM part""")
def technique_scores(spark, sf_dir):
    """Edges to tactics, to techniques by id in the name or in the canonical name, to unknown ones, and between others by their relation."""
    k, name = F.col("p_partkey"), F.col("p_name")
    tail = F.when(k % 4 == 0, "Initial ACCESS ").when(k % 4 == 1, F.concat(F.lit("seen t1059.001 in "), name)).otherwise(F.repeat(F.concat(name, F.lit(" of no such kind at all, ")), 4))
    kind = F.when(k % 4 == 0, "ATT&CKTactic").when(k % 4 == 3, "Malware").otherwise("AttackTechnique")
    parts = table(spark, sf_dir, "part").select(k.alias("p_partkey"), F.concat(tail, F.lit(" "), F.when(k % 4 != 0, k.cast("string")).otherwise("")).alias("tail"), kind.alias("kind"), "p_size")
    none = F.lit(None)
    e = parts.select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("head_name"), F.lit("Tool").alias("head_type"), F.when(F.col("kind") == "Malware", "BELONGS_TO_TACTIC").otherwise("USES").alias("rel_type"), F.col("tail").alias("tail_name"), F.col("kind").alias("tail_type"),
        F.lit("2024_1").alias("source"), none.cast("timestamp").alias("tau"), F.lit("unknown").alias("tau_raw"), F.lit("unknown").alias("tau_precision"), F.lit("").alias("evidence"), F.lit(0.9).alias("confidence"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    n = parts.groupBy(F.col("tail").alias("name"), F.col("kind").alias("type")).agg(F.max(F.when((F.col("p_partkey") % 4 == 2) & (F.col("p_size") % 2 == 0), "T1059")).alias("canonical_id"))
    n = n.select("name", "type", F.col("name").alias("raw_text"), "canonical_id", none.cast("timestamp").alias("first_seen"), none.cast("timestamp").alias("last_seen"))
    got = trust.score_edges(e, n, [*TACTICS.values(), "T1059"])
    return got.select(F.substring("head_name", 2, 20).cast("long").alias("p_partkey"), F.col("score_attck_similarity").alias("similarity"))
