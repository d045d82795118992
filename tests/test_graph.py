"""Extraction, graph, trust, alignment, traversal and context on small graphs."""

from __future__ import annotations

import datetime as dt
import difflib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.config import TACTICS, RetrievalConfig
from veritrail.functions.vector import dot
from veritrail.operators import align, context, extract, graph, retrieve, traverse, trust
from veritrail.operators import components
from veritrail.operators.components import component_roots
from veritrail.plans import jobs
from veritrail.schemas import EDGES, EVENTS, EXTRACTION, NODES
from veritrail.sources import tables
from veritrail.sources.models import hashed_ngrams
from veritrail.store import release, scratch, small, stored
from veritrail.streaming.upsert import current, upsert_stream

T0 = dt.datetime(2019, 1, 30)


def event(spark, iocs, title="Chafer used Remexi malware"):
    rows = [("2019_1976", 2019, 1976, dt.date(2019, 1, 30), title, [("C", t, v, "") for t, v in iocs], ["f"])]
    return spark.createDataFrame(rows, EVENTS)


def test_indicators(spark):
    x = extract.extract_iocs(event(spark, [("md5", "h"), ("ip-src", "1.1.1.1"), ("filename", "e.exe"), ("URL", "http://x"), ("comment", "c"), ("yara", "y"), ("md5", "h")])).first()
    assert [e.type for e in x.entities] == ["EvidenceSource"] + ["IOC"] * 5
    assert [r.relation for r in x.relations] == ["has_hash", "communicates_with", "drops_file", "uses_domain", "has_ioc", "has_hash"]
    assert {r.time for r in x.relations} == {"2019-01-30"} and x.relations[3].evidence == "IOC of type URL found in event 2019_1976"
    assert extract.extract_iocs(event(spark, [])).first().entities == []
    assert [e.type for e in extract.extract_iocs(event(spark, [("comment", "c")])).first().entities] == ["EvidenceSource"]


def test_cve_facts(spark):
    rows = spark.createDataFrame([("CVE-1", "Legora", "Legora", "d" * 300, dt.datetime(2026, 8, 17), dt.datetime(2026, 8, 18)), ("CVE-2", None, None, None, None, T0)], "cve_id string, affected_vendor string, affected_product string, description string, date_public timestamp, date_published timestamp")
    a, b = extract.extract_cves(rows).orderBy("id").collect()
    assert [e.text for e in a.entities] == ["Legora", "CVE-1"] and a.relations[0].relation == "has_vulnerability" and a.relations[0].time == "2026-08-17" and len(a.relations[0].evidence) == 200
    assert b.relations[0].head == "CVE-2" and b.relations[0].evidence == "Vulnerability CVE-2" and b.relations[0].time == "2019-01-30"


def test_answers(spark):
    raw = '{"entities": [{"text": "Chafer", "type": "ThreatActor", "confidence": 0.95}, {"text": " "}], "relations": [{"head": "Chafer", "tail": "Remexi", "time": "null"}, {"head": "", "tail": "x"}]}'
    rows = spark.createDataFrame([("e", dt.date(2019, 1, 30), raw), ("f", None, "nothing")], "id string, date date, raw_response string")
    e, f = extract.parse_responses(rows).orderBy("id").collect()
    assert [(x.text, x.type, x.confidence) for x in e.entities] == [("Chafer", "ThreatActor", 0.95)]
    assert [(r.relation, r.time, r.confidence) for r in e.relations] == [("relates_to", "2019-01-30", 0.85)] and f.entities == [] and f.relations == []
    assert extract.prompts(event(spark, [])).count() == 1 and extract.prompts(event(spark, [], "a.exe")).count() == 0
    both = extract.combine(extract.parse_responses(rows), extract.parse_responses(rows.where("id = 'e'"))).orderBy("id").collect()
    assert len(both[0].entities) == 2 and both[1].entities == []


def extraction(spark, *rows):
    return spark.createDataFrame([(i, [(t, k, c, 1.0) for t, k, c in e], [(h, r, t, w, "", c) for h, r, t, w, c in rel]) for i, e, rel in rows], EXTRACTION)


def test_build(spark):
    x = extraction(
        spark,
        ("2019_1", [("patchwork", "ThreatActor", "Patchwork APT"), ("PowerShell", "Tool", "PowerShell"), (" ", "Tool", "")], [("Patchwork", "uses", "powershell", "2019-01-30", 0.9), ("patchwork apt", "uses", "PowerShell", "2018", None), ("New", "targets", "PowerShell", "unknown", 0.5), ("", "x", "y", "", 1.0)]),
        ("2020_2", [("PowerShell", "Tool", "PowerShell")], [("PowerShell", "uses", "PowerShell", "2020-05", 1.0)]),
    )
    nodes, edges, warned = graph.build(x, F.lit(T0))
    n = {(r.name, r.type): r for r in nodes.collect()}
    assert set(n) == {("Patchwork APT", "ThreatActor"), ("PowerShell", "Tool"), ("New", "Unknown")}
    assert n["PowerShell", "Tool"].first_seen == T0 and n["PowerShell", "Tool"].last_seen == dt.datetime(2020, 5, 1) and n["New", "Unknown"].first_seen is None
    e = {(r.head_name, r.rel_type, r.source): r for r in edges.collect()}
    assert e["Patchwork APT", "USES", "2019_1"].tau_raw == "2018" and e["Patchwork APT", "USES", "2019_1"].confidence == 1.0 and len(e) == 3
    assert [r.message for r in warned.collect()] == ["[2019_1] Entity reference 'New' not found in entities list. Defaulting type to 'Unknown'."]
    assert graph.ingest_summary(x, nodes, edges, warned).first().asDict() == {"files": 2, "nodes": 3, "edges": 3, "warnings": 1}
    assert tables.broken_keys(nodes).count() == 0
    assert {r.name: r.degree for r in align.degrees(nodes, edges).collect()} == {"Patchwork APT": 1, "PowerShell": 3, "New": 1}


def edge(h, r, t, source="2019_1", tau=T0, conf=1.0, precision="day", ht="ThreatActor", tt="Malware"):
    return (h, ht, r, t, tt, source, tau, str(tau), precision, "ev", conf, T0)


def node(n, k="ThreatActor", canonical=None, first=T0, last=T0):
    return (n, k, n, canonical, first, last)


def test_scores_before_and_after_alignment(spark):
    edges = spark.createDataFrame([edge("A", "USES", "M"), edge("A", "USES", "M", "2019_2", dt.datetime(2021, 1, 1)), edge("A2", "USES", "M", "2019_3", None, precision="unknown")], EDGES)
    plain = spark.createDataFrame([node("A"), node("A2"), node("M", "Malware")], NODES)
    before = trust.score_edges(edges, plain).collect()
    assert {(r.score_cross_source, r.score_contradiction_penalty) for r in before} == {(0.3, 0.0)}
    aligned = spark.createDataFrame([node("A", canonical="A"), node("A2", canonical="A"), node("M", "Malware", "M")], NODES)
    after = trust.score_edges(edges, aligned).collect()
    assert {(r.score_cross_source, r.score_contradiction_penalty) for r in after} == {(1.0, 0.5)}
    assert all(0 <= r.trust <= 1 for r in after)
    s = trust.run_summary(trust.score_edges(edges, aligned)).first()
    assert s.total == 3 and s.contradictions == 3 and trust.run_summary(trust.score_edges(edges.limit(0), aligned)).first().mean == 0.0
    missing = trust.score_edges(edges, plain).withColumn("trust", F.when(F.col("source") == "2019_1", F.lit(0.123)))
    again = {r.source: r.trust for r in trust.score_missing(missing, aligned).collect()}
    assert again["2019_1"] == 0.123 and len(again) == 3 and again["2019_2"] > 0.5
    some = trust.score_missing(trust.reset(missing), aligned, sample=2)
    assert some.count() == 3 and sorted(r.source for r in some.where("trust IS NOT NULL").collect()) == ["2019_1", "2019_2"]
    none = missing.withColumn("source", F.lit(None).cast("string")).withColumn("trust", F.lit(None).cast("double"))
    assert trust.score_missing(none, aligned).where("trust IS NOT NULL").count() == 3
    assert trust.reset(missing).where("trust IS NOT NULL").count() == 0


def test_terms(spark):
    names = ["Initial Access", "initial acces", "uses t1059 a lot", "Fake technique xyzq", "Exec", ""]
    terms = [*TACTICS.values(), "T1059"]

    def brute(x):
        x = x.strip().lower()
        refs = [t.lower() for t in terms]
        if not x:
            return 0.0
        if x in refs or any(t.startswith("t1") and t in x for t in refs):
            return 1.0
        best = max(difflib.SequenceMatcher(None, x, t).ratio() for t in refs)
        return 1.0 if best >= 0.8 else 0.5 if best >= 0.6 else 0.0

    got = {r.name: r.score for r in trust.match_terms(spark.createDataFrame([(n,) for n in names], "name string"), terms).collect()}
    assert got == {n: brute(n) for n in names} and got["Initial Access"] == 1.0


@pytest.mark.parametrize("hub", [10**6, 3])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.rep: r.component for r in component_roots(spark.createDataFrame(links, "a long, b long"), scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert component_roots(spark.createDataFrame([], "a long, b long"), scratch(spark, "t")).count() == 0


def test_alignment(spark):
    nodes = spark.createDataFrame([node("APT28"), node("fancy bear"), node("APT 28"), node("Sofacy"), node("APT28", "Malware"), node("Solo", "IOC"), node("Bravo", "Tool"), node("alpha", "Tool", first=dt.datetime(2000, 1, 1), last=dt.datetime(2000, 1, 1))], NODES)
    edges = spark.createDataFrame([edge("APT28", "USES", "APT28", f"2019_{k}") for k in range(3)] + [edge("APT 28", "USES", "APT28", "2019_9")], EDGES)
    got, decisions = align.align(nodes, edges)
    c = {(r.name, r.type): r.canonical_id for r in got.collect()}
    assert c == {("APT28", "ThreatActor"): "APT28", ("fancy bear", "ThreatActor"): "APT28", ("APT 28", "ThreatActor"): "APT 28", ("Sofacy", "ThreatActor"): "APT28", ("APT28", "Malware"): "APT28", ("Solo", "IOC"): "Solo", ("Bravo", "Tool"): "Bravo", ("alpha", "Tool"): "alpha"}
    assert {(d.entity_a, d.entity_b, d.method) for d in decisions.collect()} == {("APT28", "fancy bear", "exact_or_alias_match"), ("APT28", "Sofacy", "exact_or_alias_match")}
    v = [("APT28", "ThreatActor", [1.0, 0.0]), ("APT 28", "ThreatActor", [0.9, 0.43589]), ("Bravo", "Tool", [1.0, 0.0]), ("alpha", "Tool", [1.0, 0.0])]
    got, decisions = align.align(nodes, edges, spark.createDataFrame(v, "name string, type string, embedding array<float>"))
    c = {(r.name, r.type): r.canonical_id for r in got.collect()}
    assert c["APT 28", "ThreatActor"] == "APT28" and c["alpha", "Tool"] == "alpha"
    similar = {(d.entity_a, d.entity_b): d for d in decisions.where("method = 'faiss_embedding'").collect()}
    assert similar["APT28", "APT 28"].decision == "merged" and similar["APT28", "APT 28"].similarity == 0.9
    assert similar["Bravo", "alpha"].decision == "rejected" and "exceeds limit" in similar["Bravo", "alpha"].temporal_reason
    assert align.global_counts(got).first().nodes == 8 and [r.merged for r in align.by_type(got).where("type = 'ThreatActor'").collect()] == [3]
    top = align.top_clusters(got).collect()
    assert [(r.canonical_id, r.size, r.names) for r in top] == [("APT28", 4, ["APT 28", "APT28", "Sofacy", "fancy bear"])]


def test_non_ascii_names_merge_unless_guarded(spark):
    nodes = spark.createDataFrame([node("Медведь"), node("熊")], NODES).withColumn("degree", F.lit(0))
    assert align.exact_groups(nodes).select("rep").distinct().count() == 1
    assert align.exact_groups(nodes, guard_empty=True).select("rep").distinct().count() == 2


def similar_by_join(vectors, k, threshold):
    """Pairs in relational form."""
    a, b = vectors.toDF(*(f"{c}_a" for c in vectors.columns)), vectors.toDF(*(f"{c}_b" for c in vectors.columns))
    pairs = a.join(b, (F.col("type_a") == F.col("type_b")) & (F.col("i_a") != F.col("i_b"))).withColumn("sim", dot(F.col("embedding_a"), F.col("embedding_b")))
    rank = F.row_number().over(Window.partitionBy("type_a", "i_a").orderBy(F.desc("sim"), "i_b"))
    return pairs.withColumn("rank", rank).where((F.col("rank") <= k - 1) & (F.col("i_b") > F.col("i_a")) & (F.col("sim") >= threshold)).select(F.col("i_a").alias("i"), F.col("i_b").alias("j"))


def test_nearest_of_many(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "t" if i % 2 else "u", f"c{i % 9}", [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    index = spark.createDataFrame(rows, "n long, type string, canonical_id string, embedding array<float>")
    asks = index.where("n % 10 = 0").select(F.col("n").alias("ask"), "embedding")
    monkeypatch.setattr(align, "BLOCK", 7)
    got = retrieve.nearest_each(index, asks, 6, "n").collect()
    for ask in (0, 10, 20, 30):
        one = retrieve.nearest(index, [float(x) for x in index.where(f"n = {ask}").first().embedding], 6, "n").collect()
        assert sorted((r.n, r.similarity) for r in got if r.ask == ask) == sorted((r.n, r.similarity) for r in one)


def test_similar_pairs_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("t", i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    v = spark.createDataFrame(rows, "type string, i long, embedding array<float>")
    want = {(r.i, r.j) for r in similar_by_join(v, 6, 0.5).collect()}
    monkeypatch.setattr(align, "BLOCK", 7)
    assert {(r.i, r.j) for r in align.similar_pairs(v, 6, 0.5).collect()} == want and want


def test_buckets_find_most_similar_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 24))
    v = (centres[rng.integers(0, 60, 600)] + 0.28 * rng.normal(size=(600, 24))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(f"t{k % 2}", k, [float(x) for x in v[k]]) for k in range(600)], "type string, i long, embedding array<float>")
    exact = {(r.type, r.i, r.j): r.sim for r in align.similar_pairs(rows, 50, 0.85).collect()}
    found = {(r.type, r.i, r.j): r.sim for r in align.similar_pairs(rows, 50, 0.85, 8).collect()}
    assert len(exact) > 500 and set(found) <= set(exact) and all(exact[k] == s for k, s in found.items())
    assert len(found) >= 0.9 * len(exact)


def brute_paths(edges, seed, depth, limit):
    """All trails, then the best."""
    steps = {}
    for eid, h, t, w in edges:
        steps.setdefault(h, []).append((eid, t, w))
        if h != t:
            steps.setdefault(t, []).append((eid, h, w))
    found = []

    def walk(at, eids, score):
        for eid, to, w in steps.get(at, []):
            if eid not in eids and score * w > 0:
                found.append((-(score * w), len(eids) + 1, [*eids, eid]))
                if len(eids) + 1 < depth:
                    walk(to, [*eids, eid], score * w)

    walk(seed, [], 1.0)
    return sorted(found)[:limit]


def test_pruned_paths_are_the_best(spark):
    rng = random.Random(5)
    for _ in range(3):
        raw = [(f"n{rng.randrange(6)}", f"n{rng.randrange(6)}", rng.choice([0.0, 0.5, 0.9, 1.0, 1.0])) for _ in range(12)]
        rows = [(*edge(h, "USES", t, f"2019_{k}", tt="ThreatActor"), w, w > 0.8) for k, (h, t, w) in enumerate(raw)]
        edges = spark.createDataFrame(rows, EDGES + ", trust double, trusted boolean")
        nodes = spark.createDataFrame([node(f"n{k}", canonical=f"n{k}") for k in range(6)], NODES)
        got = traverse.best_paths(traverse.walkable(edges, nodes), spark.createDataFrame([("n0",)], "canonical_id string"), 4, 15)
        got = sorted((-r.path_trust, r.length, r.eids) for r in got.collect())
        ids = [(f"{h}::ThreatActor::USES::{t}::ThreatActor::2019_{k}", h, t, w) for k, (h, t, w) in enumerate(raw)]
        assert got == [(s, n, e) for s, n, e in brute_paths(ids, "n0", 4, 15)]


def test_chains_facts_and_context(spark):
    d = dt.datetime
    rows = [(*edge("A", "USES", "B", "s1", d(2020, 1, 1)), 0.9, True), (*edge("B", "TARGETS", "C", "s2", d(2021, 1, 1), ht="Malware"), 0.8, False), (*edge("A", "HAS_HASH", "C", "s3", None), 0.7, False)]
    edges = spark.createDataFrame(rows, EDGES + ", trust double, trusted boolean").withColumn("tau_raw", F.coalesce(F.col("tau").cast("string"), F.lit("unknown")))
    nodes = spark.createDataFrame([node("A", canonical="A"), node("B", "Malware", "B"), node("C", "Malware", "C")], NODES)
    paths, facts = traverse.traverse(nodes, edges, spark.createDataFrame([("A",)], "canonical_id string"), RetrievalConfig(depth=2))
    chains = traverse.chains(paths).orderBy("position").collect()
    assert chains[0].chain_type == "temporal_causal" and chains[0]["length"] == 2 and chains[1].chain_type == "structural"
    assert [c.rank for c in chains[1:]] == [1, 2, 3, 4]
    keys = [r.fact_key for r in facts.orderBy("fact_rank").collect()]
    assert keys[0] == "A::USES::B::s1" and len(keys) == len(set(keys))
    text, stats = context.build_context("who?", traverse.chains(paths), facts)
    assert text.startswith("=== RETRIEVED GRAPH CONTEXT ===") and "[Temporal & Causal Paths]" in text and "Path 1 (Temporal Causal, Trust=0.72):" in text and text.endswith("[Query]\nwho?\n")
    assert '(ThreatActor: A) --[USES]--> (Malware: B) | Date: 2020-01-01 | Evidence: "ev"' in text and "[Trust=0.90, Conf=1.00, Source=s1, Trusted=YES]" in text
    assert stats["trusted_facts_used"] == 1 and stats["sources"] == ["s1", "s2", "s3"] and stats["facts_included"] == facts.count()
    _, cut = context.build_context("who?", traverse.chains(paths), facts, 20)
    assert cut["facts_included"] == 0 and cut["trusted_facts_used"] == 0


def test_search(spark, tmp_path):
    rows = [("a", "x", "T", "A", [1.0, 0, 0, 0]), ("b", "y", "T", "A", [0.9, 0.4, 0, 0]), ("c", "z", "T", "B", [0, 0, 1.0, 0])]
    index = spark.createDataFrame([(a, b, c, d, [float(x) for x in v]) for a, b, c, d, v in rows], "node_id string, name string, type string, canonical_id string, embedding array<float>")
    got = retrieve.nearest(index, [1.0, 0.0, 0.0, 0.0], 2).collect()
    assert [(r.node_id, r.similarity) for r in got] == [("a", 1.0)]
    assert retrieve.search(index, "  ") is None and retrieve.load_index(spark, str(tmp_path / "none")) is None


def test_question_end_to_end(spark, tmp_path):
    x = extraction(spark, ("2019_1", [("Chafer", "ThreatActor", "Chafer"), ("Remexi", "Malware", "Remexi")], [("Chafer", "uses", "Remexi", "2019-01-30", 0.93)]))
    jobs.ingest(spark, x, str(tmp_path / "none"), str(tmp_path / "v1"), F.lit(T0))
    jobs.ingest(spark, x, str(tmp_path / "v1"), str(tmp_path / "v2"), F.lit(dt.datetime(2024, 1, 1)))
    nodes, edges = tables.read_graph(spark, str(tmp_path / "v2"))
    assert edges.count() == 1 and edges.first().created_at == T0 and nodes.count() == 2
    nodes, edges, _ = jobs.score_align_rescore(nodes, edges, encoder=hashed_ngrams())
    retrieve.build_index(nodes, str(tmp_path / "index"))
    index = retrieve.load_index(spark, str(tmp_path / "index"))
    got = jobs.answer(spark, "What does Chafer use?", nodes, edges, index, chat=lambda m: "<think>x</think>Remexi")
    assert got["answer"] == "Remexi" and "(ThreatActor: Chafer) USES (Malware: Remexi)" in got["context"] and len(got["entities"]) == 2
    assert len(jobs.verify(spark, nodes, edges, index)) == 3


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    x = extraction(spark, ("2019_1", [("A", "Tool", "A")], [("A", "uses", "B", "2019-01-30", 0.9)]))
    y = extraction(spark, ("2019_2", [("A", "Tool", "A")], [("A", "uses", "B", "2020-01-30", 0.9)]))
    for batch in (x, y):
        batch.coalesce(1).write.mode("append").json(str(src))
        upsert_stream(spark, str(src), str(tmp_path / "graph"), str(tmp_path / "ck")).awaitTermination()
    at = current(spark, str(tmp_path / "graph"))
    nodes, edges = tables.read_graph(spark, at)
    assert at.endswith("v000000000001") and edges.count() == 2 and nodes.count() == 2


def test_store(spark):
    df = stored(spark.range(5), "x")
    assert df.count() == 5 and small(df).count() == 5
    release(spark)


def test_small_goes_by_bytes(spark, monkeypatch):
    from veritrail import store

    plan = lambda df: spark.range(9).toDF("k").join(store.small(df), "k")._jdf.queryExecution().toString()
    rows = spark.range(50).selectExpr("id AS k", "repeat('x', 1000) AS t", "array(id) AS a")
    assert "hint" in plan(rows).lower()
    monkeypatch.setattr(store, "MOST_BROADCAST", 40_000)
    assert "hint" not in plan(rows).lower() and "hint" in plan(rows.select("k")).lower()
    assert "hint" in plan(rows.limit(0)).lower()
