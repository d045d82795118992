"""The command line over files made here."""

from __future__ import annotations

import json

from veritrail import cli
from veritrail.schemas import EXTRACTION
from veritrail.sources import tables


def test_jobs_by_hand(spark, tmp_path, capsys):
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "a_2019.xml").write_text("<E><Event><id>7</id><date>2019-01-30</date><info>Chafer used it</info><Attribute><type>md5</type><value>h</value></Attribute></Event></E>")
    (tmp_path / "cve").mkdir()
    (tmp_path / "cve" / "CVE-1.json").write_text(json.dumps({"cveMetadata": {"cveId": "CVE-2024-1"}, "containers": {"cna": {"descriptions": [{"lang": "en", "value": "d"}], "affected": [{"vendor": "V", "product": "P"}]}}}))
    at = lambda x: str(tmp_path / x)
    run = lambda *a: cli.main(list(a), spark)
    run("normalize", "--events", at("xml"), "--cves", at("cve"), "--out", at("data"), "--run-at", "2024-01-01")
    run("extract", "--data", at("data"), "--out", at("facts"))
    run("ingest", "--facts", at("facts"), "--graph", at("none"), "--out", at("g1"))
    run("score", "--graph", at("g1"), "--out", at("g2"))
    run("align", "--graph", at("g2"), "--out", at("g3"), "--log", at("log"))
    run("score", "--graph", at("g3"), "--out", at("g4"), "--force")
    run("verify", "--graph", at("g4"))
    run("index", "--graph", at("g4"), "--out", at("index"))
    run("query", "--graph", at("g4"), "--index", at("index"), "--text", "What is wrong with P?")
    run("questions", "--graph", at("g4"), "--index", at("index"))
    said = capsys.readouterr().out
    assert said.count("paths_used: ") == 3
    assert "HAS_VULNERABILITY" in said and "=== RETRIEVED GRAPH CONTEXT ===" in said
    nodes, edges = tables.read_graph(spark, at("g4"))
    assert edges.where("trust IS NULL").count() == 0 and nodes.where("canonical_id IS NULL").count() == 0
    assert spark.read.schema(EXTRACTION).parquet(at("facts")).count() == 2
    run("extract", "--data", at("data"), "--event", "7")
    run("extract", "--data", at("data"), "--cve", "CVE-2024-1", "--out", at("one"))
    run("extract", "--data", at("data"), "--event", "none")
    one, two, none = capsys.readouterr().out.strip().split("\n")
    assert json.loads(one)["id"] == "2019_7" and json.loads(two)["relations"][0]["tail"] == "CVE-2024-1" and none == "no such record"
    assert spark.read.parquet(at("one")).count() == 1


def test_a_sample_is_scored_and_all_edges_stay(spark, tmp_path, capsys):
    at = lambda x: str(tmp_path / x)
    facts = [("2019_1", [], [(f"H{k}", "uses", "M", "2019-01-30", "", 0.9) for k in range(6)])]
    spark.createDataFrame(facts, EXTRACTION).write.parquet(at("facts"))
    run = lambda *a: cli.main(list(a), spark)
    run("ingest", "--facts", at("facts"), "--graph", at("none"), "--out", at("g1"))
    run("score", "--graph", at("g1"), "--out", at("g2"), "--sample", "2")
    run("score", "--graph", at("g2"), "--out", at("g3"), "--sample", "3")
    counts = [(e.count(), e.where("trust IS NOT NULL").count()) for e in (tables.read_graph(spark, at(g))[1] for g in ("g2", "g3"))]
    assert counts == [(6, 2), (6, 5)]
    run("align", "--graph", at("g3"), "--out", at("g4"), "--type", "Malware", "--names-only")
    assert tables.read_graph(spark, at("g4"))[0].where("canonical_id IS NULL").count() == 0


def test_one_feed_is_enough(spark, tmp_path, capsys):
    at = lambda x: str(tmp_path / x)
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "a_2019.xml").write_text("<E><Event><id>7</id><date>2019-01-30</date><info>t x y</info></Event></E>")
    cli.main(["normalize", "--events", at("xml"), "--out", at("data"), "--run-at", "2024-01-01"], spark)
    cli.main(["extract", "--data", at("data"), "--out", at("facts")], spark)
    assert "records: 1" in capsys.readouterr().out
