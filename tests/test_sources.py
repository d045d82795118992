"""Feeds, taxonomy and models over files made here."""

from __future__ import annotations

import json
import zipfile

import numpy as np
import pytest

from veritrail.sources import cves, events, models, tables, taxonomy

EVENT = """<E><Event><id>{id}</id><date>{date}</date><info>{info}</info>{attributes}</Event></E>"""
ATTRIBUTE = "<Attribute><category>C</category><type>{t}</type><value>{v}</value><comment>{c}</comment></Attribute>"


def write_event(path, number, date, info, attributes):
    path.write_text(EVENT.format(id=number, date=date, info=info, attributes="".join(ATTRIBUTE.format(t=t, v=v, c=c) for t, v, c in attributes)))


def test_events_merge_over_files(spark, tmp_path):
    write_event(tmp_path / "a_2019.xml", "1976", "2019-01-30", "Tom &amp; Ann use &lt;X&gt;", [("filename", "&lt;DIR&gt;/e.exe", ""), ("md5", "44D8", "")])
    write_event(tmp_path / "b_2019.xml", "1976", "1970-01-01", "short", [("FILENAME", "&lt;DIR&gt;/e.exe ", "noted"), ("ip-src", "1.2.3.4", "")])
    write_event(tmp_path / "c.xml", "0", "x", " ", [])
    (tmp_path / "empty.xml").write_text("<E/>")
    got = events.merge_events(events.scan_events(spark, str(tmp_path)))
    rows = {r.id: r for r in got.collect()}
    e = rows["2019_1976"]
    assert e.info_title == "Tom & Ann use <X>" and str(e.date) == "2019-01-30" and e.source_files == ["a_2019.xml", "b_2019.xml"]
    assert [(i.type, i.value, i.comment) for i in e.iocs] == [("FILENAME", "<DIR>/e.exe", "noted"), ("md5", "44D8", ""), ("ip-src", "1.2.3.4", "")]
    good, bad = events.validate_events(got)
    assert [r.id for r in good.collect()] == ["2019_1976"]
    assert [(r.record_id, r.reason) for r in bad.collect()] == [("1970_0", "Missing or invalid event_id")]


def test_items_replace_their_attribute(spark, tmp_path):
    nested = "<Attribute><type>x</type><value>outer</value><item><type>md5</type><value>in1</value></item><item><value>in2</value></item><item><value> </value></item></Attribute>"
    (tmp_path / "n.xml").write_text(EVENT.format(id=5, date="2020-01-01", info="t", attributes=nested))
    (row,) = events.scan_events(spark, str(tmp_path)).collect()
    assert [(i.category, i.type, i.value, i.comment) for i in row.iocs] == [("Other", "md5", "in1", ""), ("Other", "other", "in2", "")]
    assert row.year == 1970


def test_last_of_a_file_wins(spark, tmp_path):
    one = EVENT.format(id=5, date="2020-01-01", info="first", attributes="")[3:-4]
    two = EVENT.format(id=5, date="2020-01-02", info="second", attributes="")[3:-4]
    (tmp_path / "x.xml").write_text(f"<E>{one}{two}</E>")
    (row,) = events.scan_events(spark, str(tmp_path)).collect()
    assert row.info_title == "second"


def test_only_whole_files_and_their_own_events_count(spark, tmp_path):
    one = EVENT.format(id=5, date="2020-01-01", info="first", attributes="")[3:-4]
    (tmp_path / "cut.xml").write_text(f"<E>{one}{one[:40]}")
    (tmp_path / "deep.xml").write_text(f"<E><Wrap>{one}</Wrap><Event><id>6</id><date>2020-1-5</date><info>\n own </info><Event><id>7</id></Event></Event></E>")
    (tmp_path / "none.xml").write_text("")
    (tmp_path / "odd.xml").write_text("<E><Event><id>x</id></Event><Event><date>2020-01-01</date></Event><Event><id> -8 </id><date>2020-01-01 junk</date></Event></E>")
    got = {r.event_id: r for r in events.scan_events(spark, str(tmp_path)).collect()}
    assert set(got) == {6, -8} and (str(got[6].date), got[6].info_title) == ("2020-01-05", "own") and str(got[-8].date) == "1970-01-01"


def fold(titles):
    """The rule for titles, written down again."""
    title, date = titles[0]
    for t, d in titles[1:]:
        if t.strip() and (not title.strip() or len(t) > len(title) or (" " in t and " " not in title)):
            title = t
            date = d if d != "1970-01-01" else date
    return title, date


def test_title_rule(spark):
    import itertools

    options = [("", "2020-01-01"), ("longsingleword", "2020-01-02"), ("a b", "2020-01-03"), ("abc", "1970-01-01")]
    cases = list(itertools.product(options, repeat=3))
    rows = [(f"f{k}", 2020, n, d, t, []) for n, case in enumerate(cases) for k, (t, d) in enumerate(case)]
    df = spark.createDataFrame(rows, "file string, year int, event_id long, date string, info_title string, iocs array<struct<category: string, type: string, value: string, comment: string>>").withColumn("date", events.F.to_date("date"))
    got = {r.event_id: (r.info_title, str(r.date)) for r in events.merge_events(df).collect()}
    assert got == {n: fold(list(case)) for n, case in enumerate(cases)}


def cve(number, **cna):
    return {"cveMetadata": {"cveId": number, "datePublished": "2026-08-18T00:00:00Z"}, "containers": {"cna": cna}}


def test_cves(spark, tmp_path):
    v3, v4 = {"cvssV3_1": {"baseScore": 7.7, "baseSeverity": "HIGH", "vectorString": "v"}}, {"cvssV4_0": {"baseScore": 6.5, "baseSeverity": "MEDIUM"}}
    full = cve(
        "CVE-2026-74234", descriptions=[{"lang": "de", "value": "Deutsch"}, {"lang": "en", "value": " English "}], metrics=[v4, v3], datePublic="2026-08-17T00:00:00Z",
        problemTypes=[{"descriptions": [{"description": "text"}, {"cweId": "CWE-95"}]}], references=[{"url": "https://x/"}, {"url": ""}],
        affected=[{"vendor": "Legora", "product": "Legora", "versions": [{"version": "0", "lessThan": "2026-08-14"}, {"version": "1", "lessThan": "2"}, {"version": "3"}, {"version": " "}]}],
    )
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "CVE-a.json").write_text(json.dumps(full))
    (tmp_path / "CVE-b.json").write_text(json.dumps(cve("CVE-2", metrics=[v4], descriptions=[{"lang": "fr", "value": "f"}])))
    (tmp_path / "CVE-c.json").write_text(json.dumps(cve("CVE-3")))
    (tmp_path / "CVE-d.json").write_text("{broken")
    rows = {r.cve_id: r for r in cves.parse_cves(cves.scan_cves(spark, str(tmp_path)), "2024-01-01").collect()}
    a = rows["CVE-2026-74234"]
    assert (a.description, a.cwe_id, a.cwe_description, a.cvss_version, a.cvss_score, a.cvss_severity) == ("English", "CWE-95", "text", "3.1", 7.7, "HIGH")
    assert a.affected_versions == ["<2026-08-14", "1 < 2", "3"] and a.references == ["https://x/"] and str(a.date_public) == "2026-08-17 00:00:00"
    assert (rows["CVE-2"].cvss_version, rows["CVE-2"].cvss_score, rows["CVE-2"].description) == ("4.0", 6.5, "f")
    assert (rows["CVE-3"].cvss_version, rows["CVE-3"].cvss_score, rows["CVE-3"].affected_versions) == ("none", None, [])
    good, bad = cves.validate_cves(cves.latest(cves.parse_cves(cves.scan_cves(spark, str(tmp_path)), "2024-01-01")))
    assert sorted(r.cve_id for r in good.collect()) == ["CVE-2", "CVE-2026-74234"]
    assert sorted(r.reason for r in bad.collect()) == ["Missing or empty cve_id", "Missing or empty description for CVE CVE-3"]


def test_taxonomy(spark, tmp_path):
    assert taxonomy.taxonomy(spark).count() == 14
    (tmp_path / "t.csv").write_text('APT Group Name,Software ID,Group Techniques,Software Techniques\nAPT28,S1;S2,T1059; T1001,T1059\n')
    rows = {(r.term, r.kind) for r in taxonomy.taxonomy(spark, str(tmp_path / "t.csv")).collect()}
    want = {("APT28", "group"), ("S1;S2", "software"), ("T1059", "technique"), ("T1001", "technique"), ("TA0001", "tactic")}
    assert want <= rows and len(rows) == 28 + 4
    cells = "".join(f'<c r="{c}1" t="s"><v>{k}</v></c>' for k, c in enumerate("ABCE"))
    second = '<c r="A2" t="inlineStr"><is><t>APT</t><t>28</t></is></c><c r="B2" t="s"><v>4</v></c><c r="C2" t="str"><v>T1059; T1001</v></c><c r="D2"><v>7</v></c><c r="E2" t="s"><v>5</v></c>'
    strings = "".join(f"<si><t>{x}</t></si>" for x in ("APT Group Name", "Software ID", "Group Techniques", "Software Techniques")) + "<si><r><t>S1;</t></r><r><t>S2</t></r></si><si><t>T1059</t></si>"
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {space}>{strings}</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row r="1">{cells}</row><row r="2">{second}</row><row r="3"/></sheetData></worksheet>')
    assert {(r.term, r.kind) for r in taxonomy.taxonomy(spark, str(tmp_path / "t.xlsx")).collect()} == rows
    assert taxonomy.taxonomy(spark, str(tmp_path / "none.xlsx")).count() == 14


def test_models(spark):
    e = models.hashed_ngrams(64)
    v = e(["APT28", "APT28", ""])
    assert v.shape == (3, 64) and np.allclose(np.linalg.norm(v, axis=1), 1) and (v[0] == v[1]).all() and e([]).shape == (0, 64)
    df = spark.createDataFrame([("a",), (None,)], "p string")
    assert models.embed(df, "p", e).select("embedding").first()[0] is not None
    asked = []

    def chat(messages):
        asked.append(len(messages))
        return "{}" if len(messages) > 1 else "no"

    assert models.respond(df, "p", chat, check=lambda x: x.startswith("{")).where("p = 'a'").first().raw_response == "{}"


def test_models_that_fail(spark):
    df = spark.createDataFrame([("key",), ("once",), ("json",), ("never",), (None,)], "p string")

    def chat(messages):
        said = messages[0]["content"]
        if said == "key" or (said == "once" and not calls.append(1) and len(calls) == 1):
            raise KeyError("message")
        return "no object" if said == "never" or len(messages) == 1 and said == "json" else '{"a": 1}'

    calls = []
    from veritrail.functions.text import find_object

    got = {r.p: r.raw_response for r in models.respond(df.coalesce(1), "p", chat, check=lambda x: find_object(x) is not None).collect()}
    assert got == {"key": None, "once": '{"a": 1}', "json": '{"a": 1}', "never": "no object", None: None}


def test_a_file_for_each_record(spark, tmp_path):
    rows = spark.createDataFrame([("2019_7", "é", [1, 2]), ("CVE-1/x", None, []), (None, "no name", [])], "id string, t string, a array<int>")
    assert tables.write_files(rows, "id", f"file://{tmp_path}/out") == 2
    assert json.loads((tmp_path / "out" / "2019_7.json").read_text()) == {"id": "2019_7", "t": "é", "a": [1, 2]}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["2019_7.json", "CVE-1%2Fx.json"]


def test_keys_are_checked_if_asked(spark, tmp_path):
    nodes = spark.createDataFrame([("A", "Tool"), ("A", "Tool")], "name string, type string")
    edges = spark.createDataFrame([("R", "A")], "rel_type string, head_name string")
    with pytest.raises(ValueError, match="not unique"):
        tables.write_graph(nodes, edges, str(tmp_path / "g"), check=True)
    tables.write_graph(nodes.distinct(), edges, str(tmp_path / "g"), check=True)
    assert spark.read.parquet(str(tmp_path / "g" / "nodes")).count() == 1


def test_records(spark, tmp_path):
    (tmp_path / "2019_7.json").write_text(json.dumps({"entities": [], "relations": []}))
    x = tables.read_extractions(spark, str(tmp_path))
    assert [r.id for r in x.collect()] == ["2019_7"]
    assert tables.find_by_id(x, "id", "7").count() == 1 and tables.find_by_id(x, "id", "9").count() == 0
    log = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "entity_a string, timestamp string")
    tables.log_decisions(log, str(tmp_path / "log"))
    tables.log_decisions(log.where("entity_a = 'a'"), str(tmp_path / "log"))
    assert [r.entity_a for r in tables.last_decisions(spark, str(tmp_path / "log"), 1).collect()] == ["b"]
