"""Scalar functions against stated values."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veritrail.config import TrustConfig
from veritrail.functions import cve as C
from veritrail.functions import text as X
from veritrail.functions import time as Time
from veritrail.functions import trust as S
from veritrail.functions import vector as V
from veritrail.schemas import LLM_RESPONSE


def apply(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_confidence(spark):
    assert apply(spark, [".95", "0.85", "0.7-0.8", "0.7 – 0.8", "invalid", None, "1.7", "1.2.3-4"], S.parse_confidence) == [0.95, 0.85, 0.75, 0.75, 0.8, 0.8, 1.0, 0.8]


def test_relations(spark):
    given = ["has_hash", "uses", "communicates_with", "drops-file", "spies on", "", None, "123_rel"]
    assert apply(spark, given, X.clean_relation) == ["HAS_HASH", "USES", "COMMUNICATES_WITH", "DROPS_FILE", "SPIES_ON", "RELATES_TO", "RELATES_TO", "REL_123_REL"]


def test_temporal(spark):
    given = ["2019-01-30", "2018-05", "2018", "unknown", None, "2019-02-30", "1969", "2019-01-30T12:00", "2018-05-01 10:00", ""]
    got = [(r.tau, r.tau_raw, r.tau_precision) for r in apply(spark, given, Time.parse_temporal)]
    day = dt.datetime(2019, 1, 30)
    assert got == [
        (day, "2019-01-30", "day"), (dt.datetime(2018, 5, 1), "2018-05", "month"), (dt.datetime(2018, 1, 1), "2018", "year"), (None, "unknown", "unknown"), (None, "unknown", "unknown"),
        (None, "2019-02-30", "unknown"), (None, "1969", "unknown"), (day, "2019-01-30T12:00", "day"), (None, "2018-05-01 10:00", "unknown"), (None, "unknown", "unknown"),
    ]


def test_names(spark):
    assert apply(spark, ["APT-28", "Cobalt Strike...", "  Fancy   Bear_v2 ", "", None, "Привет"], X.normalize_name) == ["apt 28", "cobalt strike", "fancy bear v2", "", "", ""]


def test_entity_text(spark):
    assert apply(spark, ["{'text': ' APT28 '}", " x ", '{"canonical_name": "Y"}', None, "{'other': 'z'}"], X.clean_entity_text) == ["APT28", "x", "Y", "", "{'other': 'z'}"]


def test_narrative(spark):
    given = ["1234567890abcdef.exe", "44d88612fea8a8f36de82e1278abb02f", "10.1.2.3:80 seen", "Chafer used Remexi malware", "invoice.pdf opened by user", "", "Report"]
    assert apply(spark, given, X.is_narrative) == [False, False, False, True, True, True, True]


def test_tokens(spark):
    assert apply(spark, ["a b c", "", None, " one\ntwo\t three  four "], X.token_count) == [3, 0, 0, 5]


def test_think(spark):
    assert apply(spark, ["<think>a\nb</think>```json\n{}```", "x <THINK>open", None], X.strip_think) == ["```json\n{}```", "x", ""]


@pytest.mark.parametrize(
    "raw",
    [
        '{"entities": [{"text": "A", "confidence": 0.7}]}',
        'Sure!\n```json\n{"entities": [{"text": "A", "confidence": 0.6-0.8}]}\n```',
        'It is {"entities": [{"text": "A", "confidence": 0.7,},]} there',
        '<think>{"entities": []}</think>{"entities": [{"text": "A"\n"confidence": 0.7}]}',
        'so {"entities": [{"text": "A", "confidence: 0.7"}]}',
    ],
)
def test_json(spark, raw):
    (got,) = apply(spark, [raw], lambda c: X.extract_json(c, LLM_RESPONSE))
    assert got.entities[0].text == "A" and float(got.entities[0].confidence) == 0.7


def test_no_json(spark):
    assert apply(spark, ["none", "[1]", None, "{broken"], lambda c: X.extract_json(c, LLM_RESPONSE)) == [None] * 4


def test_mended():
    assert X.mended('{"a": 0.5 - 0.6, "b": 1.2.3-4}') == '{"a": 0.55, "b": 1.2.3-4}'
    assert X.mended('{"a": true\n"b": 1\n"c": "x"\n"d": [1,\n]}') == '{"a": true,\n"b": 1,\n"c": "x",\n"d": [1]}'
    assert X.mended('["el"\n"x y": 1') == '["el"\n"x y": 1' and X.mended('{"score: 0.5"}') == '{"score": 0.5}'
    assert X.find_object("[1]") is None and X.find_object(None) is None and X.find_object('x {"a": [1,]} y') == {"a": [1]} and X.find_object("[" * 10**5) is None


def test_clamped(spark):
    assert apply(spark, [0.85, 1.0, 0.0, None, 1.5, -0.2], S.llm_confidence, "double") == [0.85, 1.0, 0.0, 1.0, 1.0, 0.0]


def test_reliability(spark):
    rows = [("CVE-2021-44228", "USES", "x", "y"), ("2018_1976", "HAS_HASH", "IOC", "IOC"), ("2019_100", "COMMUNICATES_WITH", "IOC", "x"), ("2018_1976", "USES", "ThreatActor", "Malware"), ("2017_500", "EXPLOITS", "Malware", "x"), ("", "USES", "x", "y"), ("unknown_feed", "USES", "x", "y"), (None, "USES", "x", "y"), ("Cve-1", "USES", "x", "y"), ("2018_1", "USES", "Unknown", "Unknown")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, r string, h string, t string")
    got = [r[0] for r in df.orderBy("i").select(S.source_reliability(F.col("s"), F.col("r"), F.col("h"), F.col("t"))).collect()]
    assert got == [0.9, 0.65, 0.65, 0.8, 0.8, 0.5, 0.5, 0.5, 0.5, 0.65]


def test_similarity(spark):
    rows = [("USES", "AttackTechnique", "x", 0.5, 1.0), ("BELONGS_TO_TACTIC", "Unknown", "Unknown", 0.0, 0.0), ("HAS_HASH", "IOC", "IOC", 0.0, 0.0), ("TARGETS", "x", "y", 0.0, 0.0), ("USES", "x", "ATT&CKTactic", 1.0, 0.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r string, h string, t string, a double, b double")
    got = [r[0] for r in df.orderBy("i").select(S.taxonomy_similarity(F.col("r"), F.col("h"), F.col("t"), F.col("a"), F.col("b"))).collect()]
    assert got == [0.5, 0.9, 0.3, 0.5, 0.0]


def test_support(spark):
    assert apply(spark, [1, 2, 3, 10], S.cross_source, "int") == [0.3, 0.6, 1.0, 1.0]
    assert apply(spark, [True, False], S.contradiction_penalty, "boolean") == [0.5, 0.0]


def test_consistency(spark):
    d = dt.date
    a, b = d(2016, 1, 1), d(2018, 1, 1)
    rows = [(None, "x", a, b), (d(2017, 1, 1), "IOC", a, a), (a, "IOC", a, a), (d(2017, 6, 1), "ThreatActor", a, b), (d(2018, 6, 1), "ThreatActor", a, b), (d(2019, 3, 1), "ThreatActor", a, b), (d(2021, 1, 1), "ThreatActor", a, b), (a, "x", None, b)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t date, h string, a date, b date")
    got = [r[0] for r in df.orderBy("i").select(S.temporal_consistency(F.col("t"), F.col("h"), F.col("a"), F.col("b"))).collect()]
    assert got == [0.5, 0.5, 1.0, 1.0, 1.0, 0.7, 0.3, 1.0]


def test_trust(spark):
    rows = [(1, 0.8, 1, 0.6, 1, 0), (1, 0.8, 1, 0.6, 1, 0.5), (1, 0.65, 0.3, 0.3, 1, 0), (1, 0.9, 0.5, 1, 1, 0)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, a double, b double, c double, d double, e double, f double")
    value, ok = S.trust(*(F.col(c) for c in "abcdef"), TrustConfig())
    got = [tuple(r) for r in df.orderBy("i").select(value, ok).collect()]
    assert got == [(0.86, True), (0.835, True), (0.65, False), (0.905, True)]


def test_overlap(spark):
    d = dt.date
    rows = [(d(2020, 1, 1), d(2021, 1, 1), d(2021, 1, 1), d(2022, 1, 1)), (d(2020, 1, 1), d(2021, 1, 1), d(2025, 1, 1), None), (None, None, d(2020, 1, 1), None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a date, b date, c date, d date")
    got = [r[0] for r in df.orderBy("i").select(Time.overlap(*(F.col(c) for c in "abcd"))).collect()]
    assert [r.ok for r in got] == [True, False, True]
    assert got[1].reason == "Temporal gap of 1461 days exceeds limit (730 days)" and "missing dates" in got[2].reason


def test_dates(spark):
    assert apply(spark, ["2021-05-18", "2018-09-13T00:00:00Z", None, "unknown"], Time.parse_date) == [dt.date(2021, 5, 18), dt.date(2018, 9, 13), None, None]
    assert apply(spark, ["2021-05-18T10:00:00Z", "2021-05-18", "x"], Time.parse_instant) == [dt.datetime(2021, 5, 18, 10), dt.datetime(2021, 5, 18), None]


def test_vectors(spark):
    (u,) = apply(spark, [[3.0, 4.0]], V.unit, "array<float>")
    assert [round(x, 6) for x in u] == [0.6, 0.8]
    assert apply(spark, [[0.0, 0.0]], V.unit, "array<float>") == [[0.0, 0.0]]


def test_product_names(spark):
    df = spark.createDataFrame([(0, "Legora", "legora"), (1, "A", "B"), (2, None, "B"), (3, " ", None)], "i int, v string, p string")
    assert [r[0] for r in df.orderBy("i").select(C.product_name(F.col("v"), F.col("p"), F.lit("CVE-1"))).collect()] == ["legora", "A B", "B", "CVE-1"]


def test_title_label(spark):
    assert apply(spark, ["temporal_causal", "structural"], X.title_label) == ["Temporal Causal", "Structural"]
