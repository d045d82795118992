"""Schemas of the feeds and of the graph, as DDL text."""

from __future__ import annotations

_LEAF = "category: STRING, comment: STRING, type: STRING, value: STRING"
EVENT_XML = f"id STRING, date STRING, info STRING, Attribute ARRAY<STRUCT<{_LEAF}, item: ARRAY<STRUCT<{_LEAF}>>>>"
_CVSS = "STRUCT<baseScore: DOUBLE, baseSeverity: STRING, vectorString: STRING>"
CVE_JSON = (
    "cveMetadata STRUCT<cveId: STRING, datePublished: STRING, dateReserved: STRING>, "
    "containers STRUCT<cna: STRUCT<title: STRING, datePublic: STRING, descriptions: ARRAY<STRUCT<lang: STRING, value: STRING>>, "
    "problemTypes: ARRAY<STRUCT<descriptions: ARRAY<STRUCT<cweId: STRING, description: STRING>>>>, "
    "affected: ARRAY<STRUCT<vendor: STRING, product: STRING, versions: ARRAY<STRUCT<version: STRING, lessThan: STRING>>>>, "
    f"metrics: ARRAY<STRUCT<cvssV3_1: {_CVSS}, cvssV4_0: {_CVSS}>>, references: ARRAY<STRUCT<url: STRING>>>>"
)
IOCS = "ARRAY<STRUCT<category: STRING, type: STRING, value: STRING, comment: STRING>>"
ENTITIES = "ARRAY<STRUCT<text: STRING, type: STRING, canonical_name: STRING, confidence: DOUBLE>>"
RELATIONS = "ARRAY<STRUCT<head: STRING, relation: STRING, tail: STRING, time: STRING, evidence: STRING, confidence: DOUBLE>>"
EXTRACTION = f"id STRING, entities {ENTITIES}, relations {RELATIONS}"
EVENTS = f"id STRING, year INT, event_id BIGINT, date DATE, info_title STRING, iocs {IOCS}, source_files ARRAY<STRING>"
NODES = "name STRING, type STRING, raw_text STRING, canonical_id STRING, first_seen TIMESTAMP, last_seen TIMESTAMP"
EDGES = (
    "head_name STRING, head_type STRING, rel_type STRING, tail_name STRING, tail_type STRING, source STRING, "
    "tau TIMESTAMP, tau_raw STRING, tau_precision STRING, evidence STRING, confidence DOUBLE, created_at TIMESTAMP"
)
LLM_RESPONSE = (
    "entities ARRAY<STRUCT<text: STRING, canonical_name: STRING, type: STRING, confidence: STRING>>, "
    "relations ARRAY<STRUCT<head: STRING, relation: STRING, tail: STRING, time: STRING, evidence: STRING, confidence: STRING>>"
)
