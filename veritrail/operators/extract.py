"""Facts from records: entities and relations with their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import IOC_RELATION_OF, SKIPPED_IOC_TYPES
from ..functions.cve import product_name
from ..functions.text import blank, clean_entity_text, extract_json, is_narrative, snippet
from ..functions.trust import parse_confidence
from ..schemas import ENTITIES, LLM_RESPONSE, RELATIONS

PROMPT = "List the entities and relations that this report title states, as JSON with arrays entities (text, canonical_name, type, confidence) and relations (head, relation, tail, time, evidence, confidence).\nTitle: "


def ioc_relation(kind: Column) -> Column:
    """Relation of an indicator type, case ignored; null for types that say nothing."""
    known = F.create_map(*(F.lit(x) for kv in IOC_RELATION_OF.items() for x in kv))
    low = F.lower(kind)
    return F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, _: k == low)), 0), F.when(~low.isin(*SKIPPED_IOC_TYPES), "has_ioc"))


def _entity(text: Column, kind: Column, confidence: Column) -> Column:
    return F.struct(text.alias("text"), kind.alias("type"), text.alias("canonical_name"), confidence.alias("confidence"))


def extract_iocs(events: DataFrame) -> DataFrame:
    """``EXTRACTION`` rows of events: an entity for each different indicator, after the event's source if it has any indicator; a relation for each.

    Works on each event's own array: no shuffle.
    """
    one = F.lit(1.0)
    head = F.when(~blank(F.col("info_title")), F.trim("info_title")).otherwise(F.concat(F.lit("Event_"), F.col("id")))
    told = F.filter("iocs", lambda i: ioc_relation(i.type).isNotNull())
    found = F.transform(told, lambda i: _entity(i.value, F.lit("IOC"), one))
    relations = F.transform(
        told,
        lambda i: F.struct(
            head.alias("head"), ioc_relation(i.type).alias("relation"), i.value.alias("tail"), F.col("date").cast("string").alias("time"),
            F.concat(F.lit("IOC of type "), i.type, F.lit(" found in event "), F.col("id")).alias("evidence"), one.alias("confidence"),
        ),
    )
    source = F.when(F.size("iocs") > 0, F.array(_entity(head, F.lit("EvidenceSource"), one))).otherwise(F.array().cast(ENTITIES))
    return events.select("id", F.concat(source, F.array_distinct(found)).cast(ENTITIES).alias("entities"), relations.cast(RELATIONS).alias("relations"))


def extract_cves(cves: DataFrame) -> DataFrame:
    """``EXTRACTION`` rows of CVE records: product, vulnerability and the relation between them."""
    product = product_name(F.col("affected_vendor"), F.col("affected_product"), F.col("cve_id"))
    one = F.lit(1.0)
    evidence = F.when(~blank(F.col("description")), snippet(F.col("description"))).otherwise(F.concat(F.lit("Vulnerability "), F.col("cve_id")))
    relation = F.struct(
        product.alias("head"), F.lit("has_vulnerability").alias("relation"), F.col("cve_id").alias("tail"),
        F.to_date(F.coalesce("date_public", "date_published")).cast("string").alias("time"), evidence.alias("evidence"), one.alias("confidence"),
    )
    entities = F.array(_entity(product, F.lit("Product"), one), _entity(F.col("cve_id"), F.lit("Vulnerability"), one))
    return cves.select(F.col("cve_id").alias("id"), entities.cast(ENTITIES).alias("entities"), F.array(relation).cast(RELATIONS).alias("relations"))


def prompts(events: DataFrame) -> DataFrame:
    """id, date and prompt of events whose title tells something."""
    return events.where(is_narrative(F.col("info_title"))).select("id", "date", F.concat(F.lit(PROMPT), F.col("info_title")).alias("prompt"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """``EXTRACTION`` rows of answers: id, date, raw_response. Nothing is extracted where no object is found."""
    r = responses.select("id", "date", extract_json(F.col("raw_response"), LLM_RESPONSE).alias("r"))
    none = F.array()

    def entity(e: Column) -> Column:
        text = clean_entity_text(e.text)
        name = clean_entity_text(e.canonical_name)
        return F.struct(text.alias("text"), F.coalesce(F.nullif(F.trim(e.type), F.lit("")), F.lit("Unknown")).alias("type"), F.coalesce(F.nullif(name, F.lit("")), text).alias("canonical_name"), parse_confidence(e.confidence, 0.85).alias("confidence"))

    def relation(x: Column) -> Column:
        time = F.when(x.time.isNull() | F.trim(x.time).isin("null", "None", ""), F.col("date").cast("string")).otherwise(F.trim(x.time))
        return F.struct(
            clean_entity_text(x.head).alias("head"), F.coalesce(F.nullif(F.trim(x.relation), F.lit("")), F.lit("relates_to")).alias("relation"),
            clean_entity_text(x.tail).alias("tail"), time.alias("time"), F.coalesce(x.evidence, F.lit("")).alias("evidence"), parse_confidence(x.confidence, 0.85).alias("confidence"),
        )

    entities = F.filter(F.transform("r.entities", entity), lambda e: e.text != "")
    relations = F.filter(F.transform("r.relations", relation), lambda x: (x.head != "") & (x.tail != ""))
    return r.select("id", F.coalesce(entities, none.cast(ENTITIES)).alias("entities"), F.coalesce(relations, none.cast(RELATIONS)).alias("relations"))


def combine(first: DataFrame, second: DataFrame) -> DataFrame:
    """Entities and relations of both, the first one's before the second's."""
    a, b = first.toDF("id", "e1", "r1"), second.toDF("id", "e2", "r2")
    none = F.array()
    return a.join(b, "id", "full_outer").select("id", *(F.concat(*(F.coalesce(f"{c}{k}", none.cast(kind)) for k in (1, 2))).alias(n) for c, n, kind in (("e", "entities", ENTITIES), ("r", "relations", RELATIONS))))


def summary(extractions: DataFrame) -> DataFrame:
    return extractions.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("entities"), F.coalesce(F.sum(F.size("relations")), F.lit(0)).alias("relations"))


def confidence_summary(extractions: DataFrame) -> DataFrame:
    """Number, minimum, maximum and mean of relations' confidences."""
    c = F.col("c")
    return extractions.select(F.explode("relations.confidence").alias("c")).agg(F.count(c).alias("n"), F.min(c).alias("lowest"), F.max(c).alias("highest"), F.round(F.avg(c), 6).alias("mean"))


def confidence_histogram(extractions: DataFrame) -> DataFrame:
    r = extractions.select(F.explode("relations.confidence").alias("c"))
    return r.groupBy(F.round("c", 2).alias("confidence")).agg(F.count("*").alias("n"))
