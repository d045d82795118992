"""CVE 5.x records in JSON: scan, fields, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cve as C
from ..functions.text import blank
from ..functions.time import parse_instant
from ..schemas import CVE_JSON
from .events import split_rejected


def scan_cves(spark: SparkSession, path: str, glob: str = "CVE-*.json") -> DataFrame:
    """file and raw record of each JSON file below a path; of any ``*.json`` if none has a CVE's name. An unreadable file is a row of nulls."""
    for pattern in (glob, "*.json"):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
        if not found.select("path").isEmpty():
            break
    text = F.decode("content", "utf-8")
    return found.select(F.col("path").alias("file"), F.from_json(text, CVE_JSON).alias("r"))


def parse_cves(raw: DataFrame, run_at: str) -> DataFrame:
    """Normalised records. ``run_at``: the time that stands in where a record has no date."""
    cna = F.col("r.containers.cna")
    w = C.weaknesses(cna.problemTypes)
    score = C.cvss(cna.metrics)
    return raw.select(
        "file", F.trim("r.cveMetadata.cveId").alias("cve_id"),
        F.coalesce(parse_instant(F.col("r.cveMetadata.datePublished")), parse_instant(F.col("r.cveMetadata.dateReserved")), F.lit(run_at).cast("timestamp")).alias("date_published"),
        parse_instant(cna.datePublic).alias("date_public"), cna.title.alias("title"), C.description(cna.descriptions).alias("description"),
        C.first_filled(w, "cweId").alias("cwe_id"), C.first_filled(w, "description").alias("cwe_description"),
        C.first_filled(cna.affected, "vendor").alias("affected_vendor"), C.first_filled(cna.affected, "product").alias("affected_product"),
        C.versions(cna.affected).alias("affected_versions"), score.score.alias("cvss_score"), score.severity.alias("cvss_severity"),
        score.vector.alias("cvss_vector"), score.version.alias("cvss_version"), C.references(cna.references).alias("references"),
    )


def latest(cves: DataFrame) -> DataFrame:
    """One record for each cve_id: of the last file by name."""
    columns = [c for c in cves.columns if c not in ("file", "cve_id")]
    return cves.groupBy("cve_id").agg(F.max_by(F.struct(*columns), "file").alias("r")).select("cve_id", "r.*")


def validate_cves(cves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and rejections with the first reason that holds."""
    reason = (
        F.when(blank(F.col("cve_id")), "Missing or empty cve_id")
        .when(blank(F.col("description")), F.concat(F.lit("Missing or empty description for CVE "), F.col("cve_id")))
    )
    return split_rejected(cves, reason, "cve_id", "cve")
