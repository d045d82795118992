"""Constants of the knowledge graph. All of them are fixed values that results depend on."""

from __future__ import annotations

import os
from dataclasses import dataclass

ENTITY_TYPES = ("ThreatActor", "Malware", "Tool", "Vulnerability", "Product", "AttackTechnique", "ATT&CKTactic", "Target", "Location", "IOC", "Campaign", "Time", "EvidenceSource")
UNKNOWN_TYPE = "Unknown"
IOC_RELATION_OF = {
    "md5": "has_hash", "sha1": "has_hash", "sha256": "has_hash", "ip-src": "communicates_with", "ip-dst": "communicates_with",
    "url": "uses_domain", "domain": "uses_domain", "hostname": "uses_domain", "filename": "drops_file",
}
SKIPPED_IOC_TYPES = ("comment", "other", "text")
IOC_RELATIONS = ("HAS_HASH", "COMMUNICATES_WITH", "DROPS_FILE", "USES_DOMAIN", "HAS_IOC")
TACTIC_RELATIONS = ("BELONGS_TO_TACTIC", "BELONGS_TO_TECHNIQUE")
TAXONOMY_TYPES = ("AttackTechnique", "ATT&CKTactic")
#: Types of entities that reports, not indicator feeds, speak of.
REPORT_TYPES = ("ThreatActor", "Malware", "Tool", "Vulnerability", "Product", "AttackTechnique", "ATT&CKTactic", "Target", "Location", "Campaign")
ALIGNABLE_TYPES = ("ThreatActor", "Malware", "Tool", "AttackTechnique", "ATT&CKTactic", "Target", "Location", "Campaign")
NOT_INDEXED_TYPES = ("IOC", "EvidenceSource", "Time", "Unknown")
RELATION_PRIORITY = {
    "PRECEDES": 1, "ENABLES": 1, "EVOLVES_TO": 1,
    "EXPLOITS": 2, "USES_VULNERABILITY": 2, "HAS_VULNERABILITY": 2, "BELONGS_TO_TACTIC": 2, "BELONGS_TO_TECHNIQUE": 2,
    "USES": 3, "TARGETS": 3, "TARGETED": 3, "TARGETED_IN": 3, "OBSERVED_IN": 3, "OBSERVES_IN": 3,
    "SAME_AS": 4, "INDICATES": 4, "RELATES_TO": 4,
    "DROPS_FILE": 5, "USES_DOMAIN": 5,
    "COMMUNICATES_WITH": 6, "HAS_HASH": 6, "HAS_IOC": 6,
}
DEFAULT_PRIORITY = 10
ALIASES = {"fancy bear": "APT28", "sofacy": "APT28", "cozy bear": "APT29", "lazarus group": "Lazarus", "ocean lotus": "OceanLotus", "oceanlotus": "OceanLotus"}
#: The public enterprise tactics and their ids.
TACTICS = {
    "TA0043": "Reconnaissance", "TA0042": "Resource Development", "TA0001": "Initial Access", "TA0002": "Execution", "TA0003": "Persistence",
    "TA0004": "Privilege Escalation", "TA0005": "Defense Evasion", "TA0006": "Credential Access", "TA0007": "Discovery", "TA0008": "Lateral Movement",
    "TA0009": "Collection", "TA0011": "Command and Control", "TA0010": "Exfiltration", "TA0040": "Impact",
}
FILE_EXTENSIONS = ("exe", "dll", "pdf", "doc", "docx", "zip", "rar", "bin", "apk", "sh", "py", "vbs", "bat", "cab")

#: Patterns that decide what is read from texts. Java and Python know them alike.
ENTITY_REPR = r"""^\{['"](?:text|canonical_name)['"]\s*:\s*['"]([^'"]+)['"]\}$"""
BARE_HASH = r"^[a-f0-9]{32,64}$"
BARE_ADDRESS = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
BARE_FILE = r"^[a-z0-9_\-\.]+\.(" + "|".join(FILE_EXTENSIONS) + ")$"
THINK_CLOSED = r"(?is)<think>.*?</think>"
THINK_OPEN = r"(?is)<think>.*$"
JSON_FENCED = r"(?is)```(?:json)?\s*(\{.*?\})\s*```"
JSON_OUTER = r"(?s)(\{.*\})"
#: Mistakes in models' JSON, in the order in which they are mended: a range of numbers, a quoted pair, no comma at a line's end, a comma before a bracket.
JSON_RANGE = r":\s*([0-9\.]+)\s*[-–]\s*([0-9\.]+)"
JSON_PAIR = r'"\s*([a-zA-Z_]+)\s*:\s*([0-9\.]+)\s*"'
JSON_LINE = r'("|[0-9\.]+|null|true|false)\s*\n\s*("[a-zA-Z_]+"\s*:)'
JSON_SPARE = r",\s*([}\]])"


def _number(name: str, default: float) -> float:
    return float(os.environ.get(name, default))


@dataclass(frozen=True)
class TrustConfig:
    """Weights of the six factors, the threshold, reliabilities and limits. ``from_env`` reads TRUST_ALPHA etc."""

    alpha: float = 0.25
    beta: float = 0.20
    gamma: float = 0.15
    delta: float = 0.25
    epsilon: float = 0.15
    penalty: float = 0.05
    threshold: float = 0.80
    report: float = 0.80
    indicator: float = 0.65
    cve: float = 0.90
    unknown: float = 0.50
    grace_days: int = 365
    drift_days: int = 180
    contradiction_days: int = 365

    @classmethod
    def from_env(cls) -> TrustConfig:
        names = ("alpha", "beta", "gamma", "delta", "epsilon", "penalty", "threshold")
        return cls(**{n: _number(f"TRUST_{n.upper()}", getattr(cls, n)) for n in names})


@dataclass(frozen=True)
class AlignConfig:
    threshold: float = 0.85
    place_threshold: float = 0.95  # Location and Target
    neighbours: int = 50
    gap_days: int = 730
    planes: int | None = None  # all pairs are compared without them
    tables: int = 16


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 20
    depth: int = 4
    paths: int = 100
    chains: int = 5
    max_tokens: int = 4096
