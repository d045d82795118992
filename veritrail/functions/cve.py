"""Fields of CVE 5.x records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank


def _first(c: Column) -> Column:
    return F.get(c, 0)


def description(descriptions: Column) -> Column:
    """English text if there is one that is not blank, else the first."""
    english = F.filter(descriptions, lambda d: (d.lang == "en") & ~blank(d.value))
    return F.trim(F.coalesce(_first(english).value, _first(descriptions).value))


def first_filled(items: Column, field: str) -> Column:
    """First non-empty value of a field, whatever the others are."""
    return _first(F.filter(F.transform(items, lambda x: x[field]), lambda v: v.isNotNull() & (v != "")))


def weaknesses(problem_types: Column) -> Column:
    return F.flatten(F.filter(F.transform(problem_types, lambda p: p.descriptions), lambda d: d.isNotNull()))


def versions(affected: Column) -> Column:
    """Versions and ranges below a limit, blank ones dropped."""
    flat = F.flatten(F.filter(F.transform(affected, lambda a: a.versions), lambda v: v.isNotNull()))
    named = F.transform(flat, lambda v: F.when(v.lessThan.isNotNull() & (v.lessThan != ""), F.when(F.coalesce(v.version, F.lit("")).isin("0", ""), F.concat(F.lit("<"), v.lessThan)).otherwise(F.concat(v.version, F.lit(" < "), v.lessThan))).otherwise(v.version))
    return F.coalesce(F.filter(named, lambda x: ~blank(x)), F.array().cast("array<string>"))


def cvss(metrics: Column) -> Column:
    """Struct of version, score, severity and vector: the first 3.1 metric, else the first 4.0 one."""
    v3 = _first(F.filter(metrics, lambda m: m.cvssV3_1.isNotNull())).cvssV3_1
    v4 = _first(F.filter(metrics, lambda m: m.cvssV4_0.isNotNull())).cvssV4_0
    pick = F.coalesce(v3, v4)
    version = F.when(v3.isNotNull(), "3.1").when(v4.isNotNull(), "4.0").otherwise("none")
    return F.struct(version.alias("version"), pick.baseScore.alias("score"), pick.baseSeverity.alias("severity"), pick.vectorString.alias("vector"))


def references(refs: Column) -> Column:
    return F.coalesce(F.filter(F.transform(refs, lambda r: r.url), lambda u: u.isNotNull() & (u != "")), F.array().cast("array<string>"))


def product_name(vendor: Column, product: Column, cve_id: Column) -> Column:
    """The product if it names the vendor too, vendor and product, whichever there is, or the CVE's id."""
    v, p = F.when(~blank(vendor), F.trim(vendor)), F.when(~blank(product), F.trim(product))
    return F.when(F.lower(v) == F.lower(p), p).when(v.isNotNull() & p.isNotNull(), F.concat_ws(" ", v, p)).otherwise(F.coalesce(p, v, cve_id))
