"""Partial-precision times and date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_temporal(c: Column) -> Column:
    """Struct of tau, tau_raw and tau_precision (day, month, year or unknown). The time of day is dropped; impossible dates have no tau."""
    t = F.trim(c)
    missing = c.isNull() | F.lower(t).isin("", "unknown", "null", "none")

    def at(pattern: str, text: Column, precision: str, ok: Column | None = None) -> Column:
        day = F.try_to_date(text, "yyyy-MM-dd")
        good = day.isNotNull() if ok is None else day.isNotNull() & ok
        return F.when(t.rlike(pattern), F.struct(F.when(good, day.cast("timestamp")).alias("tau"), t.alias("tau_raw"), F.when(good, precision).otherwise("unknown").alias("tau_precision")))

    none = F.lit(None).cast("timestamp").alias("tau")
    # years 1970 to 2100 only
    return F.coalesce(
        F.when(missing, F.struct(none, F.lit("unknown").alias("tau_raw"), F.lit("unknown").alias("tau_precision"))),
        at(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T.*)?$", F.substring(t, 1, 10), "day"),
        at(r"^[0-9]{4}-[0-9]{2}$", F.concat(t, F.lit("-01")), "month"),
        at(r"^[0-9]{4}$", F.concat(t, F.lit("-01-01")), "year", F.substring(t, 1, 4).between("1970", "2100")),
        F.struct(none, t.alias("tau_raw"), F.lit("unknown").alias("tau_precision")),
    )


def parse_date(c: Column) -> Column:
    """Date of the first ten characters, or null."""
    return F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd")


def parse_instant(c: Column) -> Column:
    """Timestamp of ISO text, with Z for UTC; else its date; else null."""
    return F.coalesce(F.try_to_timestamp(c), parse_date(c).cast("timestamp"))


def gap_days(first_a: Column, last_a: Column, first_b: Column, last_b: Column) -> Column:
    """Days between two spans, not positive where they overlap; null if a first is missing. A missing last is the first."""
    return F.greatest(F.datediff(first_b, F.coalesce(last_a, first_a)), F.datediff(first_a, F.coalesce(last_b, first_b)))


def overlap(first_a: Column, last_a: Column, first_b: Column, last_b: Column, limit: int = 730) -> Column:
    """Struct of ok and reason."""
    gap = gap_days(first_a, last_a, first_b, last_b)
    missing = first_a.isNull() | first_b.isNull()
    reason = (
        F.when(missing, "No timeline constraint (missing dates)")
        .when(gap > limit, F.concat(F.lit("Temporal gap of "), gap.cast("string"), F.lit(f" days exceeds limit ({limit} days)")))
        .otherwise("Temporal overlap/gap within 730 days")
    )
    return F.struct((missing | (gap <= limit)).alias("ok"), reason.alias("reason"))
