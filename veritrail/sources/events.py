"""Event reports in XML: scan, merge over files, validation."""

from __future__ import annotations

import io
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank, strip
from ..functions.time import parse_date
from ..schemas import EVENT_XML, IOCS

EPOCH = "1970-01-01"
REJECTED = ["record_id", "record_type", "reason", "payload"]


def file_year(name: Column) -> Column:
    """First four digits of a file name, or 1970."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"([0-9]{4})", 1), F.lit("")), F.lit("1970")).cast("int")


def attributes(c: Column) -> Column:
    """Leaf attributes: an attribute's items in its place if there are any. Trimmed, with defaults, those without value dropped."""
    leaves = F.flatten(F.transform(c, lambda a: F.when(F.size(a.item) > 0, a.item).otherwise(F.array(F.struct(a.category, a.comment, a.type, a.value)))))

    def or_else(x: Column, default: str) -> Column:
        return F.coalesce(F.nullif(strip(x), F.lit("")), F.lit(default))

    named = F.transform(leaves, lambda a: F.struct(or_else(a.category, "Other").alias("category"), or_else(a.type, "other").alias("type"), strip(F.coalesce(a.value, F.lit(""))).alias("value"), or_else(a.comment, "").alias("comment")))
    return F.coalesce(F.filter(named, lambda a: a.value != ""), F.array().cast(IOCS))


LEAF = ("category", "comment", "type", "value")


def _leaf(node: ElementTree.Element) -> dict:
    return {k: None if (x := node.find(k)) is None else x.text for k in LEAF}


def events_in(raw: bytes) -> list[dict]:
    """Fields of the ``Event`` elements right below a file's root, in order; none if the file is not well-formed."""
    out, depth = [], 0
    try:
        for what, node in ElementTree.iterparse(io.BytesIO(raw), ("start", "end")):
            depth += 1 if what == "start" else -1
            if what == "end" and depth == 1:
                if node.tag == "Event":
                    found = {k: None if (x := node.find(k)) is None else x.text for k in ("id", "date", "info")}
                    out.append(found | {"Attribute": [_leaf(x) | {"item": [_leaf(y) for y in x.findall("item")]} for x in node.findall("Attribute")]})
                node.clear()
    except ElementTree.ParseError:
        return []
    return out


def parse_files(files: DataFrame) -> DataFrame:
    """file, ord (place in the file) and ``EVENT_XML`` of each event. ``files``: file, content (binary). A file is parsed as a whole by one task."""
    leaf = [(k, pa.string()) for k in LEAF]
    schema = pa.schema([("file", pa.string()), ("ord", pa.int64()), *((k, pa.string()) for k in ("id", "date", "info")), ("Attribute", pa.list_(pa.struct([*leaf, ("item", pa.list_(pa.struct(leaf)))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [{"file": name, "ord": k} | e for k, e in enumerate(events_in(raw.as_py() or b""))]
                for k in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 1000], schema)

    return files.select("file", "content").mapInArrow(run, f"file string, ord long, {EVENT_XML}")


def event_date(c: Column) -> Column:
    """A date, or that of an ISO time; 1970-01-01 for all else."""
    t = strip(c)
    day = F.when(t.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(t, "yyyy-M-d"))
    moment = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]") & F.try_to_timestamp(t).isNotNull(), parse_date(t))
    return F.coalesce(day, moment, F.lit(EPOCH).cast("date"))


def scanned_events(parsed: DataFrame) -> DataFrame:
    """file, year, event_id, date, info_title and iocs of parsed events; of those with one id in a file the last."""
    rows = parsed.select("file", "ord", strip(F.col("id")).try_cast("long").alias("event_id"), event_date(F.col("date")).alias("date"), strip(F.coalesce("info", F.lit(""))).alias("info_title"), attributes(F.col("Attribute")).alias("iocs"))
    last = rows.where("event_id IS NOT NULL").groupBy("file", "event_id").agg(F.max_by(F.struct("date", "info_title", "iocs"), "ord").alias("e"))
    return last.select("file", file_year(F.col("file")).alias("year"), "event_id", "e.*")


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    """``scanned_events`` of the ``*.xml`` files of a folder, or of one file.

    Events whose id is no whole number are dropped; a bad date is 1970-01-01. A file that
    doesn't parse, or has no events below its root, gives no rows. Files are read whole
    (2 GB each at most), as what is wrong may stand at their end.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    return scanned_events(parse_files(found.select(F.col("_metadata.file_name").alias("file"), "content")))


def merge_events(scanned: DataFrame) -> DataFrame:
    """One row for each year and event_id, folded over its files in the order of their names.

    A title replaces the one so far if that is blank, shorter, or a single word where
    the new one is not; its date comes along unless it is 1970-01-01. Indicators
    with the same lower-case type and trimmed value are one, at the first one's place:
    the first with a comment, or else the first.
    """
    files = scanned.groupBy("year", "event_id").agg(F.array_sort(F.collect_list(F.struct("file", "info_title", "date"))).alias("f"))

    def step(acc: Column, x: Column) -> Column:
        old, new = acc.title, x.info_title
        take = ~blank(new) & (blank(old) | (F.length(new) > F.length(old)) | (new.contains(" ") & ~old.contains(" ")))
        date = F.when(take & (x.date != F.lit(EPOCH).cast("date")), x.date).otherwise(acc.date)
        return F.struct(F.when(take, new).otherwise(old).alias("title"), date.alias("date"))

    zero = F.struct(F.get(F.col("f"), 0).info_title.alias("title"), F.get(F.col("f"), 0).date.alias("date"))
    folded = files.select("year", "event_id", F.aggregate(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(1))), zero, step).alias("m"), F.array_sort(F.array_distinct(F.transform("f", lambda x: x.file))).alias("source_files"))
    leaves = scanned.select("year", "event_id", "file", F.posexplode("iocs").alias("pos", "ioc"))
    iocs = dedup_iocs(leaves, ["year", "event_id"], F.struct("file", "pos"))
    out = folded.join(iocs, ["year", "event_id"], "left")
    empty = F.array().cast(IOCS)
    return out.select(F.concat_ws("_", "year", "event_id").alias("id"), "year", "event_id", F.col("m.date").alias("date"), F.col("m.title").alias("info_title"), F.coalesce("iocs", empty).alias("iocs"), "source_files")


def dedup_iocs(leaves: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """``iocs`` of each key from rows with an ``ioc``, in order, without repetitions."""
    named = leaves.withColumns({"_o": order, "_t": F.lower("ioc.type"), "_v": F.trim("ioc.value")})
    noted = F.min_by(F.when(F.col("ioc.comment") != "", F.col("ioc")), F.when(F.col("ioc.comment") != "", F.col("_o")))
    one = named.groupBy(*keys, "_t", "_v").agg(F.min("_o").alias("_o"), F.coalesce(noted, F.min_by("ioc", "_o")).alias("ioc"))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "ioc"))), lambda x: x.ioc).alias("iocs"))


def validate_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events, and rejections with the first reason that holds."""
    reason = (
        F.when(F.col("event_id").isNull() | (F.col("event_id") <= 0), "Missing or invalid event_id")
        .when(F.col("date").isNull(), F.concat(F.lit("Missing date for CTI event "), F.col("id")))
        .when(blank(F.col("info_title")), F.concat(F.lit("Missing or empty info_title for CTI event "), F.col("id")))
    )
    return split_rejected(events, reason, "id", "cti_event")


def split_rejected(rows: DataFrame, reason: Column, key: str, kind: str) -> tuple[DataFrame, DataFrame]:
    marked = rows.withColumn("_reason", reason)
    bad = marked.where("_reason IS NOT NULL").select(F.col(key).cast("string").alias("record_id"), F.lit(kind).alias("record_type"), F.col("_reason").alias("reason"), F.to_json(F.struct(*rows.columns)).alias("payload"))
    return marked.where("_reason IS NULL").drop("_reason"), bad
