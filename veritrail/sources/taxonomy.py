"""Terms of the technique taxonomy."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TACTICS
from .tables import exists

#: Columns of the table, the kind of their terms, and whether a cell holds several with semicolons between.
COLUMNS = {"APT Group Name": ("group", False), "Software ID": ("software", False), "Group Techniques": ("technique", True), "Software Techniques": ("technique", True)}


def tactics(spark: SparkSession, ids: bool = False) -> DataFrame:
    """The standard tactics; their ids only where a taxonomy is loaded too."""
    rows = [(name, "tactic") for name in TACTICS.values()] + [(x, "tactic") for x in TACTICS if ids]
    return spark.createDataFrame(rows, "term string, kind string").withColumn("term_lower", F.lower("term"))


def sheet_rows(raw: bytes) -> list[list[str | None]]:
    """Cells of a workbook's first sheet as texts, row by row. Formulas give the value that is stored with them."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = set(book.namelist())

        def tree(name: str) -> ElementTree.Element | None:
            return ElementTree.fromstring(book.read(name)) if name in names else None

        def text(node: ElementTree.Element) -> str:
            return "".join(x.text or "" for x in node.findall(".//{*}t"))

        strings = tree("xl/sharedStrings.xml")
        shared = [text(x) for x in strings.findall("{*}si")] if strings is not None else []
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)), default=None)
        sheet = tree(first) if first else None
    rows = []
    for row in sheet.findall(".//{*}row") if sheet is not None else ():
        cells: dict[int, str] = {}
        for cell in row.findall("{*}c"):
            at = 0
            for letter in re.match(r"[A-Z]*", cell.get("r", ""))[0]:  # A is 1, AA is 27
                at = 26 * at + ord(letter) - 64
            value, kind = cell.find("{*}v"), cell.get("t")
            if kind == "inlineStr":
                said = text(cell)
            elif value is None or value.text is None:
                continue
            else:
                said = shared[int(value.text)] if kind == "s" else value.text
            cells[at or len(cells) + 1] = said
        rows.append([cells.get(k) for k in range(1, max(cells, default=0) + 1)])
    return rows


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of an XLSX file, its first row naming the columns. A taxonomy is a small file, so the driver reads it."""
    (found,) = spark.read.format("binaryFile").load(path).select("content").collect()
    head, *rows = sheet_rows(bytes(found.content)) or [[]]
    names = [c or f"_{k}" for k, c in enumerate(head)]
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names) or "none string"
    return spark.createDataFrame([tuple((r + [None] * len(names))[: len(names)]) for r in rows if names], schema)


def taxonomy(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Distinct term, kind and term_lower of an XLSX, CSV or Parquet table with the four columns, and the tactics; of the tactics alone where there is no table."""
    if path is None or not exists(spark, path):
        return tactics(spark)
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    table = read_sheet(spark, path) if kind == "xlsx" else spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", True).csv(path)
    out = tactics(spark, ids=True).select("term", "kind")
    for column, (kind, several) in COLUMNS.items():
        if column in table.columns:
            c = F.col(f"`{column}`")
            out = out.union(table.select(F.explode(F.split(c, ";") if several else F.array(c)).alias("term")).select(F.trim("term").alias("term"), F.lit(kind)))
    return out.where("term IS NOT NULL AND term <> ''").distinct().withColumn("term_lower", F.lower("term"))
