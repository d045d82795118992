"""Tables between passes, in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratches: list[tuple[SparkSession, str]] = []

#: Tables of at most so many bytes are broadcast. A row counts for so many besides its columns: what a hash table adds.
MOST_BROADCAST, ROW_BYTES = 16 << 20, 32
#: Types of columns that take up 8 bytes or less.
WIDTH = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"}
ROWS_A_FILE = 250_000
#: Bytes of a row group: what the writer of a task holds in memory.
ROW_GROUP = 32 << 20


def folder(spark: SparkSession) -> str:
    """URI of the shared folder; a temporary one only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veritrail-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base if urlparse(base).scheme else "file://" + os.path.abspath(base)


def scratch(spark: SparkSession, label: str) -> str:
    """URI of a new folder for one run of an operator; ``release`` removes it."""
    uri = f"{folder(spark).rstrip('/')}/veritrail-{label}-{uuid.uuid4().hex}"
    _scratches.append((spark, uri))
    return uri


def release(spark: SparkSession) -> None:
    """Deletes all scratch folders of this session. Results that were not written read them: write first."""
    jvm = spark.sparkContext._jvm
    for at in [x for x in _scratches if x[0] is spark]:
        path = jvm.org.apache.hadoop.fs.Path(at[1])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _scratches.remove(at)


@atexit.register
def _release_all() -> None:
    for spark, _ in list(_scratches):
        try:
            release(spark)
        except Exception:  # the session has ended
            return


def stored(df: DataFrame, label: str, uri: str | None = None, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: cuts lineage and survives lost executors.

    ``rows``: a bound on the number of its rows, where they are narrow. They are gathered
    into a file for each ``ROWS_A_FILE`` then; what makes them keeps its own tasks.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.repartition(max(1, -(-rows // ROWS_A_FILE)))
    uri = f"{uri or scratch(spark, label)}/{label}"
    # zstd streams: other codecs hold direct buffers until the next full collection, which many small tables add up
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcasting if its rows take up few bytes, else left to a shuffle. Looks through the rows, so store what is costly."""
    varying = [F.octet_length(c if kind in ("string", "binary") else F.to_json(F.struct(c))).cast("long") for c, kind in df.dtypes if kind not in WIDTH]
    n, more = df.agg(F.count("*"), F.sum(sum((F.coalesce(x, F.lit(0)) for x in varying), F.lit(0)))).first() if varying else (df.count(), 0)
    return F.broadcast(df) if n * (ROW_BYTES + 8 * len(df.columns)) + (more or 0) <= MOST_BROADCAST else df
