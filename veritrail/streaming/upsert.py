"""Extractions as a stream: each micro-batch becomes a new version of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph
from ..schemas import EXTRACTION
from ..sources import tables


def current(spark: SparkSession, path: str) -> str | None:
    """Path of the newest version, or None."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    done = sorted(x.getPath().getName() for x in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "edges/_SUCCESS")))
    return f"{path}/{done[-1]}" if done else None


def upsert_stream(spark: SparkSession, source: str, path: str, checkpoint: str) -> StreamingQuery:
    """Reads JSON extractions as they come. A version is named by its batch, so a repeated batch replaces its own version and changes nothing else."""

    def merge(batch: DataFrame, number: int) -> None:
        mine = f"{path}/v{number:012d}"
        base = current(spark, path)
        if base == mine:
            return
        nodes, edges = tables.read_graph(spark, base or mine)
        new_nodes, new_edges, _ = graph.build(batch, F.current_timestamp())
        tables.write_graph(graph.merge_nodes(nodes, new_nodes), graph.merge_edges(edges, new_edges), mine)

    rows = spark.readStream.schema(EXTRACTION).json(source)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by kind and window of a stream or table; state of windows older than the watermark goes."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n")
