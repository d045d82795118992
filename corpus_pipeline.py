"""A training corpus from raw documents, in stages that are each written and read again.

Toxic documents go, repeated lines go, one document of each group of near copies
stays, documents with passages of the benchmark go, and the rest is packed. Stages
but the last return the columns of ``documents``; texts that change get a new n_chars.

Rows that repeat a doc_id are judged each by its own text for toxicity and passages; as
for near copies they are one document, which stays or goes with all its rows. A null
doc_id takes no part in near copies; such rows are judged like others in the other stages.
Null and empty texts are clean: they stay. Lines go from all documents but the one with
the largest doc_id; an emptied text stays as an empty one. Empty tables give empty results.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import decontamination, line_dedup, near_dedup, packing
from veritrail.llm import toxicity as toxic
from veritrail.llm.shared import limit_batches, scratch, small, stored


def _stage(apply):
    @functools.wraps(apply)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        limit_batches(spark)
        return apply(spark, docs, sf_dir)

    return run


def _row(docs: DataFrame):
    return F.struct(*(F.col(c) for c in docs.columns)).alias("_row")


def _without(docs: DataFrame, rejected: DataFrame, *key) -> DataFrame:
    """Rows whose key columns (null equals null) are not among those of ``rejected``, which are few."""
    rejected = small(stored(rejected.distinct(), "rejected"))
    rows = docs.select(_row(docs), *(k.alias(f"_k{i}") for i, k in enumerate(key)))
    named = rejected.toDF(*(f"_r{i}" for i in range(len(key))))
    same = F.lit(True)
    for i in range(len(key)):
        same = same & F.col(f"_k{i}").eqNullSafe(F.col(f"_r{i}"))
    return rows.join(named, same, "left_anti").select("_row.*")


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdict = toxic.toxicity(docs.select("doc_id", "text", _row(docs)), labels, carry="_row")
    return verdict.where("predicted = 0").select("_row.*")


@_stage
def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in one of them; an emptied document stays as an empty text."""
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", _row(docs)), carry="_row")
    changed = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("_row.text"))
    columns = {"text": changed, "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("_row.n_chars"))}
    return out.select(*(columns.get(c, F.col(f"_row.{c}")).alias(c) for c in docs.columns))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    verdict = near_dedup.near_duplicates(docs)
    return _without(docs, verdict.where("NOT kept").select("doc_id"), F.col("doc_id"))


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    text = F.xxhash64("text")
    verdict = decontamination.decontaminate(docs.withColumn("_text", text), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry="_text")
    return _without(docs, verdict.where("contaminated").select("doc_id", "_text"), F.col("doc_id"), text)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", repeated_lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: A trained classifier and a tokenizer have no SQL form: a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    uri = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}", uri)
    return docs
