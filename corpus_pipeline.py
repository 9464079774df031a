"""The corpus pipeline: quality classifier, exact deduplication, near-deduplication, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; each is written as Parquet and read again before
the next. All but the last return the columns of documents; ids are integers and rows that a mix takes twice are there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import common, exact_dedup, mixing, near, packing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't reject. Equal ids are judged one by one: a row goes if a rejected row has its id and its text."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    judged = quality.classify(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), common.labels(spark, sf_dir, "quality"), keep=digest)
    rejected = judged.where("predicted = 0").select(F.col("doc_id").alias("__id"), F.col("kept").alias("__digest")).distinct()
    return docs.alias("a").join(rejected, F.col("a.doc_id").eqNullSafe(F.col("__id")) & (digest == F.col("__digest")), "left_anti").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row that exact deduplication keeps."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (linked by a similarity of 0.8 or more of their sets of five-word shingles), the row with the smallest id (of equal ids, the first by its text)."""
    return near.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, each as often as it takes it."""
    return mixing.repeated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The classifier, the fingerprints' hash and the tokenizer have no SQL; tests/llm holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.staged(docs, name)
    return docs
