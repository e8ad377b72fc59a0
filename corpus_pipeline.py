"""The corpus pipeline over ``documents``: each stage reads what its predecessor kept, written as Parquet.

Documents that the quality classifier rejects go; repeated lines go; one document of each group of near copies stays;
documents that hold a benchmark item go; and sources are mixed to their target weights.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontam, linededup, mixing, quality, simhash
from glyphmill.session import delete_table, free_shuffles, scratch, shared_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored like any other; rows stay as they are."""
    forest = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, forest).where("predicted = 1").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; null and empty texts stay, a document that loses all its words goes."""
    return linededup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; texts without words, null ones too, are one group."""
    return simhash.near_dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null ids and repeated rows are told apart by their text."""
    leaks = decontam.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = leaks.select(F.xxhash64("doc_id", F.lit(0), "text_hash").alias("_gm_key")).distinct()
    keyed = docs.withColumn("_gm_key", F.xxhash64(F.col("doc_id"), F.lit(0), F.xxhash64("text")))
    return keyed.join(gone, "_gm_key", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document that the mix takes, with how many copies of it. Columns of documents named size, source_size, target,
    copies or taken are replaced by the mix's own; a text without words is never taken but by whole passes."""
    return mixing.mix(mixing.with_size(docs)).where("copies > 0")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontam", drop_leaks),
    ("mixing", mix_sources),
]

#: SQL can't express the first stage's trees; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of sf_dir. A stage's tables, and what it read, go once it's written;
    an empty table of documents gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/glyphmill-pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        with scratch(spark), free_shuffles(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if last:
            delete_table(spark, last)
        last = f"{folder}/{name}"
        docs = spark.read.parquet(last)
    return docs
