"""Sources and sinks: corpora by language, registries and lists, predictions, priors, parameters and metrics."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from glyphmill.session import hadoop_path

CORPUS = T.StructType([T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
REGISTRY = T.StructType([T.StructField("lang_code", T.StringType()), T.StructField("n_pages", T.LongType())])
LANGUAGES = T.StructType([T.StructField("lang", T.StringType()), T.StructField("weight", T.DoubleType())])
#: Languages that stand for another one at validation.
ALIASES = {"flan": "en"}


def write_corpus(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by language, so that a scan of one language reads its files only."""
    docs.select("text", "lang").write.mode(mode).partitionBy("lang").parquet(path)


def read_corpus(spark: SparkSession, path: str, langs: list[str] | None = None) -> DataFrame:
    """A corpus, or some of its languages by partition pruning."""
    out = spark.read.schema(CORPUS).parquet(path)
    return out.where(F.col("lang").isin([ALIASES.get(x, x) for x in langs])) if langs else out


def read_head(docs: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows of an explicit order."""
    return docs.orderBy(order).limit(n)


def read_registry(spark: SparkSession, path: str, include: list[str] | None = None) -> DataFrame:
    """(lang_code, n_pages) without the placeholder ``-``, within an include list."""
    out = spark.read.csv(path, header=True, schema=REGISTRY).where("lang_code != '-'")
    return out.where(F.col("lang_code").isin(include)) if include else out


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a code, or of a code and a weight."""
    return spark.read.csv(path, schema=LANGUAGES).where("lang is not null")


def read_splits(spark: SparkSession, files: dict[str, str], schema: T.StructType) -> dict[str, DataFrame]:
    """CSV or JSON files for training, validation and test, all of one extension."""
    kinds = {os.path.splitext(p)[1].lstrip(".") for p in files.values()}
    if len(kinds) != 1 or not kinds <= {"csv", "json"}:
        raise ValueError("the files must be all csv or all json")
    kind = kinds.pop()
    options = {"header": "true"} if kind == "csv" else {}
    return {name: spark.read.format(kind).options(**options).schema(schema).load(p) for name, p in files.items()}


def write_text(docs: DataFrame, path: str, text: str = "text") -> None:
    docs.select(text).write.mode("ignore").text(path)


def prediction_lines(rows: DataFrame, regression: bool = False, index: str = "index", value: str = "prediction") -> DataFrame:
    """index TAB prediction; three decimals in a regression."""
    shown: Column = F.format_string("%3.3f", value) if regression else F.col(value).cast("string")
    return rows.select(F.concat_ws("\t", F.col(index).cast("string"), shown).alias("value"))


def tag_lines(rows: DataFrame, tags: str = "tags") -> DataFrame:
    return rows.select(F.array_join(tags, " ").alias("value"))


def write_prior(prior: DataFrame, path: str, kind: str) -> None:
    """(kind, id, logp) appended, one kind for each prior."""
    prior.select(F.lit(kind).alias("kind"), "id", "logp").write.mode("append").partitionBy("kind").parquet(path)


def read_parameters(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parameters of distinct shard files as one table; a path in several shards comes from the last."""
    from glyphmill.operators.vocab import later_wins

    return later_wins([spark.read.parquet(p) for p in dict.fromkeys(paths)], "path")


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.select("step", "lang", "metric", "value").write.mode("append").parquet(path)


def stream_corpus(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """A streaming scan of a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rename_content(rows: DataFrame) -> DataFrame:
    """Rows of a code corpus, whose text stands in ``content``."""
    return rows.withColumnRenamed("content", "text")


def lookup_pages(langs: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds n_pages of each language (lang) from a registry (lang_code, n_pages); reading a language that the registry
    lacks raises."""
    found = langs.join(registry.select(F.col("lang_code").alias("lang"), F.col("n_pages").alias("_n")), "lang", "left")
    missing = F.raise_error(F.concat(F.lit("no registry entry for "), F.coalesce("lang", F.lit("null"))))
    return found.withColumn("n_pages", F.coalesce("_n", missing.cast("long"))).drop("_n")


def write_saved(rows: DataFrame, path: str, split: str | None = None) -> None:
    """A saved folder, or one split of a saved dict of splits."""
    rows.write.mode("overwrite").parquet(f"{path}/{split}" if split else path)


def read_saved(spark: SparkSession, path: str, schema: T.StructType | None = None, split: str = "train") -> DataFrame:
    """A saved folder, or the split of a dict of splits. Files are Parquet, or Arrow (streams or files, under 2 GB each, as
    one task reads a file whole) where a schema is given."""
    target, files = hadoop_path(spark, f"{path}/{split}")
    path = f"{path}/{split}" if files.exists(target) else path
    if schema is None:
        return spark.read.parquet(path)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(path).select("content")
    return arrow_rows(raw, schema)


def arrow_rows(contents: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of Arrow streams or files, one in each value of ``content``; columns that the schema lacks are left out."""
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for content in held.column("content"):
                source = pa.BufferReader(content.as_buffer())
                whole = pa.ipc.open_file(source) if content.as_buffer()[:6].to_pybytes() == b"ARROW1" else pa.ipc.open_stream(source)
                yield from whole.read_all().select(wanted.names).cast(wanted).to_batches(max_chunksize=10_000)

    return contents.mapInArrow(run, schema)


def write_batches(rows: DataFrame, path: str, size: int, id_col: str = "id") -> None:
    """Rows in batches of ``size`` ids, a partition of one file for each; a batch that is written again is replaced, others stay."""
    batch = F.floor(F.col(id_col) / size).cast("long")
    rows.withColumn("batch", batch).repartition("batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
