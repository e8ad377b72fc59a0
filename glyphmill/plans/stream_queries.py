"""Queries over streams that stop and resume, parts that fail, and flat array files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from glyphmill.plans import corpus_queries
from glyphmill.plans.source_queries import folder, table
from glyphmill.sources import arrays, parts
from glyphmill.sources.tables import stream_corpus
from glyphmill.streaming.window_state import WindowState


def streamed_window(spark: SparkSession, sf: str) -> DataFrame:
    """The last two batches of each language and pool, from the state of a stream that is stopped and resumed."""
    into, checkpoint = folder(spark, "window-in"), folder(spark, "window-state")
    batch = F.floor(F.col("doc_id") / 32)
    texts = table(spark, sf, "documents").select("lang", (F.col("doc_id") % 2).alias("pool"), batch.alias("batch_id"), "text")
    for part in (texts.where("batch_id % 3 = 0"), texts.where("batch_id % 3 != 0")):
        part.write.mode("append").parquet(into)
        state = WindowState(spark, checkpoint, ("lang", "pool"), 2)
        state.run(stream_corpus(spark, into, texts.schema, files_per_trigger=64))
    return state.scores()


def recovered_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in parts of 32, of which each fifth has a line that breaks off, read by a stream that is stopped and
    resumed: the documents and characters of good parts, and the parts that were rejected."""
    into, checkpoint, out = (folder(spark, n) for n in ("parts-in", "parts-offsets", "parts-out"))
    docs = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 32).alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    line = F.to_json(F.struct("doc_id", "text"))
    line = F.when((F.col("n") % 5 == 3) & (F.col("doc_id") % 32 == 0), F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))).otherwise(line)
    middle = docs.agg((F.max("n") / 2).alias("middle"))
    lines = docs.crossJoin(F.broadcast(middle)).select(line.alias("value"), F.lpad(F.col("n").cast("string"), 12, "0").alias("part"), (F.col("n") > F.col("middle")).alias("late"))
    columns = Y.StructType([Y.StructField("doc_id", Y.LongType()), Y.StructField("text", Y.StringType())])
    for late in (False, True):
        lines.where(F.col("late") == late).select("value", "part").repartition("part").write.mode("append").partitionBy("part").option("compression", "gzip").text(into)
        stream = parts.stream_parts(spark, into, columns, suffixes=".txt.gz")
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    rows = spark.read.parquet(out)
    number = F.regexp_extract(F.col("part"), "part=([0-9]+)", 1).cast("long").alias("part")
    good = parts.accepted(rows).withColumnRenamed(parts.PART, "part").groupBy(number).agg(F.count("doc_id").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"), F.lit(False).alias("rejected"))
    bad = parts.rejected(rows).select(number, F.lit(None).cast("long").alias("n_docs"), F.lit(None).cast("long").alias("n_chars"), F.lit(True).alias("rejected"))
    return good.unionByName(bad)


def array_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings written as flat arrays and read again in ranges of rows; they're numbered by their order of ids."""
    path = folder(spark, "arrays")
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("vec"))
    arrays.write_arrays(vecs, path, rowsPerFile=4096)
    read = arrays.read_arrays(spark, path, rowsPerTask=1000)
    exact = F.transform("vec", lambda x: F.round(x.cast("double") * 1000000).cast("long"))
    return read.select(F.col("id").alias("vec_id"), F.size("vec").cast("long").alias("width"), F.aggregate(exact, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


QUERIES = {f.__name__: f for f in (streamed_window, recovered_parts, array_ranges)}

SQL = {
    "streamed_window": corpus_queries.SQL["recent_window"],
    "recovered_parts": """SELECT doc_id // 32 AS part, CASE WHEN (doc_id // 32) % 5 = 3 AND bool_or(doc_id % 32 = 0) THEN NULL ELSE count(*) END AS n_docs,
CASE WHEN (doc_id // 32) % 5 = 3 AND bool_or(doc_id % 32 = 0) THEN NULL ELSE sum(length(coalesce(text, '')))::BIGINT END AS n_chars,
(doc_id // 32) % 5 = 3 AND bool_or(doc_id % 32 = 0) AS rejected FROM documents GROUP BY doc_id // 32""",
    "array_ranges": "SELECT vec_id, len(embedding) AS width, list_sum(list_transform(embedding, lambda x: round(x::DOUBLE * 1000000)::BIGINT))::BIGINT AS total FROM embeddings",
}
