"""The seed window as a stream: each micro-batch is pushed as a batch of texts, and the last N batches are the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.seeds import recent_scores, seed_scores


class SeedWindow:
    """State of the last ``size`` batches of (batch_id, piece, score), a Parquet table with a partition for each batch.

    Writing a batch replaces its partition, so a micro-batch that is run again after a failure leaves the state as it
    was; a reader sees whole batches only. With ``keys`` (a language, a pool) each group of them has a window of its own.
    """

    def __init__(self, spark: SparkSession, path: str, size: int, max_length: int = 16, stride: int = 4, keys: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.size, self.max_length, self.stride, self.keys = spark, path, size, max_length, stride, keys

    def _scores(self, texts: DataFrame, batch_id: int) -> DataFrame:
        return seed_scores(texts.withColumn("batch_id", F.lit(batch_id)), self.max_length, self.stride, by=(*self.keys, "batch_id"))

    def push(self, texts: DataFrame, batch_id: int) -> None:
        """Adds a batch; for ``foreachBatch``."""
        self._scores(texts, batch_id).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self.path)

    def scores(self, upto: int) -> DataFrame:
        """(keys.., piece, score) over the window that ends with batch ``upto``."""
        if self.keys:
            return recent_scores(self.spark.read.parquet(self.path), self.size, self.keys, upto)
        rows = self.spark.read.parquet(self.path).where((F.col("batch_id") > upto - self.size) & (F.col("batch_id") <= upto))
        return rows.groupBy("piece").agg(F.sum("score").alias("score"))

    def peek(self, texts: DataFrame, upto: int) -> DataFrame:
        """The window as if the texts were pushed after batch ``upto``; the state stays."""
        if self.keys:
            rows = self.spark.read.parquet(self.path).where(F.col("batch_id") <= upto)
            return recent_scores(rows.unionByName(self._scores(texts, upto + 1)), self.size, self.keys)
        held = self.spark.read.parquet(self.path).where((F.col("batch_id") > upto + 1 - self.size) & (F.col("batch_id") <= upto))
        both = held.select("piece", "score").unionByName(self._scores(texts, upto + 1).select("piece", "score"))
        return both.groupBy("piece").agg(F.sum("score").alias("score"))

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Pushes all that the stream has now, and resumes after the last whole batch."""
        query = stream.writeStream.foreachBatch(lambda df, i: self.push(df, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def event_flush(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value): a metric flush by event time, for a stream or a table of (ts, event_type, value)."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    out = source.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "value")
