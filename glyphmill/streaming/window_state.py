"""The seed window in the engine's state: the last batches of each group live in the state store of a streaming query.

Each group's pieces are dealt by a hash to ``shares`` keys, so that no task holds a language; a row without a piece tells
every share of a group that a batch came. A key's state is a list of its last batches, one row each, and nothing else is
kept: a batch that leaves the window leaves the store. A query that is stopped resumes from its checkpoint. A task passes on
only the texts that may be in a window, before they're cut up: of all others it has read texts of enough newer batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glyphmill.operators.seeds import cut_pieces, first_pretokens, recent_scores, seed_scores

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HELD = "batch_id long, pieces array<string>, scores array<long>"


class LastBatches(StatefulProcessor):
    """Keeps the ``size`` greatest batch numbers of a key, each with the summed scores of its pieces. A batch may come in
    several parts and in any order; one below the window is left out, as it could never enter again."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", _HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batches = {b: dict(zip(pieces, scores)) for b, pieces, scores in self.held.get()} if self.held.exists() else {}
        for part in rows:
            for b, came in part.groupby("batch_id"):
                sums = batches.setdefault(int(b), {})
                came = came[came["piece"].notna()]
                for piece, score in zip(came["piece"], came["score"]):
                    sums[piece] = sums.get(piece, 0) + int(score)
            batches = dict(sorted(batches.items())[-self.size :])
        self.held.put([(b, list(sums), list(sums.values())) for b, sums in batches.items()])
        yield pd.DataFrame({"share": [key[-1]], "n_batches": [len(batches)]})

    def close(self) -> None:
        pass


#: Characters of texts that a task holds; with more it passes on what it holds and goes on.
HELD_CHARS = 1 << 26


def _newest(texts: DataFrame, keys: Sequence[str], size: int, most: int = HELD_CHARS) -> DataFrame:
    """The texts (keys.., batch_id, text) but for those of which the task has ``size`` newer batches of their group: the state
    would drop them. Only texts of the newest batches are held."""
    columns = [*keys, "batch_id", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, dict[int, list[str]]] = {}
        least: dict[tuple, int] = {}  # a batch below has ``size`` newer ones
        held, schema = 0, None

        def rows() -> Iterator[pa.RecordBatch]:
            for group, of in groups.items():
                for b, found in of.items():
                    yield pa.RecordBatch.from_pylist([dict(zip(columns, (*group, b, x))) for x in found], schema)
                    found.clear()

        for batch in batches:
            schema = batch.schema
            for *group, b, x in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                group = tuple(group)
                if group in least and b < least[group]:
                    continue
                of = groups.setdefault(group, {})
                if b not in of:
                    of[b] = []
                    if len(of) > size:
                        held -= sum(map(len, of.pop(min(of))))
                        if b not in of:
                            continue
                    if len(of) == size:
                        least[group] = min(of)
                of[b].append(x)
                held += len(x)
            if held > most:
                yield from rows()
                held = 0
        if schema is not None:
            yield from rows()

    return texts.select(*columns).mapInArrow(run, texts.select(*columns).schema)


def _summed(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds up the scores of each Arrow batch before they're shuffled; a stream has no partial aggregate of its own here."""
    names = [*by, "piece", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(names[:-1]).aggregate([("score", "sum")])
            yield from table.rename_columns(names).to_batches()

    return rows.mapInArrow(run, rows.schema)


class WindowState:
    """The last ``size`` batches of each group of ``keys``, as the state of a stream of (keys.., batch_id, text)."""

    def __init__(self, spark: SparkSession, checkpoint: str, keys: Sequence[str], size: int, shares: int = 16, max_length: int = 16, stride: int = 4) -> None:
        self.spark, self.checkpoint, self.keys, self.size = spark, checkpoint, list(keys), size
        self.shares, self.max_length, self.stride = shares, max_length, stride

    def _rows(self, texts: DataFrame) -> DataFrame:
        """(keys.., batch_id, share, piece, score), and for each text a row without a piece in every share. A null text
        is no part of a batch."""
        by, texts = [*self.keys, "batch_id"], _newest(texts.where("text is not null and batch_id is not null"), self.keys, self.size)
        pieces = cut_pieces(first_pretokens(texts, by).withColumn("n", F.lit(1)), by, self.max_length, self.stride)
        pieces = pieces.select(*by, F.pmod(F.xxhash64("piece"), F.lit(self.shares)).cast("int").alias("share"), "piece", (F.col("n") * F.octet_length("piece")).cast("long").alias("score"))
        came = texts.select(*by, F.explode(F.sequence(F.lit(0), F.lit(self.shares - 1))).alias("share"), F.lit(None).cast("string").alias("piece"), F.lit(0).cast("long").alias("score"))
        return _summed(pieces.unionByName(came), [*by, "share"])

    def run(self, stream: DataFrame) -> None:
        """Takes in all that the stream has now, after what the checkpoint has already taken."""
        grouped = self._rows(stream).groupBy(*self.keys, "share")
        counts = grouped.transformWithStateInPandas(LastBatches(self.size), "share int, n_batches long", "Update", "None")
        before = self.spark.conf.get(_PROVIDER, None)
        self.spark.conf.set(_PROVIDER, _ROCKS)
        try:
            counts.writeStream.format("noop").outputMode("update").option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start().awaitTermination()
        finally:
            self.spark.conf.unset(_PROVIDER) if before is None else self.spark.conf.set(_PROVIDER, before)

    def batches(self) -> DataFrame:
        """(keys.., batch_id, piece, score): what the state holds; a batch without a piece has one row with nulls."""
        held = self.spark.read.format("statestore").option("stateVarName", "held").load(self.checkpoint)
        rows = held.select(*[F.col(f"key.{k}").alias(k) for k in self.keys], F.col("list_element").alias("x"))
        return rows.select(*self.keys, "x.batch_id", F.explode_outer(F.arrays_zip("x.pieces", "x.scores")).alias("y")).select(*self.keys, "batch_id", F.col("y.pieces").alias("piece"), F.col("y.scores").alias("score"))

    def scores(self) -> DataFrame:
        """(keys.., piece, score) over each group's window."""
        return self.batches().where("piece is not null").groupBy(*self.keys, "piece").agg(F.sum("score").alias("score"))

    def peek(self, texts: DataFrame) -> DataFrame:
        """The windows as if the texts (keys.., batch_id, text) had come too; the state stays."""
        by, texts = [*self.keys, "batch_id"], texts.where("text is not null")
        more = seed_scores(texts, self.max_length, self.stride, by=by).unionByName(texts.select(*by, F.lit(None).cast("string").alias("piece"), F.lit(0).cast("long").alias("score")))
        return recent_scores(self.batches().unionByName(more), self.size, self.keys).where("piece is not null")
