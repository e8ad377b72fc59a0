"""Quality classifier: gradient-boosted trees over statistics of whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.arrowtext import Hasher, mix, pair, text_chunks, word_ranges, words_lut
from glyphmill.llm.gbdt import Forest, fit

FOLDS, HELD_FOLD, ACCEPT = 5, 0, 0.3
#: Labelled rows to learn from, as expected number: larger sets are thinned by a hash of the id.
LEARN_ROWS = 20_000

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>~^=_{}[]\\/@+",
    "stop": b".,;:",
    "loud": b"!?",
    "space": b" \t\r\v\f",
    "line": b"\n",
    "high": bytes(range(0x80, 0x100)),
}
FEATURES = (
    *(f"{k}_share" for k in _CLASSES), "log_bytes", "log_words", "word_bytes", "word_spread", "longest_word", "type_share",
    "top_word_share", "twin_share", "repeated_pair_share", "bare_word_share", "symbol_end_share", "words_per_line",
)


def _class_lut() -> np.ndarray:
    lut = np.full(256, len(_CLASSES), np.uint8)
    for i, members in enumerate(_CLASSES.values()):
        lut[list(members)] = i
    return lut


def statistics(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    docs, kinds = len(offsets) - 1, len(_CLASSES)
    size = np.diff(offsets)
    kind = _class_lut()[data]
    owner = np.repeat(np.arange(docs), size)
    counts = np.bincount(owner * (kinds + 1) + kind, minlength=docs * (kinds + 1)).reshape(docs, kinds + 1)[:, :kinds]
    starts, ends, first = word_ranges(data, offsets, words_lut())
    n = np.diff(first)
    doc = np.repeat(np.arange(docs), n)
    length = (ends - starts).astype(np.float64)
    h = hasher(data, starts, ends)
    per = np.maximum(n, 1)

    def repeats(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: distinct keys, the highest count, and keys that aren't alone."""
        _, at, c = np.unique(pair(mix(doc.astype(np.uint64)), keys), return_index=True, return_counts=True)
        top = np.zeros(docs)
        np.maximum.at(top, doc[at], c)
        return np.bincount(doc[at], minlength=docs), top, np.bincount(doc[at], np.where(c > 1, c, 0), docs)

    types, top, _ = repeats(h, doc)
    inner = doc[1:] == doc[:-1]
    _, _, again = repeats(pair(h[:-1], h[1:])[inner], doc[1:][inner])
    twin = np.bincount(doc[1:][inner & (h[1:] == h[:-1])], minlength=docs)
    wordy = np.concatenate(([0], np.cumsum((kind == 0) | (kind == 1) | (kind == 2) | (kind == kinds - 1))))
    bare = np.bincount(doc[wordy[ends] == wordy[starts]], minlength=docs)
    symbols = list(_CLASSES).index("symbol"), list(_CLASSES).index("loud")
    ended = np.bincount(doc[np.isin(kind[ends - 1], symbols)], minlength=docs) if len(ends) else np.zeros(docs)
    mean = np.bincount(doc, length, docs) / per
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, docs) / per - mean**2, 0))
    longest = np.zeros(docs)
    np.maximum.at(longest, doc, length)
    lines = counts[:, list(_CLASSES).index("line")] + 1
    return np.column_stack(
        [counts / np.maximum(size, 1)[:, None], np.log1p(size), np.log1p(n), mean, spread, np.log1p(longest), types / per, top / per,
         twin / per, again / per, bare / per, ended / per, n / lines]
    )


def fold(id_col: str) -> Column:
    """crc32 of the id as text modulo FOLDS; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """Fits the trees on labelled rows outside the held-out fold, about LEARN_ROWS of them by a hash of the id.

    Rows without id or label don't count; an id with several labels gives a row for each. Without rows, or with one
    class only, the result is a constant.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    rows = rows.where(fold("id") != HELD_FOLD)
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < min(1 << 20, int(LEARN_ROWS / max(n, 1) * (1 << 20)) + 1))
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            x = [statistics(d, o, hasher) for _, _, d, o in text_chunks(batch.column(2), 4 << 20)]
            if x:
                flat = pa.array(np.concatenate(x).ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(flat, width).cast(pa.list_(pa.float64()))], ["id", "y", "x"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text")
    got = texts.mapInArrow(run, T.StructType([texts.schema["id"], texts.schema["y"], T.StructField("x", T.ArrayType(T.DoubleType()))])).toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), width)
    order = np.lexsort((*x.T, got["y"].to_numpy(), got["id"].to_numpy()))
    return fit(x[order], got["y"].to_numpy(np.float64)[order])


def classify(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1, higher: better) and predicted (1 from ACCEPT on); each document is scored on its whole text.

    Null and empty texts are scored by their zero statistics. Columns named score or predicted are replaced; all
    other columns and rows, repeated ones too, stay.
    """
    kept = docs.drop("score", "predicted")
    at = kept.columns.index(text_col)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            found = [forest.predict(statistics(d, o, hasher)) for _, _, d, o in text_chunks(batch.column(at), 4 << 20)]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: learns labels outside fold 0, scores every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    forest = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = classify(docs, forest).withColumn("held_out", F.coalesce(fold("doc_id") == HELD_FOLD, F.lit(False)))
    return found.select("doc_id", "held_out", "score", "predicted")
