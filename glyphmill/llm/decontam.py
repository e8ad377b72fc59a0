"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of word shingles into classes (S/2, S]. For a class, a document is cut into blocks
of S shingles, and two neighbouring blocks are a window: an item that stands in a document lies in a window of at most
four times its size, so their Jaccard similarity is bounded below however long the document is. Windows and items that
share any of the minimum hashes are candidates; each is then verified by exact containment of the item's shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.arrowtext import Hasher, letters_lut, mix, pair, text_chunks, word_ranges
from glyphmill.session import materialise

_U = np.uint64


@dataclass(frozen=True)
class Search:
    """Words of a shingle, the containment to report, minimum hashes (at 48 an item of containment 0.8 is missed with
    probability below 1e-4), and the most bits of each of the two prefilters that are broadcast."""

    shingle_words: int = 5
    containment: float = 0.8
    hashes: int = 48
    most_bits: int = 1 << 26

    def multipliers(self) -> np.ndarray:
        return mix(np.arange(1, self.hashes + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def shingles(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, lut: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all k-word shingles, and for each text (and the end) the index of its first."""
    starts, ends, first = word_ranges(data, offsets, lut)
    h = hasher(data, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if len(h) < k:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    key = h[: len(h) - k + 1]
    for i in range(1, k):
        key = pair(key, h[i : len(h) - k + 1 + i])
    whole = doc[: len(doc) - k + 1] == doc[k - 1 :]
    return key[whole], np.searchsorted(doc[: len(doc) - k + 1][whole], np.arange(len(offsets)))


def _cell(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys) >> _U(64 - bits.bit_length() + 1)).astype(np.int64)


def _holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _cell(keys, len(table) * 8)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _tagged(value: np.ndarray, size_class: int, j: int) -> np.ndarray:
    """The key of a minimum hash of one class and one hash function."""
    return mix(value.astype(_U) ^ (_U(size_class * 4096 + j + 1) << _U(40)))


def _short(key: np.ndarray, words: int) -> np.ndarray:
    """The key of an item of so few words, all of which are its one shingle."""
    return mix(key ^ (_U(words) << _U(56)))


def item_rows(items: DataFrame, search: Search, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item, size_class, words, q, keys, shingles): a row for each item that has a word. words is 0, or the number
    of words where they are fewer than a shingle; such an item's only key and shingle is that of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lut, a = Hasher(), letters_lut(digits=True), search.multipliers()
        made, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for lo, hi, data, offs in text_chunks(pc.utf8_lower(batch.column(1)), 1 << 20):
                key, first = shingles(data, offs, hasher, lut, search.shingle_words)
                fewer = [shingles(data, offs, hasher, lut, k) for k in range(1, search.shingle_words)]
                rows = []
                for i in range(hi - lo):
                    if first[i] == first[i + 1]:
                        for words, (short, at) in enumerate(fewer, 1):
                            if at[i + 1] - at[i] == 1:  # one sequence of so many words, so no more words
                                made += 1
                                only = _short(short[at[i] : at[i + 1]], words).view(np.int64).tolist()
                                rows.append((batch.column(0)[lo + i].as_py(), (part << 40) + made, -1, words, 1, only, only))
                    own = np.unique(key[first[i] : first[i + 1]])
                    if len(own):
                        made += 1
                        size = int(len(own) - 1).bit_length()
                        mins = [int(_tagged(((own * m) >> _U(32)).min(keepdims=True), size, j).view(np.int64)[0]) for j, m in enumerate(a)]
                        rows.append((batch.column(0)[lo + i].as_py(), (part << 40) + made, size, 0, len(own), mins, own.view(np.int64).tolist()))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                cols = [pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(cols, ["item_id", "item", "size_class", "words", "q", "keys", "shingles"])

    source = items.select(F.col(id_col).cast("long"), F.col(text_col))
    return source.mapInArrow(run, "item_id long, item long, size_class int, words int, q long, keys array<long>, shingles array<long>")


def window_minima(value: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Minima over windows of two neighbouring blocks of ``size`` values; blocks start anew with each text. A text's
    last block is a window of its own too."""
    n = np.diff(first)
    blocks = -(-n // size)
    doc = np.repeat(np.arange(len(n)), blocks)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.minimum.reduceat(value, first[doc] + rank * size)
    after = np.concatenate((low[1:], low[-1:]))
    return np.where(np.concatenate((doc[1:] == doc[:-1], [False])), np.minimum(low, after), low)


def _window_docs(first: np.ndarray, size: int) -> np.ndarray:
    blocks = -(-np.diff(first) // size)
    return np.repeat(np.arange(len(blocks)), blocks)


def _document_rows(docs: DataFrame, search: Search, classes: list[int], short: list[int], tables: Broadcast) -> DataFrame:
    """(doc_id, text_hash, doc, keys, shingles): documents with a window that may share a minimum hash with an item; the
    keys that they may share, and their shingles that may be an item's. ``short`` are the lengths of items under a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lut, a = Hasher(), letters_lut(digits=True), search.multipliers()
        made, part = 0, TaskContext.get().partitionId()
        minima, known = tables.value
        for batch in batches:
            for lo, hi, data, offs in text_chunks(pc.utf8_lower(batch.column(2)), 1 << 20):
                key, first = shingles(data, offs, hasher, lut, search.shingle_words)
                owners, shared, spelt = [], [], []
                for words in short:
                    found, at = shingles(data, offs, hasher, lut, words)
                    tagged = _short(found, words)
                    hit = _holds(known, tagged)
                    spelt.append((np.repeat(np.arange(hi - lo), np.diff(at))[hit], tagged[hit]))
                owners += [o for o, _ in spelt]
                shared += [t for _, t in spelt]
                docs_of = {c: _window_docs(first, 1 << c) for c in classes}
                for j, m in enumerate(a if len(key) else ()):
                    value = ((key * m) >> _U(32)).astype(np.uint32)
                    for c in classes:
                        tagged = _tagged(window_minima(value, first, 1 << c), c, j)
                        hit = _holds(minima, tagged)
                        owners.append(docs_of[c][hit])
                        shared.append(tagged[hit])
                owner, tags = np.concatenate([*owners, np.zeros(0, np.int64)]), np.concatenate([*shared, np.zeros(0, _U)])
                some = np.unique(owner)
                if not len(some):
                    continue
                order = np.argsort(owner, kind="stable")
                owner, tags = owner[order], tags[order]
                at = np.searchsorted(owner, [some, some + 1])
                own = [np.unique(np.concatenate([key[first[d] : first[d + 1]], *[t[o == d] for o, t in spelt]])) for d in some]
                cols = [
                    batch.column(0).take(pa.array(some + lo)),
                    batch.column(1).take(pa.array(some + lo)),
                    pa.array((part << 40) + made + 1 + np.arange(len(some)), pa.int64()),
                    pa.array([np.unique(tags[x:y]).view(np.int64) for x, y in at.T], pa.list_(pa.int64())),
                    pa.array([x[_holds(known, x)].view(np.int64) for x in own], pa.list_(pa.int64())),
                ]
                made += len(some)
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "doc", "keys", "shingles"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, doc long, keys array<long>, shingles array<long>")


def prefilter(frame: DataFrame, column: str, most_bits: int) -> np.ndarray:
    """A bit table with a bit for each key of an array column: 16 bits a key, a power of two between 2^15 and most_bits.

    Tasks build pieces of 2^15 bits; the driver gets the pieces, so never more than the table's own size.
    """
    n = frame.agg(F.sum(F.size(column))).first()[0] or 0
    bits = 1 << 15
    while bits < 16 * n and bits < most_bits:
        bits *= 2

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_cell(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(_U), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], ["part", "cell"])

    def piece(rows: pa.Table) -> pa.Table:
        own = np.zeros(1 << 15, np.uint8)
        own[rows.column("cell").to_numpy()] = 1
        return pa.table({"part": rows.column("part").slice(0, 1), "raw": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    table = np.zeros(bits // 8, np.uint8)
    pieces = frame.select(column).mapInArrow(cells, "part long, cell long").distinct().groupBy("part").applyInArrow(piece, "part long, raw binary")
    for r in pieces.collect():
        table[r.part * 4096 : r.part * 4096 + 4096] = np.frombuffer(r.raw, np.uint8)
    return table


def find_leaks(
    docs: DataFrame, items: DataFrame, search: Search = Search(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """(doc_id, text_hash, item_id, containment): each document with each item whose distinct shingles it holds to the
    asked share or more. Words are runs of letters and digits in lower case.

    Null, empty and wordless texts hold nothing and are never found. An item of fewer words than a shingle is found where
    all its words stand one after the other.
    A null doc_id is kept as such; rows of a repeated id and text give one row (the same one). Other columns are
    ignored. Items and documents of any number are fine: what is broadcast are two bit tables of a bounded size, which
    only spare work; the search itself is a join on hash keys, and a pair is verified by counting shared shingles.
    """
    spark = docs.sparkSession
    sized = materialise(item_rows(items, search, item_col, text_col), "items")
    kinds = [tuple(r) for r in sized.select("size_class", "words").distinct().collect()]  # at most one for each power of two
    classes, short = sorted(c for c, w in kinds if not w), sorted(w for _, w in kinds if w)
    minima, known = prefilter(sized, "keys", search.most_bits), prefilter(sized, "shingles", search.most_bits)
    text = F.col(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    if not kinds:
        return spark.createDataFrame([], "doc_id long, text_hash long, item_id long, containment double")
    tables = spark.sparkContext.broadcast((minima, known))
    found = materialise(_document_rows(source, search, classes, short, tables), "windows")
    pairs = (
        found.select("doc", F.explode("keys").alias("key"))
        .join(sized.select("item", F.explode("keys").alias("key")), "key")
        .select("doc", "item")
        .distinct()
    )
    wanted = pairs.join(sized.select("item", "item_id", "q", F.explode("shingles").alias("s")), "item")
    held = found.select("doc", "doc_id", "text_hash", F.explode("shingles").alias("s"))
    shared = wanted.join(held, ["doc", "s"]).groupBy("doc", "doc_id", "text_hash", "item", "item_id", "q").agg(F.count("*").alias("n"))
    shared = shared.withColumn("containment", F.col("n") / F.col("q")).where(F.col("containment") >= search.containment)
    return shared.groupBy("doc_id", "text_hash", "item_id").agg(F.max("containment").alias("containment"))


def op2_decontam(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: the leaks found, as pairs with their containment."""
    read = spark.read.parquet
    return find_leaks(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/benchmark.parquet")).groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


#: Words of lower-cased texts in sets of five in a row (of all words, if an item has fewer), counted row by row.
OP2_SQL = r"""
WITH i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
n AS (SELECT item, item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
s AS (SELECT DISTINCT item, item_id, k, w[j:j + k - 1] AS s FROM (SELECT item, item_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM n)),
q AS (SELECT item, count(*) AS q FROM s GROUP BY item),
d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
e AS (SELECT doc, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM n)),
t AS (SELECT DISTINCT doc, doc_id, k, w[j:j + k - 1] AS s FROM e),
m AS (SELECT doc, doc_id, item, item_id, count(*) AS n FROM t JOIN s USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, max(n / q) AS containment FROM m JOIN q USING (item) WHERE n / q >= 0.8 GROUP BY doc_id, item_id
"""
