"""Ranked lexical search: postings by shard of documents, merged a document at a time.

An index is cut by documents: each task turns the texts it reads into shards, and a shard holds for each of its terms the
documents by ascending id as compressed gaps, with how often the term occurs. So no text and no posting is shuffled to
build one. To rank, each shard meets the terms of a block of items. For an item a heap merges its terms' postings one
document after the other, a second, bounded heap keeps the best by score and then id, and the shards' best are merged.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heappushpop, heapreplace
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.llm.arrowtext import Hasher, letters_lut, text_chunks, word_ranges
from glyphmill.session import materialise

#: Bytes of text of a shard; a longer text is a shard of its own.
SHARD_BYTES = 1 << 24
#: Items that are ranked together in a shard, about.
ITEM_BLOCK = 256
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pack_ints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as bytes of seven bits, lowest first, and where each begins (and the end)."""
    v = values.astype(np.int64)
    size = np.ones(len(v), np.int64)
    for j in range(1, 9):
        size += v >= 1 << 7 * j
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(at[-1]), np.uint8)
    for j in range(int(size.max(initial=0))):
        has = size > j
        out[at[:-1][has] + j] = (v[has] >> 7 * j & 127) | np.where(size[has] > j + 1, 128, 0)
    return out, at


def unpack_ints(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    end = np.flatnonzero(b < 128)
    start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
    out = np.zeros(len(end), np.int64)
    for j in range(int((end - start).max(initial=-1)) + 1):
        has = start + j <= end
        out[has] |= (b[start[has] + j].astype(np.int64) & 127) << 7 * j
    return out


def shard_postings(data: np.ndarray, offsets: np.ndarray, ids: pa.Array, hasher: Hasher, lut: np.ndarray) -> tuple[list[str], np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """Of some texts: the terms, their document counts, their packed postings (gap and count in turn), and the documents
    by ascending id (null first) with their numbers of terms."""
    starts, ends, first = word_ranges(data, offsets, lut)
    order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sizes = np.diff(first)
    owner = place[np.repeat(np.arange(len(sizes)), sizes)]
    _, sample, term = np.unique(hasher(data, starts, ends), return_index=True, return_inverse=True)
    names = [data[s:e].tobytes().decode().translate(str.maketrans(_UPPER, _LOWER)) for s, e in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)]
    pairs, tf = np.unique(term.reshape(-1) * len(order) + owner, return_counts=True)
    term, doc = pairs // max(len(order), 1), pairs % max(len(order), 1)
    begin = np.searchsorted(term, np.arange(len(names) + 1))
    gap = np.diff(doc, prepend=0)
    gap[begin[:-1]] = doc[begin[:-1]]
    raw, at = pack_ints(np.column_stack((gap, tf)).ravel())
    edges = at[2 * begin].astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(raw.tobytes())])
    return names, np.diff(begin), packed, ids.take(pa.array(order)), sizes[order]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, term, df, postings, ids, sizes): a row for each term of each shard, and one without a term for its documents.

    Null and empty texts are documents of 0 terms. A null id sorts first; rows that repeat an id are documents of their own.
    Other columns go. A shard is built from at most ``SHARD_BYTES`` of text, or one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lut = Hasher(), letters_lut(digits=True)
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1), SHARD_BYTES):
                names, df, packed, ids, sizes = shard_postings(data, offsets, batch.column(0).slice(lo, hi - lo), hasher, lut)
                n = len(names)
                pad = lambda kind: pa.nulls(1, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n + 1, shard)),
                        pa.concat_arrays([pa.array(names, pa.string()), pad(pa.string())]),
                        pa.concat_arrays([pa.array(df, pa.int64()), pad(pa.int64())]),
                        pa.concat_arrays([packed, pad(pa.binary())]),
                        pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array([ids.to_pylist()], pa.list_(pa.int64()))]),
                        pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int64()))]),
                    ],
                    ["shard", "term", "df", "postings", "ids", "sizes"],
                )
                shard += 1

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return source.mapInArrow(run, "shard long, term string, df long, postings binary, ids array<long>, sizes array<long>")


def best_documents(lists: list[tuple[list[int], list[int], int]], k: int) -> list[tuple[int, int]]:
    """The k best (score, document), best first, equal scores by ascending document. lists: for each term the documents
    in ascending order, what each adds to its score, and the most that any adds.

    Terms are in two groups: those that together can't lift a document over the worst score kept are only looked up; the
    postings of the others are merged by a heap of cursors, so documents come in order, each with all its terms at once.
    """
    lists = sorted((x for x in lists if x[2] > 0), key=lambda x: x[2])
    reach = np.cumsum([x[2] for x in lists]).tolist()
    cursors = [(docs[0], t, 0) for t, (docs, _, _) in enumerate(lists)]
    heapify(cursors)
    kept: list[tuple[int, int]] = []  # (score, -document): the worst of the kept on top
    looked_up, least = 0, 0
    while cursors:
        doc, t, i = cursors[0]
        if t < looked_up:
            heappop(cursors)
            continue
        score = 0
        while cursors and cursors[0][0] == doc:
            _, t, i = cursors[0]
            docs, adds, _ = lists[t]
            if t >= looked_up:
                score += adds[i]
                if i + 1 < len(docs):
                    heapreplace(cursors, (docs[i + 1], t, i + 1))
                    continue
            heappop(cursors)
        for t in range(looked_up - 1, -1, -1):
            if score + reach[t] <= least:
                break
            docs, adds, _ = lists[t]
            i = bisect_left(docs, doc)
            if i < len(docs) and docs[i] == doc:
                score += adds[i]
        if score <= least:
            continue
        if len(kept) < k:
            heappush(kept, (score, -doc))
        else:
            heappushpop(kept, (score, -doc))
        if len(kept) == k:
            least = kept[0][0]
            while looked_up < len(lists) and reach[looked_up] <= least:
                looked_up += 1
    return [(s, -d) for s, d in sorted(kept, reverse=True)]


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0)))


def search(index: DataFrame, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) for each item its k best documents with a score above 0, from rank 1.

    Scores are whole numbers by document frequency, frequency in the document, and the document's share of the mean
    length; equal ones go by ascending doc_id (null first), then in any way. An item without a term, or whose terms no document
    holds, has no rows; rows that repeat an item are items of their own. Items of any number are fine: they go to the
    shards in blocks. An empty index or item table gives an empty result.
    """
    asked = materialise(items.select(F.col(item_col).alias("item_id"), _terms(F.col(text_col)).alias("terms")).withColumn("item", F.monotonically_increasing_id()), "items")
    blocks = max(1, ceil(asked.count() / ITEM_BLOCK))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    terms = asked.select(block.alias("block"), "item", F.explode("terms").alias("term"))
    shards = index.where("term is null")
    filled = F.filter("sizes", lambda n: n > 0)
    docs, length = shards.agg(F.sum(F.size(filled)), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()
    docs, length = docs or 0, length or 1
    found = index.where("term is not null").join(terms.select("term").distinct(), "term", "left_semi")
    weight = F.floor(F.lit(1000) * F.log(F.lit(float(2 * docs + 2)) / (F.lit(2) * F.sum("df") + F.lit(1)).cast("double"))).cast("long")
    weights = found.groupBy("term").agg(weight.alias("weight")).where("weight > 0")
    asking = terms.join(weights, "term").groupBy("block", "term", "weight").agg(F.collect_list("item").alias("items"))
    hits = index.where("term is not null").select("shard", "term", "postings").join(asking, "term").select("shard", "block", "weight", "items", "postings")
    homes = shards.select(F.col("shard").alias("home"), "ids", "sizes", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("in_block"))

    def rank(hits: pa.Table, home: pa.Table) -> pa.Table:
        of: dict[int, list] = {}
        if len(home) and len(hits):
            ids, sizes = home.column("ids")[0].as_py(), np.array(home.column("sizes")[0].as_py(), np.int64)
            norm = 20 * (100 - 50 + 50 * sizes * docs // length)
            for weight, wanted, raw in zip(hits.column("weight").to_pylist(), hits.column("items").to_pylist(), hits.column("postings").to_pylist(), strict=True):
                both = unpack_ints(raw)
                at, tf = np.cumsum(both[::2]), both[1::2]
                adds = weight * (1_000_000_000 * tf // (1000 * tf + norm[at]))
                entry = (at.tolist(), adds.tolist(), int(adds.max()))
                for item in wanted:
                    of.setdefault(item, []).append(entry)
        best = [(item, ids[d], s) for item, lists in of.items() for s, d in best_documents(lists, k)]
        return pa.table({"item": pa.array([b[0] for b in best], pa.int64()), "doc_id": pa.array([b[1] for b in best], pa.int64()), "score": pa.array([b[2] for b in best], pa.int64())})

    hits = hits.repartition(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "block")  # few bytes, much work
    local = hits.groupBy("shard", "block").cogroup(homes.groupBy("home", "in_block")).applyInArrow(rank, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    top = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item, among all documents."""
    index = materialise(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")), "postings")
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM d) GROUP BY d, term),
g AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT i, item_id, unnest(list_distinct(w)) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_WORDS} AS w FROM benchmark)),
t AS (SELECT i, item_id, term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS wt FROM i JOIN f USING (term), g),
s AS (SELECT i, item_id, d.d, doc_id, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(w) * nd) // l)))) AS BIGINT) AS score
  FROM t JOIN p USING (term) JOIN d ON d.d = p.d, g GROUP BY i, item_id, d.d, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
