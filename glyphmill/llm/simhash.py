"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced comparison.

Fingerprints are compared where they can be near at all: 64 bits are cut into radius + 2 parts, so two fingerprints
within the radius agree on two whole parts, and each pair of parts gives a table of buckets. Inside buckets the bits
stand in vertical planes, one 64-bit word for 64 comparisons, and carry-save counters add up the differing bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.arrowtext import Hasher, mix, pair, text_chunks, word_ranges, words_lut
from glyphmill.llm.components import components
from glyphmill.session import materialise

BITS = 64
_ROWS = 4096


def fingerprint_bytes(text: bytes, shingle_words: int, seed: int) -> int:
    """The fingerprint of one text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(words))
    n = len(words) - k + 1
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _ROWS):
        m = min(_ROWS, n - at)
        cut = map(joined.__getitem__, map(slice, starts[at : at + m].tolist(), ends[at + k - 1 : at + k - 1 + m].tolist()))
        h = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(seed)), np.uint64, m)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(((counts * 2 > n).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row per document. A null or wordless text has fingerprint zero; a text of fewer words than a
    shingle is one shingle. Whole texts are read, batch by batch; nothing is kept between rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, data, offs in text_chunks(batch.column(1), 4 << 20):
                raw = data.tobytes()
                found += [fingerprint_bytes(raw[offs[i] : offs[i + 1]], shingle_words, seed) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _parts(radius: int) -> list[int]:
    """Masks of radius + 2 parts of the 64 bits, as signed values."""
    edges = [round(i * BITS / (radius + 2)) for i in range(radius + 3)]
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within(planes: np.ndarray, shifted: np.ndarray, alive: np.ndarray, radius: int) -> np.ndarray:
    """Lanes (bits of words) of two sets of planes that differ in at most ``radius`` of them, among those alive.

    Three planes at a time go through a full adder; sums and carries run up bit-sliced counters. A block is given up
    as soon as each of its lanes is beyond the radius.
    """
    width = max(1, radius.bit_length())
    counters = [np.zeros_like(alive) for _ in range(width)]
    over = ~alive

    def add(x: np.ndarray, level: int) -> None:
        nonlocal over
        for i in range(level, width):
            carry = counters[i] & x
            counters[i] ^= x
            x = carry
        over |= x

    def beyond() -> np.ndarray:
        """Lanes whose count exceeds the radius, compared bit by bit from the top."""
        more, same = over.copy(), ~over
        for i in reversed(range(width)):
            if radius >> i & 1:
                same &= counters[i]
            else:
                more |= same & counters[i]
                same &= ~counters[i]
        return more

    for p in range(0, len(planes), 3):
        x = planes[p : p + 3] ^ shifted[p : p + 3]
        if len(x) == 3:
            half = x[0] ^ x[1]
            add(half ^ x[2], 0)
            if width > 1:
                add((x[0] & x[1]) | (half & x[2]), 1)
            else:
                over |= (x[0] & x[1]) | (half & x[2])
        else:
            for plane in x:
                add(plane, 0)
        if p % 12 == 9 and (beyond() == ~np.uint64(0)).all():
            return np.zeros_like(alive)
    return ~beyond()


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the smallest that it's linked to through pairs (a, b)."""
    label = np.arange(n)
    while True:
        hi, lo = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        if (hi == lo).all():
            return label
        np.minimum.at(label, hi, lo)
        while not (label[label] == label).all():
            label = label[label]


def near_rows(fps: np.ndarray, groups: np.ndarray, radius: int, roots: np.ndarray | None = None, block_words: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of row numbers within the radius in the same group (and of different roots), bit by bit.

    fps has a row of one or more 64-bit words for each fingerprint; rows of one group are adjacent. For each distance of
    two rows in a group, all groups that have it are compared at once, 64 pairs a word."""
    edge = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    sizes = np.diff(np.concatenate((edge, [len(fps)])))
    keep = np.argsort(-sizes, kind="stable")
    keep = keep[sizes[keep] > 1]
    if not len(keep):
        return
    sizes, edge = sizes[keep], edge[keep]
    rows = np.repeat(edge - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    fps, size_of, n = np.ascontiguousarray(fps[rows]), np.repeat(sizes, sizes), int(sizes.sum())
    roots = None if roots is None else roots[rows]
    rank = np.arange(n) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    words, depth = -(-n // 64) + 2, 64 * fps.shape[1]
    bits = np.zeros((depth, words * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)
    del bits
    for d in range(1, int(sizes[0])):
        m = int(np.searchsorted(-size_of, -d, side="left"))  # groups of more than d rows come first
        live = np.zeros(words * 64, np.uint8)
        live[:m] = rank[:m] + d < size_of[:m]
        if roots is not None:
            live[: min(m, n - d)] &= roots[: min(m, n - d)] != roots[d : d + min(m, n - d)]
        live = np.packbits(live, bitorder="little").view("<u8").astype(np.uint64)
        skip, turn = divmod(d, 64)
        for w in range(0, -(-m // 64), block_words):
            to = min(-(-m // 64), w + block_words)
            alive = live[w:to]
            if not alive.any():
                continue
            high = planes[:, w + skip : to + skip + 1]
            if high.shape[1] < to - w + 1:
                high = np.pad(high, ((0, 0), (0, to - w + 1 - high.shape[1])))
            shifted = high[:, :-1] if not turn else (high[:, :-1] >> np.uint64(turn)) | (high[:, 1:] << np.uint64(64 - turn))
            hit = within(planes[:, w:to], shifted, alive, radius)
            if hit.any():
                at = np.flatnonzero(np.unpackbits(hit.astype("<u8").view(np.uint8), bitorder="little")) + w * 64
                yield rows[at], rows[at + d]


def bucket_links(fps: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span all pairs within the radius in the same group, as pairs of row numbers."""
    label, pend_a, pend_b, held = np.arange(len(fps)), [], [], 0
    for a, b in near_rows(fps, groups, radius):
        pend_a.append(a)
        pend_b.append(b)
        held += len(a)
        if held > 1 << 20:
            label = _stars(len(fps), np.concatenate([*pend_a, np.arange(len(fps))]), np.concatenate([*pend_b, label]))
            pend_a, pend_b, held = [], [], 0
    label = _stars(len(fps), np.concatenate([*pend_a, np.arange(len(fps))]), np.concatenate([*pend_b, label]))
    at = np.flatnonzero(label != np.arange(len(fps)))
    return at, label[at]


def link_buckets(rows: DataFrame, words: list[str], radius: int, block: int) -> DataFrame:
    """Links (a, b) between nodes that span all pairs within the radius in the same bucket.

    rows: node, t and key (the bucket), and the fingerprint's words. Buckets of one node go at once. A bucket of more
    than ``block`` is dealt out as pairs of blocks, so that no task holds more than two blocks of it, whatever its
    size; each pair of blocks returns a spanning forest.
    """
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = (
        rows.join(sizes, ["t", "key"])
        .withColumn("g", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
        .withColumn("other", F.explode(F.when(F.col("g") > 1, F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array(F.lit(0)))))
        .where("g = 1 or own != other")
        .withColumn("grp", F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")))
        .select("grp", "node", *words)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2 + len(words)), np.int64)

        def out(rows: np.ndarray) -> pa.RecordBatch:
            a, b = bucket_links(np.ascontiguousarray(rows[:, 2:]).view(np.uint64), rows[:, 0], radius)
            return pa.RecordBatch.from_arrays([pa.array(rows[a, 1], pa.int64()), pa.array(rows[b, 1], pa.int64())], ["a", "b"])

        for batch in batches:
            held = np.concatenate((held, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])))
            if len(held) >= 1 << 16:
                cut = int(np.searchsorted(held[:, 0], held[-1, 0], side="left"))  # the last group may go on
                if cut:
                    yield out(held[:cut])
                    held = held[cut:]
        if len(held):
            yield out(held)

    return dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a long, b long")


def fingerprint_links(nodes: DataFrame, radius: int = 4, block: int = 1024) -> DataFrame:
    """Links (a, b) that span all pairs of distinct 64-bit fingerprints ``fp`` within the radius; none is missed."""
    masks = _parts(radius)
    tables = [_signed(masks[i] | masks[j]) for i, j in combinations(range(len(masks)), 2)]
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(tables)]))
    return link_buckets(nodes.select("fp", spread.alias("x")).select(F.col("fp").alias("node"), "x.t", "x.key", "fp"), ["fp"], radius, block)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): one row per document, with the smallest doc_id of its component.

    Documents of one fingerprint are one node, so groups of copies of any size collapse in a partial aggregate.
    A null doc_id is linked like any other but never names a component that has another id; rows of a repeated
    doc_id each get a row. Ties can't arise: component_id is a minimum. Other columns are ignored; an empty table
    gives an empty result.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle_words, seed), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(fingerprint_links(nodes.select("fp"), radius))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("first").alias("component_id"))
    member = named.select("fp", "root").join(first, "root").select("fp", "component_id")
    return prints.join(member, "fp").select("doc_id", "fp", "component_id")


# Near-dedup at a similarity: candidates from prefixes, compared by wide fingerprints, verified by exact Jaccard similarity.

#: 64-bit words of a set's fingerprint.
WIDE = 2
#: Shingles in more documents than COMMON come last in the order that prefixes are cut from. They are estimated from one
#: document in SAMPLE, and at most MOST_COMMON of them are broadcast; the order decides the work, not the result.
COMMON, SAMPLE, MOST_COMMON = 64, 16, 1 << 19
#: Least bits of a set's parity sketch: a key flips one of them, so two sketches differ in no more bits than the sets in
#: keys. A sketch has a power of two of them, at least the set's size, and folds to the length of a shorter one.
SKETCH = 1024


def radius_at(similarity: float, bits: int = WIDE * 64) -> int:
    """The bits of two sets' fingerprints that differ at this Jaccard similarity, in the mean and five standard deviations
    more. One bit differs with probability acos(2s / (1 + s)) / pi; in small sets a tie of the bits makes it up to a third
    more. At 0.8 and 128 bits a pair is beyond it with probability below 1e-6."""
    p = min(0.5, math.acos(2 * similarity / (1 + similarity)) / math.pi * 4 / 3)
    return min(bits, round(bits * p + 5 * math.sqrt(bits * p * (1 - p))))


def shingle_keys(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, lut: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the k-word shingles of each text (of all its words, if they're fewer), and where each text's begin."""
    starts, ends, first = word_ranges(data, offsets, lut)
    h, n = hasher(data, starts, ends), np.diff(first)
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], size)
    last = np.repeat(first[1:] - 1, size)
    key = h[at]
    for i in range(1, k):
        there = at + i <= last
        key[there] = pair(key[there], h[at[there] + i])
    return key, bounds


def _sets(keys: np.ndarray, bounds: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of each text, those of the sorted ``common`` last and else in order; where each text's begin; and
    a hash of each set."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    keys, text = keys[new], text[new]
    if len(common) and len(keys):
        last = common[np.minimum(np.searchsorted(common, keys), len(common) - 1)] == keys
        order = np.lexsort((last, text))  # stable, so each part stays in order
        keys = keys[order]
    first = np.searchsorted(text, np.arange(len(bounds)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(keys ^ np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)))
    return keys, first, sums[first[1:]] - sums[first[:-1]]


def _prefix(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many first keys of a set of n, in one order for all sets, hold one of any set of this similarity to it."""
    return np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)


def _lists(keys: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """For each text its first ``size`` keys."""
    edges = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(edges[-1]) - np.repeat(edges[:-1] - first[:-1], size)
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(keys[at].view(np.int64)))


def set_fingerprints(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of WIDE words for each set of keys: a bit is 1 if it's set in over half the keys' hashes."""
    sets = len(first) - 1
    owner = np.repeat(np.arange(sets), np.diff(first))
    out = np.zeros((sets, WIDE), np.uint64)
    for w in range(WIDE):
        counts = np.zeros((sets, 64), np.int64)
        for at in range(0, len(keys), _ROWS * 16):
            h = mix(keys[at : at + _ROWS * 16] ^ np.uint64((w + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whose = owner[at : at + _ROWS * 16]
            edge = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
            counts[whose[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
        out[:, w] = ((counts * 2 > np.diff(first)[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def _sketches(keys: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """The parity sketch of each text's keys, folded to SKETCH bits and as it is."""
    n = np.diff(first)
    size = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    edges = np.concatenate(([0], np.cumsum(size)))
    cell = np.repeat(edges[:-1], n) + (mix(keys ^ np.uint64(SKETCH)) & np.repeat(size - 1, n).astype(np.uint64)).astype(np.int64)
    flat = np.packbits((np.bincount(cell, minlength=edges[-1]) & 1).astype(np.uint8), bitorder="little").view(np.uint64)
    parts = [flat[a:b] for a, b in zip((edges[:-1] // 64).tolist(), (edges[1:] // 64).tolist(), strict=True)]
    return [pa.array([_folded(x, SKETCH // 64).tobytes() for x in parts], pa.binary()), pa.array([x.tobytes() for x in parts], pa.binary())]


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def shingle_sets(docs: DataFrame, shingle_words: int, similarity: float | None = None, common: np.ndarray | None = None) -> DataFrame:
    """(doc_id, text_hash, node, n, keys, f0, f1, short, sketch) for documents (doc_id, text_hash, text): the hash and the size of the set
    of lower-case word shingles of each whole text, and its keys; with a similarity only those of its prefix, and the set's
    fingerprint and its sketch, folded to SKETCH bits and as it is. A text of fewer words than a shingle is one shingle, one without words has none."""
    last = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64) if common is None else common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lut = Hasher(), words_lut()
        for batch in batches:
            for a, b, data, offs in text_chunks(batch.column(2), 1 << 20):
                keys, first, node = _sets(*shingle_keys(data, offs, hasher, lut, shingle_words), last.value)
                n = np.diff(first)
                for lo in range(0, b - a, 1024):
                    hi = min(b - a, lo + 1024)
                    at = first[lo : hi + 1]
                    listed = _lists(keys, at, n[lo:hi] if similarity is None else _prefix(n[lo:hi], similarity))
                    if similarity is None:
                        told = [pa.nulls(hi - lo, pa.int64())] * WIDE + [pa.nulls(hi - lo, pa.binary())] * 2
                    else:
                        own, edges = keys[at[0] : at[-1]], at - at[0]
                        told = [pa.array(f.view(np.int64)) for f in np.ascontiguousarray(set_fingerprints(own, edges).T)] + _sketches(own, edges)
                    cols = [batch.column(c).slice(a + lo, hi - lo) for c in (0, 1)]
                    cols += [pa.array(node[lo:hi].view(np.int64)), pa.array(n[lo:hi], pa.int64()), listed, *told]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "node", "n", "keys", "f0", "f1", "short", "sketch"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, node long, n long, keys array<long>, f0 long, f1 long, short binary, sketch binary")


def _may(differ: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes together, whose sketches differ in so many bits, can have the similarity."""
    return differ <= sizes * ((1 - similarity) / (1 + similarity)) + 1e-6


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sketches allow the similarity; none that has it is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = np.zeros(len(batch), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                words = min(len(x), len(y)) // 8
                differ[i] = np.bitwise_count(_folded(np.frombuffer(x, np.uint64), words) ^ _folded(np.frombuffer(y, np.uint64), words)).sum(dtype=np.int64)
            keep = _may(differ, batch.column(2).to_numpy() + batch.column(3).to_numpy(), similarity)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    sides = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def near_across(rows: DataFrame, similarity: float, block: int) -> DataFrame:
    """The pairs (a, b) of nodes in one bucket and of different roots whose fingerprints are within the similarity's radius
    and whose sketches allow it.

    rows: key (the bucket), c (its size), node, root, n, f0, f1 and short. As in link_buckets a bucket of more than ``block``
    is dealt out as pairs of blocks, and pairs are formed bit-sliced inside a task, so only those that pass become rows."""
    radius, words = radius_at(similarity), SKETCH // 64
    dealt = (
        rows.withColumn("g", F.ceil(F.col("c") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
        .withColumn("other", F.explode(F.when(F.col("g") > 1, F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array(F.lit(0)))))
        .where("g = 1 or own != other")
        .withColumn("grp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
        .select("grp", "node", "root", "n", "f0", "f1", "short")
    )

    def out(held: pa.Table) -> pa.RecordBatch:
        grp, node, root, n, *prints = (held.column(c).to_numpy() for c in range(4 + WIDE))
        sketch = np.frombuffer(b"".join(held.column("short").to_pylist()), np.uint64).reshape(-1, words)
        found = [np.zeros((0, 2), np.int64)]
        for x, y in near_rows(np.column_stack(prints).view(np.uint64), grp, radius, root):
            fit = np.minimum(n[x], n[y]) >= np.maximum(n[x], n[y]) * similarity - 1e-9
            x, y = x[fit], y[fit]
            fit = _may(np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64), n[x] + n[y], similarity)
            x, y = node[x[fit]], node[y[fit]]
            found.append(np.column_stack((np.minimum(x, y), np.maximum(x, y))))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held is not None else new
            if len(held) >= 1 << 15:
                grp = held.column(0).to_numpy()
                cut = int(np.argmax(grp == grp[-1]))  # the last group may go on
                if cut:
                    yield out(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and len(held):
            yield out(held)

    return dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a long, b long").distinct()


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, keys in order) have this Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = []
            for i in range(len(batch)):
                u, v = x[i].values.to_numpy(), y[i].values.to_numpy()
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(both >= similarity * (len(u) + len(v) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    held = pairs.join(sets.select(F.col("node").alias("a"), F.col("keys").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("keys").alias("y")), "b")
    return held.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, block: int = 1024) -> DataFrame:
    """The documents without near copies: of each group linked by similarity the one of the smallest id stays.

    The similarity is the Jaccard similarity of sets of word shingles. With all sets in one order, two that have it share a
    key of their prefixes; documents of one set are one node. In each bucket of a shared key all nodes are compared with
    the smallest, by sketches that lose no pair; those that are not yet linked are compared with each other by bit-sliced
    SimHash fingerprints of the sets (a pair is lost with probability below 1e-6 at 0.8, see radius_at) and by sketches.
    What passes is verified by the exact similarity of the whole sets.

    A null id comes last, equal ids by the hash of the text; rows that repeat id and text are one document and the
    one of the least hash over its columns (but maps) stays. Texts without words are one group. All columns stay as they are; an empty table gives an empty result.
    """
    text = F.col(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    seen = shingle_sets(source.where(F.pmod(F.xxhash64(F.lit(3), "text_hash"), F.lit(SAMPLE)) == 0), shingle_words).select(F.explode("keys").alias("key"))
    counted = seen.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > COMMON // SAMPLE).orderBy(F.desc("c"), "key").limit(MOST_COMMON)
    common = np.sort(np.array([r.key for r in counted.select("key").collect()], np.int64).view(np.uint64))  # at most MOST_COMMON
    prints = shingle_sets(source, shingle_words, similarity, common)
    rank = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"), F.col("text_hash"))
    nodes = materialise(prints.groupBy("node").agg(F.min(rank).alias("first"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), *[F.any_value(c).alias(c) for c in ("f0", "f1", "short", "sketch")]), "set-nodes")
    entries = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("least"), F.min_by("n", "node").alias("least_n")).where("c > 1")
    rows = materialise(entries.join(shared, "key"), "set-buckets")
    fits = lambda x, y: F.least(x, y) >= F.greatest(x, y) * similarity - 1e-9

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "set-pairs")
        able = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "first"), "node")
        able = able.select(F.xxhash64("first.doc_id", F.lit(0), "first.text_hash").alias("_gm_key"))
        wanted = source.withColumn("_gm_key", F.xxhash64("doc_id", F.lit(0), "text_hash")).join(able, "_gm_key", "left_semi")
        sets = materialise(shingle_sets(wanted, shingle_words).groupBy("node").agg(F.any_value("keys").alias("keys")), "sets")
        return materialise(similar(pairs, sets, similarity), "set-links")

    stars = rows.where((F.col("node") != F.col("least")) & fits(F.col("n"), F.col("least_n"))).select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(possible(stars, nodes, similarity))
    rooted = rows.join(components(links).withColumnRenamed("root", "r"), "node", "left").select("key", "c", "node", "n", F.coalesce("r", "node").alias("root"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    left = rooted.join(apart, "key", "left_semi").join(nodes.select("node", "f0", "f1", "short"), "node")
    roots = components(links.unionByName(verified(possible(near_across(left, similarity, block), nodes, similarity))))

    group = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    keepers = group.agg(F.min("first").alias("first")).select(F.xxhash64("first.doc_id", F.lit(0), "first.text_hash").alias("_gm_key"))
    keyed = docs.withColumn("_gm_key", F.xxhash64(F.col(id_col).cast("long"), F.lit(0), F.xxhash64(text_col)))
    row = F.xxhash64(*[f.name for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)])
    kept = keyed.join(keepers, "_gm_key").groupBy("_gm_key").agg(F.min_by(F.struct(*docs.columns), row).alias("_gm_row"))
    return kept.select(*[F.col("_gm_row")[c].alias(c) for c in docs.columns])


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: 4-word shingles, links at 4 or fewer differing bits."""
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
