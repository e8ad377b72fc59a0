"""Language-model scoring from a log-frequency Bloom filter.

An n-gram of count c has the level 1 + floor(log2 c); the filter holds the pairs (n-gram, 1) .. (n-gram, level), so a
probe for rising levels that stops at the first miss gives the count back, quantised, and never too low. The filter is
cut into segments by n-gram key: one task counts the n-grams of one segment, sets its bits and probes them for the
n-grams of each block. Segments grow in number with the texts and in size with their n-grams, so false positives are as
rare in a large corpus as in a small one, and no task and no driver holds more than a segment. Smoothing is by a Dirichlet prior: P(w|u) = (c(uw) + mass * P(w)) / (c(u) + mass), P(w) with half a count added.

The corpus is read once and written as blocks of compressed texts, which later stages read; counts of whole blocks,
not rows, are shuffled. Beside the model stands an exact add-half unigram score from exact counts.
"""

from __future__ import annotations

import binascii
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.arrowtext import Hasher, mix, pair, text_chunks, word_ranges, words_lut
from glyphmill.session import materialise

_U = np.uint64
_END = _U(0x1F83D9ABFB41BD6B)
_BEGIN = _U(0x5BE0CD19137E2179)


@dataclass(frozen=True)
class LmModel:
    """Parameters: bits for each (n-gram, level), probes for each, the weight of the unigram prior, and the texts' bytes
    in a block and behind a segment of the filter."""

    bits_per_event: int = 12
    probes: int = 4
    prior_mass: float = 50.0
    block_bytes: int = 4 << 20
    segment_text_bytes: int = 16 << 20
    least_segments: int = 256
    folds: int = 5
    held_fold: int = 1


def crc_fold(ids: list, folds: int) -> np.ndarray:
    """crc32 of each id as text modulo folds; -1 for null."""
    return np.array([-1 if i is None else binascii.crc32(str(i).encode()) % folds for i in ids], np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count)."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def expected(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for level 0."""
    top = np.exp2(level.astype(np.float64))
    return np.where(level > 0, (top / 2 + top - 1) / 2, 0.0)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (((keys >> _U(32)) * _U(segments)) >> _U(32)).astype(np.int64)


def _first(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys ^ _U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def _position(h: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """A bit of the n-gram's segment, which has ``size`` bits."""
    return ((h >> _U(32)) * np.asarray(size, _U)) >> _U(32)


def build_segment(keys: np.ndarray, counts: np.ndarray, bits_per_event: int, probes: int, most_bytes: int | None = None) -> np.ndarray:
    """The bytes of a segment that holds all these n-grams; their number grows with the n-grams unless it's bounded."""
    level = levels(counts)
    nbytes = max(8, -(-int(level.sum()) * bits_per_event // 8))
    if most_bytes is not None:
        nbytes = min(nbytes, most_bytes)
    bits = np.zeros(nbytes * 8, np.uint8)
    for j in range(1, int(level.max(initial=0)) + 1):
        h = _first(keys[level >= j], j)
        step = mix(h) | _U(1)
        for _ in range(probes):
            bits[_position(h, nbytes * 8)] = 1
            h = h + step
    return np.packbits(bits, bitorder="little")


class Filter:
    """A filter: bytes of its segments one after the other, and the largest level that was written."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, probes: int, top: int = 64) -> None:
        self.data, self.offsets, self.probes, self.top = data, offsets, probes, top

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by probing rising levels until one is missing."""
        out = np.zeros(len(keys), np.int64)
        seg = segment_of(keys, len(self.offsets) - 1)
        base, size = self.offsets[seg], ((self.offsets[seg + 1] - self.offsets[seg]) * 8).astype(_U)
        at, level = np.flatnonzero(size), 1
        while len(at) and level <= self.top:
            h = _first(keys[at], level)
            step = mix(h) | _U(1)
            for _ in range(self.probes):
                p = _position(h, size[at])
                hit = (self.data[base[at] + (p >> _U(3)).astype(np.int64)] >> (p & _U(7)).astype(np.uint8)) & 1 == 1
                at, h, step = at[hit], h[hit], step[hit]
                h = h + step
            out[at] = level
            level += 1
        return out


class Grams:
    """Token and bigram keys of a block of texts, in order; each text ends in an end token and begins after a begin mark."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hasher: Hasher, lut: np.ndarray) -> None:
        starts, ends, first = word_ranges(data, offsets, lut)
        n, docs = len(starts), len(offsets) - 1
        self.sizes = np.diff(first) + 1
        self.doc = np.repeat(np.arange(docs), self.sizes)
        self.token = np.full(n + docs, _END, _U)
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))
        inner = np.ones(n + docs, bool)
        inner[self.bounds[1:] - 1] = False
        self.token[inner] = hasher(data, starts, ends)
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        self.before[self.bounds[:-1]] = _BEGIN
        self.bigram = pair(self.before, self.token)


def _counted(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs (among those of weight 1)."""
    found, back = np.unique(keys, return_inverse=True)
    return found, np.bincount(back, weight, len(found)).astype(np.int64)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as gaps, and counts, in little space: six bytes hold a gap unless one is larger."""
    gaps = np.diff(keys, prepend=_U(0))
    gaps[:1] = 0
    head = np.array([len(keys), int(keys[0]) if len(keys) else 0, int((gaps >> _U(48)).max(initial=0))], _U).tobytes()
    parts = [(gaps & _U(0xFFFFFFFF)).astype("<u4").tobytes(), ((gaps >> _U(32)) & _U(0xFFFF)).astype("<u2").tobytes()]
    if int((gaps >> _U(48)).max(initial=0)):
        parts.append((gaps >> _U(48)).astype("<u2").tobytes())
    narrow = np.minimum(counts, 255).astype(np.uint8)
    return head + b"".join(parts) + narrow.tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, start, wide = (int(x) for x in np.frombuffer(raw, _U, 3))
    at = 24
    gaps = np.frombuffer(raw, "<u4", n, at).astype(_U) | np.frombuffer(raw, "<u2", n, at + 4 * n).astype(_U) << _U(32)
    at += 6 * n
    if wide:
        gaps |= np.frombuffer(raw, "<u2", n, at).astype(_U) << _U(48)
        at += 2 * n
    narrow = np.frombuffer(raw, np.uint8, n, at)
    counts = narrow.astype(np.int64)
    large = np.flatnonzero(narrow == 255)
    counts[large] = np.frombuffer(raw, "<i8", len(large), at + n)
    keys = np.cumsum(gaps, dtype=_U) + _U(start)
    return keys, counts


def pack_blocks(docs: DataFrame, model: LmModel) -> DataFrame:
    """(block, n_bytes, payload): texts and ids in blocks of about block_bytes, compressed; each row is in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, made, part = zstandard.ZstdCompressor(level=1), 0, TaskContext.get().partitionId()
        waiting: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            nonlocal made
            made += 1
            ids = pa.concat_arrays([w[0] for w in waiting])
            data = np.concatenate([w[1] for w in waiting])
            sizes = np.concatenate([np.diff(w[2]) for w in waiting])
            known = np.array([i is not None for i in ids.to_pylist()])
            body = np.array([len(ids)], "<i8").tobytes() + ids.fill_null(0).to_numpy().astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + sizes.astype("<i8").tobytes() + data.tobytes()
            waiting.clear()
            cols = [[(part << 32) + made], [len(data)], [squeeze.compress(body)]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["block", "n_bytes", "payload"])

        held = 0
        for batch in batches:
            for a, b, data, offs in text_chunks(batch.column(1), model.block_bytes):
                waiting.append((batch.column(0).slice(a, b - a), data, offs))
                held += len(data)
                if held >= model.block_bytes // 2 or sum(len(w[0]) for w in waiting) >= 20_000:
                    yield out()
                    held = 0
        if waiting:
            yield out()

    return docs.mapInArrow(run, "block long, n_bytes long, payload binary")


def _unpack_block(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(body, "<i8", 1)[0])
    ids = np.frombuffer(body, "<i8", n, 8).tolist()
    known = np.frombuffer(body, np.uint8, n, 8 + 8 * n)
    sizes = np.frombuffer(body, "<i8", n, 8 + 9 * n)
    data = np.frombuffer(body, np.uint8, -1 if 8 + 17 * n < len(body) else 0, 8 + 17 * n)
    return [i if k else None for i, k in zip(ids, known, strict=True)], data, np.concatenate(([0], np.cumsum(sizes)))


def _count_blocks(blocks: DataFrame, model: LmModel, segments: int) -> DataFrame:
    """(seg, block, tokens, bigrams): for each block and segment the block's distinct tokens and bigrams with their counts
    in learnt documents (0 for those that only others have)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lut = Hasher(), words_lut()
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, data, offs = _unpack_block(raw)
                learn = crc_fold(ids, model.folds) != model.held_fold
                g = Grams(data, offs, hasher, lut)
                w = learn[g.doc].astype(np.float64)
                tokens, tc = _counted(g.token, w)
                bigrams, bc = _counted(g.bigram, w)
                begin = int(learn.sum())
                edges = np.arange(segments + 1)
                ta, ba = np.searchsorted(segment_of(tokens, segments), edges), np.searchsorted(segment_of(bigrams, segments), edges)
                some = [s for s in range(segments) if ta[s] < ta[s + 1] or ba[s] < ba[s + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int32()),
                        pa.array([block] * len(some), pa.int64()),
                        pa.array([begin if s == some[0] else 0 for s in some], pa.int64()),
                        pa.array([_pack(tokens[ta[s] : ta[s + 1]], tc[ta[s] : ta[s + 1]]) for s in some], pa.binary()),
                        pa.array([_pack(bigrams[ba[s] : ba[s + 1]], bc[ba[s] : ba[s + 1]]) for s in some], pa.binary()),
                    ],
                    ["seg", "block", "texts", "tokens", "bigrams"],
                )

    return blocks.select("block", "payload").mapInArrow(run, "seg int, block long, texts long, tokens binary, bigrams binary")


def _build_segments(counted: DataFrame, model: LmModel) -> DataFrame:
    """For each segment a row with its totals, and for each block a row with the exact counts of its tokens and the levels
    that the segment's filter gives its tokens and bigrams."""

    def merged(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, their counts, and for each block's keys their places, from edge to edge."""
        parts = [_unpack(x) for x in packed]
        keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)
        return keys, counts, back, np.cumsum([0] + [len(k) for k, _ in parts])

    def run(table: pa.Table) -> pa.Table:
        seg = table.column("seg")[0].as_py()
        blocks = table.column("block").to_pylist()
        keys, counts, back, edges = merged(table.column("tokens").to_pylist())
        pairs, pair_counts, at, pair_edges = merged(table.column("bigrams").to_pylist())
        known, met = counts > 0, pair_counts > 0
        learnt = np.concatenate((counts[known], pair_counts[met]))
        bits = build_segment(np.concatenate((keys[known], pairs[met])), learnt, model.bits_per_event, model.probes)
        found = Filter(bits, np.array([0, len(bits)]), model.probes, int(levels(learnt).max(initial=0)))
        single, both = found.level(keys).astype(np.uint8)[back], found.level(pairs).astype(np.uint8)[at]
        replies = [counts[back[a:b]].astype("<i8") for a, b in zip(edges[:-1], edges[1:], strict=True)]
        small = [np.array([int(r.max(initial=0) < 1 << 32)], np.uint8).tobytes() + (r.astype("<u4") if r.max(initial=0) < 1 << 32 else r).tobytes() for r in replies]
        texts = sum(table.column("texts").to_pylist())
        return pa.table(
            {
                "kind": pa.array([0] + [1] * len(blocks), pa.int32()),
                "seg": pa.array([seg] * (1 + len(blocks)), pa.int32()),
                "block": pa.array([None, *blocks], pa.int64()),
                "total": pa.array([int(counts.sum())] + [0] * len(blocks), pa.int64()),
                "types": pa.array([int(known.sum())] + [0] * len(blocks), pa.int64()),
                "texts": pa.array([texts] + [0] * len(blocks), pa.int64()),
                "payload": pa.array([None, *small], pa.binary()),
                "single": pa.array([None, *[single[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]], pa.binary()),
                "both": pa.array([None, *[both[a:b].tobytes() for a, b in zip(pair_edges[:-1], pair_edges[1:], strict=True)]], pa.binary()),
            }
        )

    return counted.groupBy("seg").applyInArrow(run, "kind int, seg int, block long, total long, types long, texts long, payload binary, single binary, both binary")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LmModel = LmModel()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row for each document.

    Learns from documents whose crc32(id as text) mod folds isn't held_fold; a null id counts as not held out. A null
    or empty text is one end token. Repeated rows are learnt and scored each on its own. Without learnt tokens, N and
    V are 0 and each token has probability one. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    blocks = materialise(pack_blocks(docs.select(F.col(id_col).cast("long"), F.col(text_col)), model), "lm-blocks", "none")
    text_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    segments = max(model.least_segments, -(-text_bytes // model.segment_text_bytes))
    built = materialise(_build_segments(_count_blocks(blocks, model, segments), model), "lm-segments", "none")
    sums = built.where("kind = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "types", "texts")]).first()
    total, types, begins = (int(x) for x in sums)
    floor = total + 0.5 * (types + 1)

    def run(table: pa.Table) -> pa.Table:
        kinds, segs, payloads = (table.column(c).to_pylist() for c in ("kind", "seg", "payload"))
        ids, text, offs = _unpack_block(payloads[kinds.index(0)])
        order = sorted((s, i) for i, (k, s) in enumerate(zip(kinds, segs, strict=True)) if k)
        single, both = (np.frombuffer(b"".join(table.column(c)[i].as_py() for _, i in order), np.uint8) for c in ("single", "both"))
        g = Grams(text, offs, Hasher(), words_lut())
        keys, back = np.unique(g.token, return_inverse=True)
        exact = np.concatenate([np.frombuffer(p, "<u4" if p[0] else "<i8", offset=1).astype(np.int64) for p in (payloads[i] for _, i in order)] or [np.zeros(0, np.int64)])
        n, first = len(g.sizes), g.bounds[:-1]
        base = np.add.reduceat(np.log10((exact + 0.5) / floor)[back], first) if n else np.zeros(0)
        known = np.add.reduceat((exact > 0).astype(np.int64)[back], first) if n else np.zeros(0, np.int64)
        single = expected(single)
        _, at = np.unique(g.bigram, return_inverse=True)
        both = expected(both)[at]
        context = np.concatenate((single[back][:-1], [0.0])) if len(back) else np.zeros(0)
        context = np.roll(context, 1)
        context[first] = begins
        prior = ((single + 0.5) / floor)[back]
        p = (np.minimum(both, context) + model.prior_mass * prior) / (context + model.prior_mass)
        score = np.add.reduceat(np.log10(p), first) if n else np.zeros(0)
        out = {
            "doc_id": pa.array(ids, pa.int64()),
            "held_out": pa.array(crc_fold(ids, model.folds) == model.held_fold, pa.bool_()),
            "n_tokens": pa.array(g.sizes, pa.int64()),
            "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array(np.full(n, total), pa.int64()),
            "base_score": pa.array(base, pa.float64()),
            "score": pa.array(score, pa.float64()),
        }
        return pa.table(out)

    parts = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).alias("seg"), "payload").unionByName(
        built.where("kind = 1").select("block", "kind", "seg", "payload", "single", "both"), allowMissingColumns=True
    )
    return parts.groupBy("block").applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: crc32 folds of five, fold 1 held out, a bigram model."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
