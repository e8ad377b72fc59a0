"""Encoding with a vocabulary: best, n-best and longest-match segmentations, surface forms, and unigram training.

Segmentation is a dynamic programme, which Spark's expressions don't have; it runs in Arrow batches over distinct
pre-tokens, whose number grows far slower than the corpus, and joins back.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions.text import byte_alphabet
from glyphmill.session import materialise, spread

FLOOR = -100000.0
#: Characters up to which expected counts are summed as probabilities, and what a character's logarithm is raised by meanwhile.
SHORT, LIFT = 32, 4.0
_PIECES = T.StructField("pieces", T.ArrayType(T.StringType()))


def best_segmentation(text: str, scores: dict[str, float], longest: int) -> list[str]:
    """The pieces with the highest sum of scores; ties go to fewer pieces, then to longer first pieces. A character
    that no piece covers stands alone at the floor."""
    n = len(text)
    best: list[tuple[float, int] | None] = [None] * n + [(0.0, 0)]
    step = [1] * n
    for i in reversed(range(n)):
        for k in range(1, min(longest, n - i) + 1):
            s = scores.get(text[i : i + k], FLOOR if k == 1 else None)
            if s is None:
                continue
            value = (best[i + k][0] + s, best[i + k][1] - 1)
            if best[i] is None or value > best[i] or (value == best[i] and k > step[i]):
                best[i], step[i] = value, k
    out, i = [], 0
    while i < n:
        out.append(text[i : i + step[i]])
        i += step[i]
    return out


def n_best_segmentations(text: str, scores: dict[str, float], longest: int, n: int) -> list[list[str]]:
    """The n best segmentations into known pieces, best first; ties by fewer pieces, then by the pieces."""
    best: list[list[tuple[float, int, tuple[str, ...]]]] = [[] for _ in range(len(text))] + [[(0.0, 0, ())]]
    for i in reversed(range(len(text))):
        found = []
        for k in range(1, min(longest, len(text) - i) + 1):
            piece = text[i : i + k]
            if piece in scores:
                found += [(s + scores[piece], m + 1, (piece, *rest)) for s, m, rest in best[i + k]]
        best[i] = sorted(found, key=lambda x: (-x[0], x[1], x[2]))[:n]
    return [list(x[2]) for x in best[0]] if text else [[]]


def longest_match(text: str, pieces: set[str], longest: int) -> list[str]:
    """Greedy longest match from the left; an uncovered character stands alone."""
    out, i = [], 0
    while i < len(text):
        k = next((k for k in range(min(longest, len(text) - i), 0, -1) if text[i : i + k] in pieces), 1)
        out.append(text[i : i + k])
        i += k
    return out


def merge_encode(text: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Byte-pair encoding: the lowest-ranked merge first, leftmost of equal ones. Parts are a linked list and possible merges
    a heap, so n characters take n log n steps."""
    n, parts = len(text), list(text)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or ranks.get((parts[i], parts[j])) != rank:
            continue  # one of the two is in another part by now
        parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
        if after[i] < n:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (parts[left], parts[right]) in ranks:
                heappush(heap, (ranks[parts[left], parts[right]], left))
    return [p for p in parts if p is not None]


def encode(counts: DataFrame, vocab: dict[str, float], name: str = "pretoken") -> DataFrame:
    """Adds pieces, the best segmentation of each distinct pre-token. The vocabulary is broadcast: it has a stated size."""
    held = counts.sparkSession.sparkContext.broadcast((vocab, max(map(len, vocab), default=1)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores, longest = held.value
        for frame in frames:
            yield frame.assign(pieces=[best_segmentation(t, scores, longest) for t in frame[name]])

    return spread(counts, name).mapInPandas(run, T.StructType([*counts.schema.fields, _PIECES]))


def n_best(counts: DataFrame, vocab: dict[str, float], n: int, name: str = "pretoken") -> DataFrame:
    """(.., rank, pieces): the n best segmentations of each distinct pre-token."""
    held = counts.sparkSession.sparkContext.broadcast((vocab, max(map(len, vocab), default=1)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores, longest = held.value
        for frame in frames:
            found = [n_best_segmentations(t, scores, longest, n) for t in frame[name]]
            wide = frame.assign(pieces=found).explode("pieces", ignore_index=True).dropna(subset=["pieces"])
            yield wide.assign(rank=wide.groupby(name).cumcount())[[*frame.columns, "rank", "pieces"]]

    return spread(counts, name).mapInPandas(run, T.StructType([*counts.schema.fields, T.StructField("rank", T.LongType()), _PIECES]))


def longest_matches(counts: DataFrame, pieces: set[str], name: str = "pretoken") -> DataFrame:
    """Adds pieces, the greedy longest match of each distinct pre-token."""
    held = counts.sparkSession.sparkContext.broadcast((pieces, max(map(len, pieces), default=1)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, longest = held.value
        for frame in frames:
            yield frame.assign(pieces=[longest_match(t, known, longest) for t in frame[name]])

    return spread(counts, name).mapInPandas(run, T.StructType([*counts.schema.fields, _PIECES]))


def merge_encoded(counts: DataFrame, merges: DataFrame, name: str = "pretoken") -> DataFrame:
    """Adds pieces, the byte-pair encoding of each distinct pre-token by merges (rank, left, right). They are broadcast: a
    vocabulary's merges have a stated size."""
    held = counts.sparkSession.sparkContext.broadcast({(r["left"], r["right"]): r["rank"] for r in merges.collect()})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(pieces=[merge_encode(t, held.value) for t in frame[name]])

    return spread(counts, name).mapInPandas(run, T.StructType([*counts.schema.fields, _PIECES]))


def rivals(encodings: DataFrame, wanted: str = "wanted") -> DataFrame:
    """Encodings that aren't the wanted one."""
    return encodings.where(F.col("pieces") != F.col(wanted))


def byte_surfaces(vocab: DataFrame, maxlen: int, fill: int = 0) -> DataFrame:
    """(id, surface, truncated): byte ids of each byte-level piece, cut or filled to maxlen; a special piece has its own
    id first."""
    table = F.create_map(*[F.lit(x) for b, c in byte_alphabet().items() for x in (c, b)])
    ids = F.transform(F.split("piece", ""), lambda c: F.element_at(table, c))
    ids = F.when(F.col("is_special"), F.array(F.col("id"))).otherwise(ids)
    out = vocab.select("id", ids.alias("_x"))
    cut = F.concat(F.slice("_x", 1, maxlen), F.array_repeat(F.lit(fill), F.greatest(F.lit(maxlen) - F.size("_x"), F.lit(0))))
    return out.select("id", cut.alias("surface"), (F.size("_x") > maxlen).alias("truncated"))


def encoded_surfaces(vocab: DataFrame, scores: dict[str, float], ids: dict[str, int], maxlen: int, fill: int = 0, unknown: int = 0) -> DataFrame:
    """(id, surface, truncated): ids of each piece's best segmentation by another vocabulary, cut or filled to maxlen; a
    special piece has its own id first."""
    table = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    found = F.transform("pieces", lambda p: F.coalesce(F.element_at(table, p), F.lit(unknown)))
    out = encode(vocab.select("id", "piece", "is_special"), scores, "piece").select("id", F.when(F.col("is_special"), F.array("id")).otherwise(found).alias("_x"))
    cut = F.concat(F.slice("_x", 1, maxlen), F.array_repeat(F.lit(fill), F.greatest(F.lit(maxlen) - F.size("_x"), F.lit(0))))
    return out.select("id", cut.alias("surface"), (F.size("_x") > maxlen).alias("truncated"))


def identity_surfaces(vocab: DataFrame) -> DataFrame:
    return vocab.select("id", F.array("id").alias("surface"))


def _sums(counts: DataFrame, each: Callable[[str], dict[str, float]]) -> dict[str, float]:
    """Sums by piece of what ``each`` gives for a text (pretoken, n), times its count. Tasks add up first; to the driver comes a
    number for each piece of the vocabulary."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums: dict[str, float] = {}
            for text, n in zip(frame["pretoken"], frame["n"], strict=True):
                for piece, x in each(text).items():
                    sums[piece] = sums.get(piece, 0.0) + x * n
            if sums:
                yield pd.DataFrame({"piece": list(sums), "x": list(sums.values())})

    found = counts.mapInPandas(run, "piece string, x double").groupBy("piece").agg(F.sum("x").alias("x"))
    return {r.piece: r.x for r in found.collect()}


def removal_losses(pieces: DataFrame, scores: dict[str, float], used: dict[str, float]) -> dict[str, float]:
    """How much likelier the texts are with each piece (piece) than if its best other segmentation stood in its place. used: how
    often pieces occur in the best segmentations; one that doesn't occur loses nothing."""
    held = pieces.sparkSession.sparkContext.broadcast((scores, used))
    total, longest = sum(used.values()), max(map(len, scores))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores, used = held.value
        for frame in frames:
            out = []
            for piece in frame["piece"]:
                n = used.get(piece, 0.0)
                parts = best_segmentation(piece, {k: v for k, v in _within(piece, scores, longest).items() if k != piece}, longest) if n else []
                after = math.log(total + n * (len(parts) - 1)) if n else 0.0
                other = sum(math.log(used.get(p, 0.0) + n) - after for p in parts)
                out.append(n * (math.log(n) - math.log(total) - other) if n else 0.0)
            if out:
                yield pd.DataFrame({"piece": frame["piece"], "loss": out})

    return {r.piece: r.loss for r in pieces.mapInPandas(run, "piece string, loss double").collect()}


def _within(text: str, scores: dict[str, float], longest: int) -> dict[str, float]:
    """The scores of a text's own substrings."""
    cuts = (text[i : i + k] for i in range(len(text)) for k in range(1, min(longest, len(text) - i) + 1))
    return {c: scores[c] for c in cuts if c in scores}


def train_unigram(counts: DataFrame, seeds: dict[str, float], size: int, rounds: int = 2, shrink: float = 0.75) -> dict[str, float]:
    """A unigram vocabulary by expectation and maximisation over distinct pre-tokens (pretoken, n), pruned to ``size``.

    Each round's expected counts are forward-backward sums in Arrow batches, added up by Spark. After ``rounds`` of them
    the pieces whose removal costs the least likelihood go, a quarter at a time (``shrink``); ties by piece. Single
    characters are never pruned, so every text keeps a segmentation. seeds: pieces with log-probabilities; they and what
    is collected have the vocabulary's size. No counts leave the seeds as they are.
    """
    spark, vocab = counts.sparkSession, dict(seeds)
    counts = materialise(spread(counts.select("pretoken", "n"), "pretoken"), "training-pretokens")
    while True:
        for _ in range(rounds):
            held, longest = spark.sparkContext.broadcast(vocab), max(map(len, vocab))
            found = _sums(counts, lambda text, held=held, longest=longest: expected_counts(text, held.value, longest))
            total = sum(found.values())
            if not total:
                return vocab
            floor = math.log(0.5 / total)
            singles = {p: floor for p in vocab if len(p) == 1}
            vocab = singles | {p: math.log(max(x, 1e-9) / total) for p, x in found.items() if x > 0.5 or len(p) == 1}
        if len(vocab) <= size:
            return vocab
        held, longest = spark.sparkContext.broadcast(vocab), max(map(len, vocab))
        used = _sums(counts, lambda text, held=held, longest=longest: Counter(best_segmentation(text, held.value, longest)))
        singles = [p for p in vocab if len(p) == 1]
        others = spread(spark.createDataFrame([(p,) for p in vocab if len(p) > 1], "piece string"), "piece")
        losses = removal_losses(others, vocab, used)
        keep = max(0, max(size, int(len(vocab) * shrink)) - len(singles))
        if keep >= len(losses):
            return vocab
        vocab = {p: vocab[p] for p in [*singles, *sorted(losses, key=lambda p: (-losses[p], p))[:keep]]}


def _log_sum(x: float, y: float) -> float:
    high, low = (x, y) if x > y else (y, x)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def _plain_counts(edges: list[tuple[int, int, str, float]], n: int) -> dict[str, float] | None:
    """``expected_counts`` of a short text in probabilities, none where they come near the ends of their range. Each is raised by
    LIFT a character; all segmentations have the same characters, so their shares stay."""
    weighted = [(i, j, p, math.exp(s + LIFT * (j - i))) for i, j, p, s in edges]
    ahead, behind = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i, j, _, w in weighted:
        ahead[j] += ahead[i] * w
    if not 1e-200 < ahead[n] < 1e200:
        return None
    for i, j, _, w in reversed(weighted):
        behind[i] += behind[j] * w
    out: dict[str, float] = {}
    for i, j, piece, w in weighted:
        out[piece] = out.get(piece, 0.0) + ahead[i] * w * behind[j] / ahead[n]
    return out


def expected_counts(text: str, scores: dict[str, float], longest: int) -> dict[str, float]:
    """Expected occurrences of pieces over all segmentations of a text; none if there's no segmentation."""
    n, find = len(text), scores.get
    edges = [(i, i + k, p, s) for i in range(n) for k in range(1, min(longest, n - i) + 1) if (s := find(p := text[i : i + k])) is not None]
    if n <= SHORT and (found := _plain_counts(edges, n)) is not None:
        return found
    ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i, j, _, s in edges:
        if ahead[i] > -math.inf:
            ahead[j] = _log_sum(ahead[j], ahead[i] + s)
    if ahead[n] == -math.inf:
        return {}
    for i, j, _, s in reversed(edges):
        if behind[j] > -math.inf:
            behind[i] = _log_sum(behind[i], behind[j] + s)
    out: dict[str, float] = {}
    for i, j, piece, s in edges:
        out[piece] = out.get(piece, 0.0) + math.exp(ahead[i] + s + behind[j] - ahead[n])
    return out
