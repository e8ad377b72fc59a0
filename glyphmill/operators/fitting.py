"""Fitting unigram scores to wanted segmentations: a linear programme, solved with a certified distance from its optimum.

``fit_scores`` fits over any number of pre-tokens in passes over a table; ``fit_unigram`` is the same programme for a list
that is small enough for the driver.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.session import delete_table, materialise, shared_dir


class Fit(NamedTuple):
    """Fitted scores, their objective, and a proven lower bound of every objective."""

    scores: np.ndarray
    objective: float
    bound: float


def _onto_l1_ball(v: np.ndarray, radius: float) -> np.ndarray:
    """The nearest point whose absolute values add up to ``radius`` at most."""
    size = np.abs(v)
    if size.sum() <= radius:
        return v
    down = np.sort(size)[::-1]
    over = (np.cumsum(down) - radius) / np.arange(1, len(v) + 1)
    cut = over[np.flatnonzero(down > over)[-1]]
    return np.sign(v) * np.maximum(size - cut, 0)


def fit_unigram(target: np.ndarray, rivals: np.ndarray, owner: np.ndarray, weight: np.ndarray, start: np.ndarray, margin: float = 0.1, strength: float = 1e-3, norm: str = "l1", within: float = 1e-4, rounds: int = 200_000) -> Fit:
    """Scores that keep each pre-token's wanted segmentation ahead of its rivals by a margin.

    Minimises the sum over rivals of weight x max(0, margin + rival - target) plus strength x the distance (``l1``,
    ``linf``, or ``none`` for no such term) to the start. target: counts of pieces in each pre-token's segmentation;
    rivals: the same for each rival; owner: the rival's pre-token. Scores and the rivals' dual weights take turns in
    proximal steps, starting anew from their means as the gap falls; they end when the objective is within the stated
    share of its lower bound, or after ``rounds``. Without rivals the start is the optimum.
    """
    if norm not in ("l1", "linf", "none"):
        raise ValueError(f"unknown norm {norm}")
    cost = 0.0 if norm == "none" else strength
    diff = (rivals - target[owner]).astype(float) if len(rivals) else np.zeros((0, len(start)))
    used = np.flatnonzero(np.abs(diff).sum(axis=0))
    if not len(used):
        loss = float((weight[owner] * margin).sum()) if len(rivals) else 0.0
        return Fit(start.copy(), loss, loss)
    d, most, gain = diff[:, used], weight[owner].astype(float), margin + diff @ start

    def distance(x: np.ndarray) -> float:
        return 0.0 if norm == "none" else float(np.abs(x).max() if norm == "linf" else np.abs(x).sum())

    def nearer(x: np.ndarray, step: float) -> np.ndarray:
        if norm == "linf":
            return x - _onto_l1_ball(x, cost * step)
        return np.sign(x) * np.maximum(np.abs(x) - cost * step, 0)

    def objective(x: np.ndarray) -> float:
        return float(most @ np.maximum(gain + d @ x, 0)) + cost * distance(x)

    def bound(a: np.ndarray) -> float:
        pull = np.abs(d.T @ a)
        reach = pull.sum() if norm == "linf" else pull.max()
        return max(0.0, float((a @ gain) * (min(1.0, cost / reach) if reach > 0 else 1.0)))

    size = 0.99 / np.linalg.norm(d, 2)
    x, a, ratio = np.zeros(len(used)), np.zeros(len(most)), 1.0
    best, least, proven = x, objective(x), bound(most)
    x0, a0, xs, as_, n, gap0 = x, a, np.zeros_like(x), np.zeros_like(a), 0, np.inf
    for t in range(1, rounds + 1):
        new = nearer(x - size / ratio * (d.T @ a), size / ratio)
        a = np.clip(a + size * ratio * (gain + d @ (2 * new - x)), 0, most)
        x = new
        xs, as_, n = xs + x, as_ + a, n + 1
        if t % 50:
            continue
        gaps = []
        for y, b in ((x, a), (xs / n, as_ / n)):
            value, low = objective(y), bound(b)
            proven = max(proven, low)
            if value < least:
                best, least = y, value
            gaps.append((value - low, y, b))
        if least - proven <= within * max(least, 1e-12):
            break
        gap, y, b = min(gaps, key=lambda g: g[0])
        if gap <= 0.3 * gap0 or n >= 0.4 * t:
            dx, da = np.linalg.norm(y - x0), np.linalg.norm(b - a0)
            if dx > 0 and da > 0:
                ratio = float(np.sqrt(ratio * da / dx))
            x, a, gap0, n = y, b, gap, 0
            x0, a0, xs, as_ = x, a, np.zeros_like(x), np.zeros_like(a)
    scores = start.astype(float)
    scores[used] += best
    return Fit(scores, least, proven)


def differences(encodings: DataFrame, ids: dict[str, int], wanted: str = "wanted", weight: str = "weight") -> DataFrame:
    """(idx, val, weight): how often pieces stand in a rival more than in the wanted encoding, with the weights of all
    rivals of the same difference added up, as they make the same term of the objective. The vocabulary has a stated size."""
    held = encodings.sparkSession.sparkContext.broadcast(ids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for good, rival, w in zip(frame[wanted], frame["pieces"], frame[weight], strict=True):
                more = Counter(rival)
                more.subtract(good)
                own = sorted((held.value[p], n) for p, n in more.items() if n)
                out.append(([i for i, _ in own], [n for _, n in own], w))
            yield pd.DataFrame(out, columns=["idx", "val", "weight"])

    each = encodings.select(wanted, "pieces", weight).mapInPandas(run, "idx array<int>, val array<int>, weight double")
    return each.groupBy("idx", "val").agg(F.sum("weight").alias("weight"))


#: Rows from which another task is worth the sums that it sends in every round.
TASK_ROWS = 1 << 14


def _held_rows(rows: DataFrame, start: np.ndarray, margin: float) -> RDD:
    """Blocks (begins, idx, val, weight, gain) of the rows as arrays; gain is the margin plus the difference at the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, val = batch.column(0), batch.column(1)
            begins = idx.offsets.to_numpy()[:-1] - idx.offsets[0].as_py()
            at, v = idx.flatten().to_numpy(), val.flatten().to_numpy()
            if len(begins):
                gain = margin + np.add.reduceat(v * start[at], begins)
                arrays = (begins.astype(np.int32), at.astype(np.int32), v.astype(np.int32), batch.column(2).to_numpy(), gain)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], ["begins", "idx", "val", "weight", "gain"])

    names = ("begins", "idx", "val", "weight", "gain")
    parts = max(1, min(-(-rows.count() // TASK_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    table = materialise(rows.select("idx", "val", "weight").repartition(parts).mapInArrow(run, ", ".join(f"{n} binary" for n in names)), "fit-rows")
    kinds = (np.int32, np.int32, np.int32, float, float)

    def small(row) -> tuple:
        """Every round writes its blocks anew, so pieces and counts take as few bytes as they can."""
        begins, idx, val, weight, gain = (np.frombuffer(bytes(x), k) for x, k in zip(row, kinds, strict=True))
        return begins, idx.astype(np.min_scalar_type(len(start))), val.astype(np.min_scalar_type(-1 - int(np.abs(val).max()))), weight, gain

    return table.rdd.map(small)


#: Pieces up to which the normal equations are summed as a whole matrix; with more, they are applied in passes.
DENSE = 2048
#: What keeps rows that lie on their bounds from counting without limit beside the others in the normal equations: without it,
#: late rounds lose the smaller ones to rounding.
SOFT = 1e-10
#: Rounds after which blocks are written to the shared folder: a task carries all rounds since, and some 380 overflow the stack.
CUT = 25
#: Passes that mend the duals of a round, each from what rounding left of the one before.
MENDS = 3


def _along(block: tuple, x: np.ndarray) -> np.ndarray:
    begins, idx, val = block[:3]
    return np.add.reduceat(val * x[idx], begins)


def _pull(block: tuple, y: np.ndarray, n: int) -> np.ndarray:
    """What a number for each row amounts to on each piece."""
    begins, idx, val = block[:3]
    return np.bincount(idx, np.repeat(y, np.diff(begins, append=len(idx))) * val, n)


def _products(block: tuple, h: np.ndarray, n: int) -> np.ndarray:
    """The upper half of the matrix of rows times themselves, each weighted by ``h``."""
    begins, idx, val = block[:3]
    matrix, size = np.zeros(n * n), np.diff(begins, append=len(idx))
    for k in np.unique(size):
        same, (left, right) = np.flatnonzero(size == k), np.triu_indices(k)
        for first in range(0, len(same), step := max(1, (1 << 20) // len(left))):
            rows = same[first : first + step]
            at = begins[rows][:, None] + np.arange(k)
            i, v = idx[at].astype(np.int64), val[at].astype(float)
            i, j = i[:, left], i[:, right]
            matrix += np.bincount((np.minimum(i, j) * n + np.maximum(i, j)).ravel(), ((h[rows][:, None] * v)[:, left] * v[:, right]).ravel(), n * n)
    return matrix.reshape(n, n)[np.triu_indices(n)]


def _whole(half: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = half
    return out + np.triu(out, 1).T


def _solved(matrix: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Solves matrix @ x = wanted, scaled by the diagonal, as pieces' numbers may be many orders apart, and refined."""
    size = np.diag(matrix)
    scale = np.divide(1.0, np.sqrt(size, where=size > 0, out=np.ones_like(size)))
    unit = matrix * scale[:, None] * scale
    unit[np.diag_indices(len(unit))] += np.where(size > 0, 1e-15, 1.0)
    try:
        inverse = np.linalg.inv(unit)
    except np.linalg.LinAlgError:
        inverse = np.linalg.pinv(unit, hermitian=True)
    x = scale * (inverse @ (scale * wanted))
    for _ in range(3):
        x = x + scale * (inverse @ (scale * (wanted - matrix @ x)))
    return x


def _begin(block: tuple, aim: float = 10.0) -> tuple:
    """A block with, for each row, its slack, how far the slack is above the row's value, and the duals of both bounds:
    those at which each dual times its room is ``aim`` for the scores at the start."""
    w, gain = block[3:5]
    root = np.sqrt((w * gain) ** 2 + 4 * aim * aim)
    s, r = (root + w * gain + 2 * aim) / (2 * w), (root - w * gain + 2 * aim) / (2 * w)
    return (*block, s, r, aim / r, aim / s)


def _moves(block: tuple, dx: np.ndarray, aim: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How slacks, their distances and duals move along with the scores, so that each dual times its bound's room is ``aim``."""
    s, r, a, b = block[5:]
    e1, e2, both, dz = aim - a * r, aim - b * s, b * r + s * a + SOFT * a * b, _along(block, dx)
    da = (b * e1 - a * e2 + a * b * dz) / both
    return (e2 + s * da) / b, (e1 - r * da) / a, da


def _moved(block: tuple, dx: np.ndarray, aim: float, step: float, dual_step: float) -> tuple:
    ds, dr, da = _moves(block, dx, aim)
    s, r, a, b = block[5:]
    return (*block[:5], s + step * ds, r + step * dr, a + dual_step * da, b - dual_step * da)


def _room(value: np.ndarray, move: np.ndarray) -> float:
    """How often the move can be made until a value is 0."""
    down = move < 0
    return float((value[down] / -move[down]).min(initial=np.inf))


def _rooms(block: tuple, dx: np.ndarray, aim: float) -> np.ndarray:
    ds, dr, da = _moves(block, dx, aim)
    s, r, a, b = block[5:]
    return np.array([min(_room(s, ds), _room(r, dr)), min(_room(a, da), _room(b, -da))])


def _sums(block: tuple, x: np.ndarray, dense: bool) -> list[np.ndarray]:
    """Of a block: duals times rooms, their number, the loss and the duals' gain; the pull of the duals and of their moves
    (without and per ``aim``); and the normal equations' matrix (its upper half) or its diagonal."""
    begins, idx, val, w, gain, s, r, a, b = block
    n, both = len(x), b * r + s * a + SOFT * a * b
    h = a * b / both
    matrix = _products(block, h, n) if dense else np.bincount(idx, np.repeat(h, np.diff(begins, append=len(idx))) * val * val.astype(float), n)
    known = np.array([a @ r + b @ s, 2.0 * len(w), w @ np.maximum(gain + _along(block, x), 0), a @ gain])
    return [known, _pull(block, a, n), _pull(block, a * b * (s - r) / both, n), _pull(block, (b - a) / both, n), matrix]


def _play(block: tuple) -> np.ndarray:
    """The square of how far a row's dual is from both its bounds."""
    w, (a, b) = block[3], block[7:]
    return (a * b / w) ** 2


def _mended(block: tuple, y: np.ndarray) -> list[np.ndarray]:
    """The gain and the pull of duals that are moved along ``y`` by their play."""
    a = np.clip(block[7] - _play(block) * _along(block, y), 0, block[3])
    return [np.array([a @ block[4]]), _pull(block, a, len(y))]


def _merged(each: RDD, add: Callable):
    """The sum of all values, made in tasks to the last, so that a single one reaches the driver whatever the number of tasks."""

    def own(values: Iterator) -> Iterator:
        found = list(itertools.islice(values, 1))
        yield from found and [functools.reduce(add, values, found[0])]

    sums, n = each.mapPartitions(own), each.getNumPartitions()
    while n > 1:
        n = 1 if n <= 16 else math.isqrt(n)
        dealt = sums.mapPartitionsWithIndex(lambda i, values, n=n: ((i % n, x) for x in values))
        sums = dealt.reduceByKey(add, n, int).values()
    return sums.collect()[0]


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b, strict=True)]


class _Distance:
    """The same for the distance term, whose bounds are u - x >= 0 and u + x >= 0: one u for each piece, or one for all."""

    def __init__(self, n: int, cost: float, norm: str) -> None:
        self.one, self.p, self.q = norm == "linf", np.ones(n), np.ones(n)
        self.a = self.b = np.full(n, cost / 2 / (n if self.one else 1))

    def equations(self, aim: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The matrix as a diagonal less the square of a vector, and the right side."""
        c, d = self.a / self.p, self.b / self.q
        up, down = (aim - self.a * self.p) / self.p, (aim - self.b * self.q) / self.q
        pull = self.a - self.b + up - down
        if self.one:
            total = (c + d).sum()
            return c + d, (c - d) / np.sqrt(total), pull - (c - d) * (up + down).sum() / total
        return 4 * c * d / (c + d), np.zeros_like(c), pull - (c - d) * (up + down) / (c + d)

    def moves(self, dx: np.ndarray, aim: float) -> tuple[np.ndarray, ...]:
        c, d = self.a / self.p, self.b / self.q
        up, down = (aim - self.a * self.p) / self.p, (aim - self.b * self.q) / self.q
        lifted, weight = up + down + (c - d) * dx, c + d
        du = lifted.sum() / weight.sum() if self.one else lifted / weight
        return du - dx, du + dx, up - c * (du - dx), down - d * (du + dx)

    def move(self, moves: tuple[np.ndarray, ...], step: float, dual_step: float) -> None:
        dp, dq, da, db = moves
        self.p, self.q, self.a, self.b = self.p + step * dp, self.q + step * dq, self.a + dual_step * da, self.b + dual_step * db


def fit_scores(rows: DataFrame, start: np.ndarray, margin: float = 0.1, strength: float = 1e-3, norm: str = "l1", within: float = 1e-3, rounds: int = 400) -> Fit:
    """The scores of ``fit_unigram`` for rows (idx, val, weight) of any number, as ``differences`` gives them.

    A primal-dual interior point method. Slacks and duals of rows stay with their blocks; a round is a pass that sums the normal
    equations for the scores, the true loss, and what the duals prove, and a pass that finds how far slacks and duals can move
    along. Sums are merged in tasks, so a round sends the driver one set of sums, of the scores' size (or half its square, up to
    ``DENSE`` pieces), on any number of tasks. A lost block follows again from the blocks that
    every ``CUT`` rounds write, and the rounds' moves since. It ends when the objective is within the
    stated share of the proven bound, when duals times rooms are too small to gain more, or at ``rounds``. Duals that would prove it but
    for their pull, which rounding keeps from what the distance term allows, are mended in a few more passes. A row of no pieces is a constant; without others the start is the optimum.
    Without a distance term nothing above 0 is proven.
    """
    if norm not in ("l1", "linf", "none"):
        raise ValueError(f"unknown norm {norm}")
    cost = 0.0 if norm == "none" else strength
    fixed = margin * float(rows.where(F.size("idx") == 0).agg(F.sum("weight")).first()[0] or 0.0)
    table = _held_rows(rows.where(F.size("idx") > 0), np.asarray(start, float), margin)
    if table.isEmpty():
        return Fit(np.array(start, float), fixed, fixed)
    n, dense, x = len(start), len(start) <= DENSE, np.zeros(len(start))
    state, far = table.map(_begin).persist(StorageLevel.MEMORY_AND_DISK), _Distance(n, cost, norm) if cost else None
    best, least, proven, reached, passed = x, np.inf, 0.0, 1.0, table

    def proof(gained: float, pull: np.ndarray) -> float:
        strain = np.abs(pull).sum() if norm == "linf" else np.abs(pull).max()
        return gained * (min(1.0, cost / strain) if strain > 0 else 1.0)

    spark, cut = rows.sparkSession, None
    shared_dir(spark)
    for t in range(rounds):
        if t and t % CUT == 0:
            state.checkpoint()
        (rooms, terms, loss, gained), pull, still, aimed, matrix = _merged(state.map(lambda b, x=x: _sums(b, x, dense)), _added)
        if t and t % CUT == 0:
            cut = _dropped(spark, cut, state)
        true = loss + cost * float(np.abs(x).max() if norm == "linf" else np.abs(x).sum())
        proven = max(proven, proof(gained, pull))
        if true < least:
            best, least = x, true
        if cost and dense and abs(least - gained) <= within * (least + fixed) < least - proven:
            products, y, pulled = _whole(_merged(state.map(lambda b: [_products(b, _play(b), n)]), _added)[0], n), np.zeros(n), pull
            for _ in range(MENDS):
                allowed = cost * (1 - 1e-7)
                y = y + _solved(products, pulled - (_onto_l1_ball(pulled, allowed) if norm == "linf" else np.clip(pulled, -allowed, allowed)))
                (mended,), pulled = _merged(state.map(lambda b, y=y: _mended(b, y)), _added)
                proven = max(proven, proof(mended, pulled))
                if least - proven <= within * (least + fixed):
                    break
        if least - proven <= within * (least + fixed):
            break
        if far:
            rooms, terms = rooms + far.a @ far.p + far.b @ far.q, terms + 2 * n
        if not rooms > 1e-3 * within * (least + fixed):
            break
        aim = (0.05 if reached > 0.9 else 0.2 if reached > 0.5 else 0.5) * rooms / terms
        diagonal, root, right = far.equations(aim) if far else (np.zeros(n), np.zeros(n), np.zeros(n))
        right = -(right + pull + still + aim * aimed)
        if dense:
            dx = _solved(_whole(matrix, n) + np.diag(diagonal) - np.outer(root, root), right)
        else:
            ridge = 1e-14 * (matrix + diagonal).max()
            apply = lambda v, state=state: _merged(state.map(lambda b: [_pull(b, b[7] * b[8] / (b[8] * b[6] + b[5] * b[7] + SOFT * b[7] * b[8]) * _along(b, v), n)]), _added)[0]
            dx = _conjugate(lambda v, d=diagonal + ridge, root=root, apply=apply: apply(v) + d * v - root * (root @ v), right, matrix + diagonal + ridge)
        step, dual_step = _merged(state.map(lambda b, dx=dx, aim=aim: _rooms(b, dx, aim)), np.minimum)
        if far:
            moves = far.moves(dx, aim)
            step = min(step, _room(far.p, moves[0]), _room(far.q, moves[1]))
            dual_step = min(dual_step, _room(far.a, moves[2]), _room(far.b, moves[3]))
        step, dual_step = min(1.0, 0.99 * step), min(1.0, 0.99 * dual_step)
        before, reached = state, min(step, dual_step)
        state = state.map(lambda b, dx=dx, aim=aim, step=step, dual_step=dual_step: _moved(b, dx, aim, step, dual_step)).persist(StorageLevel.MEMORY_AND_DISK)
        passed.unpersist()
        passed = before
        x = x + step * dx
        if far:
            far.move(moves, step, dual_step)
    state.unpersist()
    passed.unpersist()
    _dropped(spark, cut)
    return Fit(np.asarray(start, float) + best, least + fixed, proven + fixed)


def _dropped(spark: SparkSession, cut: RDD | None, by: RDD | None = None) -> RDD | None:
    """Deletes the files of blocks that later ones have replaced, and gives the later ones."""
    if cut and (path := cut.getCheckpointFile()):
        delete_table(spark, path)
    return by


def _conjugate(times, wanted: np.ndarray, diagonal: np.ndarray, share: float = 1e-6) -> np.ndarray:
    """Solves times(x) = wanted by conjugate gradients, scaled by the diagonal; each step is a pass over the rows."""
    scale = 1 / np.maximum(diagonal, 1e-12 * diagonal.max())
    x, r = np.zeros_like(wanted), wanted.copy()
    y = scale * r
    p, known = y.copy(), float(r @ y)
    first = known
    for _ in range(2 * len(wanted)):
        if known <= share * share * first:
            break
        t = times(p)
        size = known / float(p @ t)
        x, r = x + size * p, r - size * t
        y = scale * r
        known, before = float(r @ y), known
        p = y + known / before * p
    return x
