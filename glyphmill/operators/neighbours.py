"""The most similar rows of a table for each query, exactly, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from glyphmill.session import materialise

#: Rows of a block; a comparison of two blocks is one matrix product.
BLOCK = 1024
#: What rounding may take from a bound.
SLACK = 1e-9
#: Shares of each side at least, and bytes of vectors in one at most; a task compares a share of queries with one of the table.
SHARES = 8
SHARE_BYTES = 1 << 26


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _units(table: DataFrame) -> DataFrame:
    """(id, vec) of length 1; a vector of zeros stays, one that is null or holds what isn't a finite number goes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                m = _matrix(frame["vec"])
                ok = np.isfinite(m).all(axis=1)
                m = m[ok] / np.maximum(np.linalg.norm(m[ok], axis=1, keepdims=True), 1e-300)
                if len(m):
                    yield pd.DataFrame({"id": frame["id"][ok], "vec": list(m)})

    rows = table.where("vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL)").select("id", F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInPandas(run, rows.schema)


def _centres(units: DataFrame, clusters: int, rounds: int) -> np.ndarray:
    """Means of clusters: the first rows in hash order, moved ``rounds`` times to the mean of the rows next to them. To the driver
    come clusters x dimensions numbers; sums are made in tasks."""
    first = units.select("vec", F.md5(F.col("id").cast("string")).alias("h")).orderBy("h", "vec").limit(clusters).collect()
    centres = np.array([r.vec for r in first])
    for _ in range(rounds if len(first) else 0):

        def run(frames: Iterator[pd.DataFrame], centres=centres) -> Iterator[pd.DataFrame]:
            sums, n = np.zeros_like(centres), np.zeros(len(centres))
            for frame in frames:
                if len(frame):
                    m = _matrix(frame["vec"])
                    at = _nearest(m, centres)
                    np.add.at(sums, at, m)
                    n += np.bincount(at, minlength=len(centres))
            kept = np.flatnonzero(n)
            if len(kept):
                yield pd.DataFrame({"cluster": kept, "n": n[kept], "total": list(sums[kept])})

        parts = units.select("vec").mapInPandas(run, "cluster int, n double, total array<double>")
        each = parts.select("cluster", "n", F.posexplode("total").alias("pos", "x")).groupBy("cluster", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
        moved = centres.copy()
        for r in each.collect():
            moved[r.cluster, r.pos] = r.x
        centres = moved
    return centres


def _nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * m @ centres.T, axis=1)


class _Packer:
    """Rows by cluster, given out as blocks of up to BLOCK rows."""

    def __init__(self) -> None:
        self.held: dict[int, list[tuple]] = {}

    def add(self, cluster: int, row: tuple) -> Iterator[tuple]:
        rows = self.held.setdefault(cluster, [])
        rows.append(row)
        if len(rows) == BLOCK:
            yield self._block(cluster)

    def rest(self) -> Iterator[tuple]:
        for cluster in list(self.held):
            yield self._block(cluster)

    def _block(self, cluster: int) -> tuple:
        rows = sorted(self.held.pop(cluster), key=lambda r: r[0])
        return cluster, [r[0] for r in rows], np.stack([r[1] for r in rows]).tobytes(), [r[2] for r in rows]


def _packed(rows: DataFrame, deal, name: str) -> DataFrame:
    """(cluster, <name>s, <name>_vecs, <name>_marks): blocks of the (cluster, id, vec, mark) that ``deal`` makes of each frame. A
    task holds less than a block for each cluster; nothing is shuffled."""
    columns = ["cluster", f"{name}s", f"{name}_vecs", f"{name}_marks"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = _Packer()
        for frame in frames:
            if len(frame):
                for cluster, *row in deal(frame):
                    for block in packer.add(cluster, tuple(row)):
                        yield pd.DataFrame([block], columns=columns)
        for block in packer.rest():
            yield pd.DataFrame([block], columns=columns)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"cluster int, {name}s array<{kind}>, {name}_vecs binary, {name}_marks array<double>")


def _matrices(blocks: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The ids and the vectors of each cluster, by id."""
    found: dict[int, list] = {}
    for cluster, ids, vecs in zip(blocks["cluster"].to_pylist(), blocks["ts"], blocks["t_vecs"], strict=True):
        ids = ids.values.to_numpy(zero_copy_only=False)
        found.setdefault(cluster, []).append((ids, np.frombuffer(vecs.as_py()).reshape(len(ids), -1)))
    out = {}
    for cluster, parts in found.items():
        ids, vecs = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        order = np.argsort(ids, kind="stable")
        out[cluster] = ids[order], vecs[order]
    return out


def _best(q: np.ndarray, marks: np.ndarray, open_: np.ndarray, table: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, n, s): the k best rows of the clusters that are open to each query, as far as they reach its mark."""
    at, n, s, least = np.zeros(0, dtype=int), None, np.zeros(0), marks.copy()
    for cluster, (ids, vecs) in table.items():
        rows = np.flatnonzero(open_[:, cluster])
        for i in range(0, len(ids) if len(rows) else 0, BLOCK):
            x = q[rows] @ vecs[i : i + BLOCK].T
            r, c = np.nonzero(x >= least[rows, None] - SLACK)
            if len(r) > 8 * k * len(rows):  # ties, or no mark yet: the first k by id of each query do
                c = np.argsort(-np.round(x, 12), axis=1, kind="stable")[:, :k]
                r, c = np.repeat(np.arange(len(rows)), c.shape[1]), c.ravel()
            if not len(r):
                continue
            new = ids[i : i + BLOCK][c]
            at, n, s = np.concatenate([at, rows[r]]), new if n is None else np.concatenate([n, new]), np.concatenate([s, np.round(x[r, c], 12)])
            order = np.lexsort((n, -s, at))
            at, n, s = at[order], n[order], s[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            least[at[rank == k - 1]] = np.maximum(least[at[rank == k - 1]], s[rank == k - 1])
            at, n, s = at[rank < k], n[rank < k], s[rank < k]
    return at, n, s


def _share(first: str, shares: int) -> Column:
    return F.pmod(F.xxhash64(F.element_at(first, 1)), F.lit(shares)).cast("int")


def _shares(n: int, dim: int) -> int:
    return max(SHARES, -(-n * dim * 8 // SHARE_BYTES))


def most_similar(queries: DataFrame, table: DataFrame, k: int = 10, clusters: int = 64, rounds: int = 2) -> DataFrame:
    """(id, n, s): for each query (id, vec) the k rows n of the table (id, vec) with the highest cosine similarity s, ties
    (equal to 12 digits) by n; all rows, if there are fewer.

    Rows are dealt to clusters. A query first meets some rows of the cluster next to it, fewer than two blocks; the k-th
    similarity there is its mark. By q.x = q.c + q.(x - c) <= q.c + |x - c|, no row of a cluster is more similar than q.c
    plus the cluster's radius, so a query skips the clusters where that is under its mark, and nothing is lost. Both sides
    travel as blocks of up to 1,024 rows, dealt by hash to 8 shares each, so a row travels 8 times; only where a share would
    hold over 64 MB are there more. A task compares a share of the queries with one of the table and gives k rows a query. A
    cluster of any size is spread over tasks. Ids are unique; null vectors have no neighbours and are none; the similarity
    to a vector of zeros is 0.
    """
    kind, other = queries.schema["id"].dataType.simpleString(), table.schema["id"].dataType.simpleString()
    units = materialise(_units(table), "units")
    asked = units if queries is table else materialise(_units(queries), "asked")
    centres = _centres(units, clusters, rounds)
    if not len(centres):
        return queries.select("id", F.lit(None).cast(other).alias("n"), F.lit(None).cast("double").alias("s")).where("false")

    def own(frame: pd.DataFrame) -> Iterator[tuple]:
        m = _matrix(frame["vec"])
        at = _nearest(m, centres)
        far = np.linalg.norm(m - centres[at], axis=1)
        return zip(at.tolist(), frame["id"], m, far.tolist(), strict=True)

    blocks = materialise(_packed(units, own, "t"), "blocks")
    radius = np.full(len(centres), -np.inf)
    for r in blocks.groupBy("cluster").agg(F.max(F.array_max("t_marks")).alias("far")).collect():
        radius[r.cluster] = r.far
    full = np.isfinite(radius)

    def near(frame: pd.DataFrame) -> Iterator[tuple]:
        m = _matrix(frame["vec"])
        at = np.argmax(np.where(full, m @ centres.T, -np.inf), axis=1)
        return zip(at.tolist(), frame["id"], m, [-np.inf] * len(m), strict=True)

    dim = centres.shape[1]
    q_shares, t_shares = _shares(asked.count(), dim), _shares(units.count(), dim)
    every_q, every_t = (F.array(*map(F.lit, range(n))) for n in (q_shares, t_shares))
    held = Window.partitionBy("cluster").orderBy(F.desc("rows"), "head").rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.select("cluster", F.element_at("ts", 1).alias("head"), F.size("ts").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(held), F.lit(0)))
    some = blocks.join(F.broadcast(heads.where(F.col("before") < BLOCK).select("head")), F.element_at("ts", 1) == F.col("head")).select("cluster", "ts", "t_vecs")

    def mark(asked: pa.Table, some: pa.Table) -> pa.Table:
        found = _matrices(some)
        out = []
        for cluster, qs, vecs in zip(asked["cluster"].to_pylist(), asked["qs"], asked["q_vecs"], strict=True) if asked.num_rows else ():
            q = np.frombuffer(vecs.as_py()).reshape(len(qs), -1)
            met = found[cluster][1]
            marks = np.full(len(q), -np.inf)
            if len(met) >= k:
                marks = np.partition(np.round(q @ met.T, 12), len(met) - k, axis=1)[:, len(met) - k]
            open_ = full & (q @ centres.T + radius >= marks[:, None] - SLACK)
            out.append((vecs.as_py(), marks.tobytes(), np.packbits(open_, axis=1).tobytes()))
        names = ["q_vecs", "q_marks", "q_open"]
        columns = {name: pa.array([x[i] for x in out], pa.binary()) for i, name in enumerate(names)}
        return pa.table({"qs": asked["qs"].combine_chunks() if asked.num_rows else pa.array([], some_ids)} | columns)

    def compare(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        parts = []
        if asked.num_rows and blocks.num_rows:
            met = _matrices(blocks)
            for qs, vecs, marks, open_ in zip(asked["qs"], asked["q_vecs"], asked["q_marks"], asked["q_open"], strict=True):
                q = np.frombuffer(vecs.as_py()).reshape(len(qs), -1)
                bits = np.unpackbits(np.frombuffer(open_.as_py(), dtype=np.uint8).reshape(len(q), -1), axis=1, count=len(centres)).astype(bool)
                at, n, s = _best(q, np.frombuffer(marks.as_py()), bits, met, k)
                if len(at):
                    parts.append(pa.table({"id": qs.values.take(pa.array(at)), "n": pa.array(n, other_type), "s": s}))
        return pa.concat_tables(parts) if parts else pa.table({"id": pa.array([], kind_type), "n": pa.array([], other_type), "s": pa.array([], pa.float64())})

    kind_type, other_type = (to_arrow_type(x.schema["id"].dataType) for x in (queries, table))
    some_ids = pa.list_(kind_type)
    met = _packed(asked, near, "q").select("cluster", "qs", "q_vecs", _share("qs", q_shares).alias("q_share")).groupBy("cluster", "q_share")
    first = some.select("*", F.explode(every_q).alias("q_share")).groupBy("cluster", "q_share")
    marked = met.cogroup(first).applyInArrow(mark, f"qs array<{kind}>, q_vecs binary, q_marks binary, q_open binary")
    mine = marked.select("*", _share("qs", q_shares).alias("q_share"), F.explode(every_t).alias("t_share")).groupBy("q_share", "t_share")
    theirs = blocks.select("cluster", "ts", "t_vecs", _share("ts", t_shares).alias("t_share"), F.explode(every_q).alias("q_share")).groupBy("q_share", "t_share")
    found = mine.cogroup(theirs).applyInArrow(compare, f"id {kind}, n {other}, s double")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "n"))).where(F.col("r") <= k).drop("r")
