"""Mixing sources to target weights: documents are picked by exact size so that each source meets its budget.

A budget is met by a bounded knapsack over the histogram of sizes, not over documents: every size gives its share of
documents, and what the rounding leaves, less than the longest document, is fitted by a subset-sum dynamic programme over the
documents that remain of each size.
Which documents of a size are picked is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
#: Bits of the hash that split the documents of one source and size into ranges, so that none is ranked in one task.
SPLIT_BITS = 9


def source_targets(sizes: dict, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict:
    """The target of each source. sizes: source (None for null) to words. Sources by code point, null last, take the
    weights in turn; a target stops at ``most`` times its source, and what is over is shared again by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, active, target = share * sum(sizes.values()), list(order), {}
    while active:
        total = sum(weight[s] for s in active)
        over = [s for s in active if left * weight[s] / total > most * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in active}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        active = [s for s in active if s not in target]
    return target


#: Starts that are tried when shares are rounded.
STARTS = 64


def even_picks(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """For each length its share of documents, where a budget is under the total: from the longest down, what is rounded off
    goes to the next length. Of the starts of the rounding, the one that leaves the least of the budget."""
    total = int((lengths * counts).sum())
    order = np.argsort(-lengths, kind="stable")
    seen = [int(c) for c in np.cumsum(counts[order])]
    best, least = np.zeros(len(lengths), np.int64), budget
    for start in range(STARTS):  # the first leaves nothing over
        upto = [(STARTS * n * budget + start * total) // (STARTS * total) for n in seen]
        picks = np.diff(np.array(upto, np.int64), prepend=0)
        left = budget - int((picks * lengths[order]).sum())
        if 0 <= left < least:
            best[order], least = picks, left
    return best


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to pick so that their total is as near below the budget as can be found.

    Documents of any length are taken alike (``even_picks``), and what that leaves, less than the longest document, is filled
    by an exact subset sum over the documents left. Where over a thousandth of the budget is still missing, as with few
    documents, more of the budget is left to the subset sum, twice as many documents' worth each time.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    if budget >= int((lengths * counts).sum()):
        return counts.copy()
    even, back, best, least = budget, int(lengths.max()), None, budget + 1
    while True:
        picks = _fill(lengths, counts, even_picks(lengths, counts, even), budget)
        missing = budget - int((picks * lengths).sum())
        if missing < least:
            best, least = picks, missing
        if least * 1000 <= budget or even == 0:
            return best
        even, back = max(0, budget - back), 2 * back


def _fill(lengths: np.ndarray, counts: np.ndarray, picks: np.ndarray, budget: int) -> np.ndarray:
    """The picks and others that come nearest below the budget with them: a bit set of the sums that can be reached."""
    left = budget - int((picks * lengths).sum())
    # a hash order, so that the rest isn't of like lengths
    order = sorted(np.flatnonzero(lengths > 0).tolist(), key=lambda i: int(lengths[i]) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    mask, reach, items, first = (1 << (left + 1)) - 1, 1, [], np.full(left + 1, -1, np.int32)
    for i in order:
        free, part = min(int(counts[i] - picks[i]), left // int(lengths[i])), 1
        while free > 0 and not reach >> left & 1:
            part = min(part, free)
            fresh = (reach << part * int(lengths[i])) & mask & ~reach
            if fresh:
                raw = np.frombuffer(fresh.to_bytes((left + 8) // 8, "little"), np.uint8)
                first[np.flatnonzero(np.unpackbits(raw, bitorder="little"))] = len(items)
                items.append((i, part))
                reach |= fresh
            free -= part
            part *= 2
    at = reach.bit_length() - 1
    while at > 0:
        i, part = items[first[at]]
        picks[i] += part
        at -= part * int(lengths[i])
    return picks


def with_size(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds size: the number of words; 0 for null."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))


def mix(
    sized: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """Adds source_size, target, copies and taken (size x copies) to documents that have ``size``.

    Every document gets a row; copies is 0, 1 or more, up to ``most``. A null source is a source of its own, a null
    id is hashed like a value, sizes of 0 are never taken but by whole passes, and repeated rows rank one after the
    other (they're interchangeable, so reruns agree). Columns of the four names are replaced; other columns stay.
    Only source totals (a row for each source) reach the driver. An empty table gives an empty result.
    """
    own = ["source_size", "target", "copies", "taken", "_gm_key", "_gm_hash", "_gm_part", "_gm_rank", "_gm_before", "_gm_pick", "_gm_pass"]
    rows = (
        sized.drop(*own)
        .withColumn("_gm_key", F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")))
        .withColumn("_gm_hash", F.xxhash64(F.lit(seed), F.col(id_col), F.col("size")))
        .withColumn("_gm_part", F.shiftrightunsigned("_gm_hash", 64 - SPLIT_BITS).cast("int"))
    )
    parts = materialise(rows.groupBy("_gm_key", "size", "_gm_part").agg(F.count("*").alias("n")), "mix-sizes")
    lengths = parts.groupBy("_gm_key", "size").agg(F.sum("n").alias("n"))
    totals = {r[0]: r[1] for r in lengths.groupBy("_gm_key").agg(F.sum(F.col("size") * F.col("n"))).collect()}
    named = source_targets({None if k == "n" else k[1:]: v for k, v in totals.items()}, weights, share, most)
    targets = {"n" if s is None else "s" + s: t for s, t in named.items()}

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["_gm_key"].iloc[0]
        whole, target = totals[key], targets[key]
        passes = int(target // whole) if whole else 0
        pdf = pdf.sort_values("size")
        chosen = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(target - passes * whole)) if whole else np.zeros(len(pdf), np.int64)
        return pd.DataFrame({"_gm_key": key, "size": pdf["size"], "source_size": whole, "target": float(target), "_gm_pass": passes, "_gm_pick": chosen})

    picked = lengths.groupBy("_gm_key").applyInPandas(pick, "_gm_key string, size long, source_size long, target double, _gm_pass int, _gm_pick long")
    before = Window.partitionBy("_gm_key", "size").orderBy("_gm_part").rowsBetween(Window.unboundedPreceding, -1)
    plan = parts.withColumn("_gm_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(picked, ["_gm_key", "size"])
    ranked = rows.withColumn(
        "_gm_rank", F.row_number().over(Window.partitionBy("_gm_key", "size", "_gm_part").orderBy("_gm_hash", F.col(id_col).asc_nulls_last()))
    )
    copies = F.col("_gm_pass") + (F.col("_gm_before") + F.col("_gm_rank") <= F.col("_gm_pick")).cast("int")
    out = ranked.join(plan, ["_gm_key", "size", "_gm_part"]).withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select(*[c for c in sized.columns if c not in own], "source_size", "target", "copies", "taken")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's digest; the text is reduced to its size in the one scan."""
    docs = with_size(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).drop("text")
    return mix(materialise(docs, "sizes")).select("doc_id", "size", "source_size", "target", "taken", "copies")
