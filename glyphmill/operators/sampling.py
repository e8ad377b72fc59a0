"""Seeded sampling: language shares, weighted choice, negatives, coverage samples; all by hashes, so reruns agree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.operators.ordering import numbered


def language_shares(sizes: DataFrame, alpha: float, weight: str | None = None, count: str = "n_pages") -> DataFrame:
    """Adds raw_share and share. With weights, both are the weights' shares; else raw_share = (n / sum n) ^ alpha, which
    needn't add up to 1, and share is raw_share made to. A single language has 1."""
    whole = Window.partitionBy()
    if weight:
        out = sizes.withColumn("raw_share", F.col(weight) / F.sum(weight).over(whole))
    else:
        out = sizes.withColumn("raw_share", F.pow(F.col(count) / F.sum(count).over(whole), F.lit(alpha)))
    return out.withColumn("share", F.col("raw_share") / F.sum("raw_share").over(whole))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 13 hex digits of md5 of key and seed."""
    digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(16**13)


def normal(key: Column, seed: int) -> Column:
    """A standard normal number from two uniform ones of the key, the same however rows are dealt out."""
    away = F.sqrt(-2 * F.log(1 - uniform(key, seed)))
    return away * F.cos(2 * math.pi * uniform(F.concat_ws("-", key.cast("string"), F.lit("b")), seed))


def choose_language(steps: DataFrame, shares: DataFrame, seed: int, key: str = "step", name: str = "lang") -> DataFrame:
    """Adds a language to each step: the one in whose cumulative share the step's uniform number falls. shares is a row
    for each language."""
    rows = sorted((r[0], r[1]) for r in shares.select(name, "share").collect())
    choice, top = F.lit(rows[-1][0]), 0.0
    u = uniform(F.col(key), seed)
    parts = []
    for lang, share in rows:
        top += share
        parts.append((top, lang))
    for top, lang in reversed(parts[:-1]):
        choice = F.when(u < top, F.lit(lang)).otherwise(choice)
    return steps.withColumn(name, choice)


def negatives(vocab: DataFrame, positives: DataFrame, n: int, seed: int, specials: list[int] = ()) -> DataFrame:
    """(id, positive): the positives without specials, and the first others in hash order until there are n."""
    wanted = positives.select("id").distinct().where(~F.col("id").isin(list(specials)) if specials else F.lit(True))
    rest = vocab.select("id").join(wanted, "id", "left_anti")
    rest = rest.where(~F.col("id").isin(list(specials))) if specials else rest
    fill = max(0, n - wanted.count())
    picked = rest.orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), "id").limit(fill)
    return wanted.withColumn("positive", F.lit(True)).unionByName(picked.withColumn("positive", F.lit(False)))


def coverage_sample(items: DataFrame, batch: int, least: int, n: int, seed: int, strict: bool = True) -> DataFrame:
    """(sample, pos, id): n samples of ``batch`` ids in which each id of (id, logp) occurs ``least`` times or more.

    The ids are dealt out least times in hash order over the samples; what room a sample has left is drawn by weight
    exp(logp) without replacement (the least exponential keys, kept by each task and then merged). n must be a multiple of least; an id at or below -100000 is only
    dealt, never drawn. Samples with too little room to cover all ids are an error if ``strict``; else each is filled with the
    least of the ids that were dealt to it.
    """
    if n % least:
        raise ValueError("the number of samples must be a multiple of the coverage")
    size = items.count()
    per = n // least
    if strict and size > per * batch:
        raise ValueError("the samples have too little room to cover all ids")
    passes = items.select("id", F.explode(F.sequence(F.lit(0), F.lit(least - 1))).alias("p"))
    order = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("p").cast("string"), F.lit(str(seed))))
    dealt = numbered(passes, "r", [order, "id"], ["p"]).select("id", (F.col("p") * per + F.pmod("r", F.lit(per))).cast("int").alias("sample"))
    if size >= per * batch:  # no sample has room left
        rank = F.row_number().over(Window.partitionBy("sample").orderBy("id"))
        return dealt.withColumn("pos", rank).where(F.col("pos") <= batch).select("sample", (F.col("pos") - 1).alias("pos"), "id")
    own = dealt.groupBy("id").agg(F.collect_list("sample").alias("own"))  # of ``least`` samples
    u = lambda s: F.greatest(uniform(F.concat_ws("-", F.col("id").cast("string"), s.cast("string")), seed), F.lit(1e-15))
    keys = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.when(~F.array_contains("own", s), -F.log(u(s)) / F.exp("logp")))
    drawn = least_keys(items.where("logp > -100000").join(own, "id").select("id", keys.alias("keys")), batch)
    rank = F.row_number().over(Window.partitionBy("sample").orderBy("_key", "id"))
    both = dealt.select("sample", "id", F.lit(0.0).alias("_key")).unionByName(drawn).withColumn("pos", rank)
    return both.where(F.col("pos") <= batch).select("sample", (F.col("pos") - 1).alias("pos"), "id")


def least_keys(rows: DataFrame, k: int) -> DataFrame:
    """(sample, id, _key): of rows (id, keys: one for each sample, or null) those that a task needs for the k least keys of each
    sample; ties by id. A task holds, and gives, k rows a sample, so items x samples rows are never shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for frame in frames:
            if not len(frame):
                continue
            ids, keys = frame["id"].to_numpy(), np.array([np.asarray(v, dtype=float) for v in frame["keys"]])
            for sample in range(keys.shape[1]):
                column = keys[:, sample]
                old_keys, old_ids = held.get(sample, (column[:0], ids[:0]))
                new = column <= old_keys[-1] if len(old_keys) == k else ~np.isnan(column)
                all_keys, all_ids = np.concatenate([old_keys, column[new]]), np.concatenate([old_ids, ids[new]])
                best = np.lexsort((all_ids, all_keys))[:k]
                held[sample] = all_keys[best], all_ids[best]
        for sample, (keys, ids) in held.items():
            yield pd.DataFrame({"sample": sample, "id": ids, "_key": keys})

    return rows.mapInPandas(run, f"sample int, id {rows.schema['id'].dataType.simpleString()}, _key double")


def equal_batches(items: DataFrame, size: int, seed: int) -> DataFrame:
    """(batch, pos, id, padding): all ids in hash order in batches of one size; the last is filled with id 0."""
    order = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))))
    rows = numbered(items.select("id"), "r", [order, "id"])
    n = items.count()
    missing = -n % size
    fill = items.sparkSession.range(n, n + missing).select(F.lit(0).cast("long").alias("id"), F.col("id").alias("r"), F.lit(True).alias("padding"))
    both = rows.select(F.col("id").cast("long").alias("id"), F.col("r").cast("long").alias("r"), F.lit(False).alias("padding")).unionByName(fill)
    return both.select(F.floor(F.col("r") / size).alias("batch"), (F.col("r") % size).alias("pos"), "id", "padding")


def vocabulary_size(key: Column, mean: float, std: float, low: int, high: int, seed: int) -> Column:
    """A whole number for each key, drawn from a normal distribution, within bounds."""
    return F.least(F.greatest(mean + std * normal(key, seed), F.lit(float(low))), F.lit(float(high))).cast("int")


def noise_std(key: Column, mean: float, sigma: float, seed: int) -> Column:
    """A number for each key, drawn from a log-normal distribution around ``mean``; 0 if the mean isn't positive."""
    return F.exp(math.log(mean) + sigma * normal(key, seed)) if mean > 0 else F.lit(0.0)


def mask_tokens(ids: Column, key: Column, mask_id: int, seed: int, probability: float = 0.15) -> Column:
    """(input, label) for each id: a share of them is masked and keeps its label, the others have label -100."""
    return F.transform(
        ids,
        lambda x, i: F.struct(
            F.when(uniform(F.concat_ws("-", key.cast("string"), i.cast("string")), seed) < probability, F.lit(mask_id)).otherwise(x).alias("input"),
            F.when(uniform(F.concat_ws("-", key.cast("string"), i.cast("string")), seed) < probability, x).otherwise(F.lit(-100)).alias("label"),
        ),
    )


def pool(key: Column, pools: int, seed: int) -> Column:
    """One of the pools for each key."""
    return F.floor(uniform(key, seed) * pools).cast("int")


def random_rows(ids: DataFrame, dims: DataFrame, seed: int) -> DataFrame:
    """(id, vec): for each id a row drawn from each dimension's normal distribution (pos, mean, std). The dimensions are one
    row, which is broadcast."""
    each = dims.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("_dims"))
    drawn = F.transform("_dims", lambda d: d["mean"] + d["std"] * normal(F.concat_ws(":", F.col("id").cast("string"), d["pos"].cast("string")), seed))
    return ids.select("id").crossJoin(F.broadcast(each)).select("id", drawn.alias("vec"))
