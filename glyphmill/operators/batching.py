"""Batching: packing texts into units, cutting id streams into blocks, fixed batches, splits, padding and shifting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from glyphmill.operators.ordering import numbered
from glyphmill.session import materialise


def seeded_order(id_col: str = "doc_id", seed: int = 0, epoch: int = 0) -> list[Column]:
    """A reproducible shuffle: by md5 of id, seed and epoch, ties by id."""
    return [F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)), F.lit(str(epoch)))), F.col(id_col)]


#: Texts of a range, and ranges (or groups of ranges) whose maps are composed in one task.
RANGE, FAN = 4096, 256


def range_map(lengths: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """What a range of texts makes of each sum (0 to threshold - 1) that an open unit may have before it: the sum after it,
    and the units filled. Sums that have become equal are carried on as one."""
    of, states = np.arange(threshold), np.arange(threshold)
    filled, more = np.zeros(threshold, np.int64), np.zeros(threshold, np.int64)
    for n in lengths:
        states = states + n
        full = states >= threshold
        if full.any():
            states[full] = 0
            more += full
            filled += more[of]
            states, again = np.unique(states, return_inverse=True)
            of, more = again[of], np.zeros(len(states), np.int64)
    return states[of], filled


def pack(texts: DataFrame, threshold: int, eos_length: int = 4, by: tuple[str, ...] = ("lang",), id_col: str = "doc_id", shards: int = 1) -> DataFrame:
    """(by.., shard, doc_id, unit, unit_chars): texts in seeded order, appended with an end marker until a unit has
    ``threshold`` characters, markers included; the last marker doesn't count. An unfilled last unit is dropped.

    The sum starts anew with each unit, so where a unit begins depends on all texts before. Still no task sees a whole group:
    a range of texts is a map from the sum before it to the sum after it and the units it fills; such maps are composed
    group by group up to the whole, and from there each range learns its own sum and unit. ``shards`` deals a group's
    texts to as many orders; it is part of the result's definition.
    """
    shard = F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int") if shards > 1 else F.lit(0)
    rows = texts.select(*by, shard.alias("shard"), F.col(id_col).cast("long").alias(id_col), F.length("text").cast("long").alias("_n"), seeded_order(id_col)[0].alias("_o")).where("_n > 0")
    keys = [*by, "shard"]
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key")
    placed = numbered(rows.select("*", group), "_pos", ["_o", id_col], ["_key"]).withColumn("_block", F.floor(F.col("_pos") / RANGE))

    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        after, filled = range_map(frame.sort_values("_pos")["_n"].to_numpy() + eos_length, threshold)
        return pd.DataFrame({"_key": frame["_key"].iloc[:1], "_block": frame["_block"].iloc[:1], "after": [after], "filled": [filled]})

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        after, filled = np.arange(threshold), np.zeros(threshold, np.int64)
        frame = frame.sort_values("_block")
        for a, f in zip(frame["after"], frame["filled"], strict=True):
            after, filled = np.asarray(a)[after], filled + np.asarray(f)[after]
        return pd.DataFrame({"_key": frame["_key"].iloc[:1], "_block": frame["_up"].iloc[:1], "after": [after], "filled": [filled]})

    def descend(frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        total, unit, out = int(above["total"].iloc[0]), int(above["unit"].iloc[0]), []
        for key, block, a, f in frame.sort_values("_block")[["_key", "_block", "after", "filled"]].itertuples(index=False, name=None):
            out.append((key, block, total, unit))
            total, unit = int(a[total]), unit + int(f[total])
        return pd.DataFrame(out, columns=["_key", "_block", "total", "unit"])

    def assign(frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        frame, total, unit, units = frame.sort_values("_pos"), int(above["total"].iloc[0]), int(above["unit"].iloc[0]), []
        for n in frame["_n"].to_numpy() + eos_length:
            units.append(unit)
            total += n
            if total >= threshold:
                total, unit = 0, unit + 1
        return frame.assign(unit=units)[[*keys, id_col, "_n", "unit"]]

    maps = "_key string, _block long, after array<long>, filled array<long>"
    levels = [materialise(placed.groupBy("_key", "_block").applyInPandas(begin, maps), "pack-maps")]
    most = placed.agg(F.max("_block")).first()[0] or 0
    while most > 0:
        most //= FAN
        upper = levels[-1].withColumn("_up", F.floor(F.col("_block") / FAN))
        levels.append(materialise(upper.groupBy("_key", "_up").applyInPandas(compose, maps), "pack-maps"))
    places = levels[-1].select("_key", "_block", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("unit"))
    for level in levels[-2::-1]:
        below = level.withColumn("_up", F.floor(F.col("_block") / FAN)).groupBy("_key", "_up")
        places = below.cogroup(places.groupBy("_key", "_block")).applyInPandas(descend, "_key string, _block long, total long, unit long")
    kinds = [rows.schema[c] for c in keys]
    schema = T.StructType([*kinds, T.StructField(id_col, T.LongType()), T.StructField("_n", T.LongType()), T.StructField("unit", T.LongType())])
    out = placed.groupBy("_key", "_block").cogroup(places.groupBy("_key", "_block")).applyInPandas(assign, schema)
    total = F.sum(F.col("_n") + eos_length).over(Window.partitionBy(*keys, "unit"))
    return out.withColumn("_total", total).where(F.col("_total") >= threshold).select(*keys, id_col, "unit", (F.col("_total") - eos_length).alias("unit_chars"))


def blocks(tokens: DataFrame, size: int, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., block, ids): the ids (id) of each group in order, cut into blocks; a remainder is dropped."""
    cut = numbered(tokens, "_r", order, by).withColumn("block", F.floor(F.col("_r") / size))
    whole = cut.groupBy(*by, "block").agg(F.array_sort(F.collect_list(F.struct("_r", "id"))).alias("x")).where(F.size("x") == size)
    return whole.select(*by, "block", F.transform("x", lambda e: e["id"]).alias("ids"))


def fixed_batches(rows: DataFrame, size: int, by: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Adds batch and pos: batches of ``size`` within each group in id order; rows of a last, smaller batch are dropped."""
    n = rows.groupBy(by).agg(F.count("*").alias("_n"))
    out = numbered(rows, "_r", [id_col], [by]).join(n, by)
    return out.withColumn("batch", F.floor(F.col("_r") / size)).withColumn("pos", F.col("_r") % size).where(F.col("batch") < F.floor(F.col("_n") / size)).drop("_r", "_n")


def split_quota(sizes: DataFrame, cap: int, valid_share: float, count: str = "n_pages") -> DataFrame:
    """Adds n, n_valid and n_train: pages up to cap x (1 + share), of which a share is for validation."""
    n = F.ceil(F.least(F.col(count).cast("double"), F.lit(cap * (1 + valid_share))))
    valid = F.ceil(F.col("n") / (1 + valid_share) * valid_share)
    return sizes.withColumn("n", n).withColumn("n_valid", valid).withColumn("n_train", F.col("n") - F.col("n_valid"))


def split_rows(rows: DataFrame, quota: DataFrame, by: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Adds part: the first n_valid rows of each group are ``valid``, the next n_train ``train``, others go."""
    out = numbered(rows, "_r", [id_col], [by]).withColumn("_r", F.col("_r") + 1).join(quota.select(by, "n_valid", "n_train"), by)
    part = F.when(F.col("_r") <= F.col("n_valid"), "valid").when(F.col("_r") <= F.col("n_valid") + F.col("n_train"), "train")
    return out.withColumn("part", part).where("part is not null").drop("_r", "n_valid", "n_train")


def stride(rows: DataFrame, workers: int, order: list[Column]) -> DataFrame:
    """Adds worker: every workers-th row of an order."""
    return numbered(rows, "worker", order).withColumn("worker", F.pmod("worker", F.lit(workers)))


def pad(ids: Column, size: int, fill: int) -> Column:
    """Exactly ``size`` ids: cut, or filled up."""
    return F.concat(F.slice(ids, 1, size), F.array_repeat(F.lit(fill), F.greatest(F.lit(size) - F.size(ids), F.lit(0))))


def pad_to_multiple(ids: Column, n: int, fill: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(fill), F.pmod(-F.size(ids), F.lit(n)).cast("int")))


def with_bos(ids: Column, bos: int) -> Column:
    """A begin id in front, the last id dropped, so the length stays."""
    return F.concat(F.array(F.lit(bos)), F.slice(ids, F.lit(1), F.size(ids) - 1))


def next_token_pairs(ids: Column) -> Column:
    """(input, label) for each position but the last."""
    n = F.size(ids) - 1
    return F.arrays_zip(F.slice(ids, F.lit(1), n).alias("input"), F.slice(ids, F.lit(2), n).alias("label"))


def head_texts(rows: DataFrame, n: int, by: str = "lang", order: str = "doc_id") -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def restarting(rows: DataFrame, n: int, by: str = "lang", id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """(by, pos, epoch, id): the first n rows of each group's endless stream, which starts anew with a new shuffle when it
    is exhausted."""
    sizes = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_size"))
    each = rows.select(by, id_col).join(sizes, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    each = each.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(n / F.col("_size")).cast("int") - 1)))
    order = [F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)), F.col("epoch").cast("string"))), F.col(id_col)]
    placed = numbered(each, "_r", order, [by, "epoch"]).withColumn("pos", F.col("epoch") * F.col("_size") + F.col("_r"))
    return placed.where(F.col("pos") < n).select(by, "pos", "epoch", id_col)
