"""Embedding tables (id, vec): gathering, lexical transfer, averaging, delta merges, rescaling and distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.neighbours import most_similar
from glyphmill.operators.vocab import same_vocab

EPS = 1e-8


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def huber(x: Column, y: Column, delta: float = 1.0) -> Column:
    """The element-wise Huber loss of two vectors."""
    def one(p: Column, q: Column) -> Column:
        e = F.abs(p.cast("double") - q.cast("double"))
        small = F.least(e, F.lit(delta))
        return 0.5 * small * small + delta * (e - small)

    return F.zip_with(x, y, one)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it's named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(v: Column) -> Column:
    shifted = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(shifted, lambda e: let(total(e), lambda whole: F.transform(e, lambda x: x / whole)))


def kl_with_log_targets(log_p: Column, log_q: Column) -> Column:
    """sum exp(log_q) * (log_q - log_p)."""
    return total(F.zip_with(log_q, log_p, lambda q, p: F.exp(q) * (q - p)))


def concat_tables(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(id, vec) with the output vector after the input vector."""
    return inputs.join(outputs.select("id", F.col("vec").alias("_out")), "id").select("id", F.concat("vec", "_out").alias("vec"))


def split_table(table: DataFrame, dim: int) -> DataFrame:
    """(id, vec_in, vec_out)."""
    return table.select("id", F.slice("vec", 1, dim).alias("vec_in"), F.slice("vec", F.lit(dim + 1), F.size("vec") - dim).alias("vec_out"))


def gather(ids: DataFrame, table: DataFrame) -> DataFrame:
    """Adds vec to rows that have id."""
    return ids.join(table, "id", "left")


def gather_with_fallback(ids: DataFrame, table: DataFrame, fallback: DataFrame, size: int) -> DataFrame:
    """Ids from ``size`` on take the fallback table's row id - size."""
    look = ids.withColumn("_f", F.when(F.col("id") >= size, F.col("id") - size)).withColumn("_s", F.when(F.col("id") < size, F.col("id")))
    look = look.join(table.select(F.col("id").alias("_s"), F.col("vec").alias("_a")), "_s", "left")
    look = look.join(fallback.select(F.col("id").alias("_f"), F.col("vec").alias("_b")), "_f", "left")
    return look.withColumn("vec", F.coalesce("_b", "_a")).drop("_a", "_b", "_s", "_f")


def overwrite(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of (id, vec) replace the table's."""
    return table.join(rows.select("id", F.col("vec").alias("_new")), "id", "left").select("id", F.coalesce("_new", "vec").alias("vec"))


def mean_vectors(rows: DataFrame, key: str = "id") -> DataFrame:
    """The mean vector of each key; sums run per position in partial aggregates, in double precision."""
    each = rows.select(key, F.posexplode("vec").alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select(key, F.transform("v", lambda e: e["x"]).alias("vec"))


def _means_of_few(rows: DataFrame) -> DataFrame:
    """The ``mean_vectors`` of (id, part, vec) whose ids have few parts each: whole vectors are added up, so a vector is a row."""
    each = rows.where("vec is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "vec"))).alias("of"))
    zero = F.lit(0.0)

    def add(a: Column, r: Column) -> Column:
        return F.zip_with(a, r["vec"], lambda x, y: F.struct((F.coalesce(x["s"], zero) + F.coalesce(y.cast("double"), zero)).alias("s"), (F.coalesce(x["n"], zero) + F.when(y.isNull(), 0.0).otherwise(1.0)).alias("n")))

    sums = F.aggregate("of", F.array().cast("array<struct<s: double, n: double>>"), add, lambda a: F.transform(a, lambda x: F.when(x["n"] > 0, x["s"] / x["n"])))
    return each.select("id", sums.alias("vec"))


def visit_average(visits: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, vec) for each of ``ids``: the mean of the vectors (id, vec) that batches predicted for it. Batches may overlap;
    an id that none of them visited is an error."""
    out = ids.select("id").join(mean_vectors(visits), "id", "left")
    missing = F.raise_error(F.concat(F.lit("no batch visited id "), F.col("id").cast("string"))).cast(out.schema["vec"].dataType)
    return out.withColumn("vec", F.coalesce("vec", missing))


def column_moments(table: DataFrame, sample: bool = False) -> DataFrame:
    """(pos, mean, std) of each dimension; the population's deviation unless the sample's is asked for."""
    std = F.stddev_samp if sample else F.stddev_pop
    return table.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"), std("x").alias("std"))


def lexical_transfer(target: DataFrame, source: DataFrame, pieces: DataFrame, unknown_id: int, mode: str = "no") -> DataFrame:
    """(id, vec) for a target vocabulary (id, source_id) from a source table.

    An overlapping piece copies its row. Others take the unknown row (``no``), the mean of their source pieces if all
    are known (``fvt``), or of the known ones (``bfvt``). pieces: (id, part), part null if the source lacks it; a piece has no
    more parts than characters.
    """
    if mode not in ("no", "fvt", "bfvt"):
        raise ValueError(f"unknown mode {mode}")
    copied = target.join(source.select(F.col("id").alias("source_id"), "vec"), "source_id", "left").select("id", "vec")
    unknown = source.where(F.col("id") == unknown_id).select(F.col("vec").alias("_unk"))
    out = copied
    if mode != "no":
        known = pieces.withColumn("_known", F.col("part").isNotNull() & (F.col("part") != unknown_id))
        able = known.groupBy("id").agg((F.min("_known") if mode == "fvt" else F.max("_known")).alias("_ok")).where("_ok")
        parts = known.where("_known").join(able.select("id"), "id", "left_semi").join(source.select(F.col("id").alias("part"), "vec"), "part").select("id", "part", "vec")
        means = _means_of_few(parts).withColumnRenamed("vec", "_mean")
        out = out.join(means, "id", "left").select("id", F.coalesce(F.transform("vec", lambda x: x.cast("double")), "_mean").alias("vec"))
    else:
        out = out.select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    return out.crossJoin(F.broadcast(unknown)).select("id", F.coalesce("vec", F.transform("_unk", lambda x: x.cast("double"))).alias("vec"))


def delta_merge(tuned: DataFrame, swapped: DataFrame, base: DataFrame, weight: float, skip: Column | None = None) -> DataFrame:
    """(path, data): tuned + weight x (swapped - base) for parameters paired by path; those that ``skip`` marks have no
    delta. Raises if the paths differ."""
    pair = swapped.select("path", F.col("data").alias("_s")).join(base.select("path", F.col("data").alias("_b")), "path", "full_outer")
    if pair.where("_s is null or _b is null").take(1):
        raise ValueError("parameters without a partner")
    w = F.when(skip, F.lit(0.0)).otherwise(F.lit(weight)) if skip is not None else F.lit(weight)
    rows = tuned.join(pair, "path").withColumn("_d", F.zip_with("_s", "_b", lambda s, b: s - b)).withColumn("_w", w)
    return rows.select("path", F.zip_with("data", "_d", lambda t, d: t + F.col("_w") * d).alias("data"))


def rescale(table: DataFrame, target: DataFrame) -> DataFrame:
    """w x + b for each dimension, so that the table's moments come near the target's: w = std_t / (std_x + 1e-8),
    b = mean_t - mean(x) w."""
    m = column_moments(table).join(column_moments(target).select("pos", F.col("mean").alias("mt"), F.col("std").alias("st")), "pos")
    m = m.withColumn("w", F.col("st") / (F.col("std") + EPS)).withColumn("b", F.col("mt") - F.col("mean") * F.col("w"))
    both = m.agg(F.array_sort(F.collect_list(F.struct("pos", "w", "b"))).alias("_m"))  # a row for each dimension
    return table.crossJoin(F.broadcast(both)).select("id", F.zip_with("vec", "_m", lambda x, m: x.cast("double") * m["w"] + m["b"]).alias("vec"))


def lexical_loss(pairs: DataFrame, kind: str = "mse") -> DataFrame:
    """The masked mean distance of (predicted, target, mask), over the mean norm of the targets."""
    diff = F.zip_with("predicted", "target", lambda x, y: x.cast("double") - y.cast("double"))
    if kind == "huber":
        d = 1e-3
        distance = F.aggregate(huber(F.col("predicted"), F.col("target"), d), F.lit(0.0), lambda a, x: a + x) / F.size("predicted") / d / 30
    else:
        distance = dot(diff, diff) if kind == "mse" else norm(diff)
    mask = F.col("mask").cast("double")
    return pairs.agg((F.sum(distance * mask) / (F.sum(mask) + EPS) / F.avg(norm(F.col("target")))).alias("loss"))


def identity_loss(pairs: DataFrame) -> DataFrame:
    diff = F.zip_with("predicted", "target", lambda x, y: x.cast("double") - y.cast("double"))
    return pairs.agg(F.avg(dot(diff, diff)).alias("loss"))


def similar_transfer(queries: DataFrame, table: DataFrame, neighbours: int = 10, temperature: float = 0.1) -> DataFrame:
    """(id, vec): the softmax-weighted mean of the most similar rows, of which a query has at most ``neighbours``."""
    near = most_similar(queries, table, neighbours).withColumn("w", F.exp(F.col("s") / temperature))
    rows = near.join(table.select(F.col("id").alias("n"), "vec"), "n").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "w", "vec"))).alias("of"))
    zeros = F.transform(F.element_at("of", 1)["vec"], lambda _: F.lit(0.0))
    mean = F.aggregate("of", zeros, lambda a, r: F.zip_with(a, r["vec"], lambda x, y: x + y * r["w"]))
    weight = F.aggregate("of", F.lit(0.0), lambda a, r: a + r["w"])
    return rows.select("id", mean.alias("_v"), weight.alias("_w")).select("id", F.transform("_v", lambda x: x / F.col("_w")).alias("vec"))


def project(v: Column, weight: list[list[float]], bias: list[float]) -> Column:
    """A dense layer: a row of ``weight`` for each output."""
    return F.array(*[dot(v, F.array(*map(F.lit, row))) + b for row, b in zip(weight, bias, strict=True)])


def gelu(v: Column) -> Column:
    """The tanh form."""
    return F.transform(v, lambda x: 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    def scaled(c: Column) -> Column:
        return let(F.sqrt(dot(c, c) / F.size(c) + eps), lambda std: F.transform(c, lambda x: x / std))

    return let(let(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean)), scaled)


def drop_parameters(params: DataFrame, first_keys: list[str]) -> DataFrame:
    """Parameters whose path doesn't begin with one of the keys."""
    return params.where(~F.element_at("path", 1).isin(first_keys))


def rename_layers(path: Column) -> Column:
    """layers_N in a path becomes N."""
    return F.transform(path, lambda p: F.regexp_replace(p, r"^layers_(\d+)$", "$1"))


def parameter_count(params: DataFrame) -> DataFrame:
    return params.agg(F.sum(F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)).alias("n"))


def transfer_unless_equal(target: DataFrame, source: DataFrame, table: DataFrame, transfer: Callable[[], DataFrame]) -> DataFrame:
    """The table as it is where two vocabularies (id, piece) are equal, else what ``transfer`` makes."""
    return table if same_vocab(target, source) else transfer()
