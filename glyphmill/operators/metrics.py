"""Metrics: means by language, losses, sequence labels, and the learning-rate schedule."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mean_by(rows: DataFrame, value: str, by: str = "lang", known: DataFrame | None = None) -> DataFrame:
    """The mean of each group; with a list of known groups, those without rows have NaN."""
    out = rows.groupBy(by).agg(F.avg(value).alias("mean"))
    return out if known is None else known.select(by).join(out, by, "left").withColumn("mean", F.coalesce("mean", F.lit(float("nan"))))


def spread(rows: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Mean and population deviation."""
    aggs = [F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")]
    return rows.groupBy(by).agg(*aggs) if by else rows.agg(*aggs)


def token_ratios(sequences: DataFrame, unknown_id: int, pad_id: int, by: str = "lang", ids: str = "ids") -> DataFrame:
    """(by, unk_ratio, pad_ratio): the shares of unknown and of padding ids among all positions of a group."""
    count = lambda x: F.sum(F.size(F.filter(ids, lambda i: i == x)))
    n = F.sum(F.size(ids))
    return sequences.groupBy(by).agg((count(unknown_id) / n).alias("unk_ratio"), (count(pad_id) / n).alias("pad_ratio"))


def causal_loss(rows: DataFrame, loss: str = "loss", mask: str = "mask") -> DataFrame:
    """sum(loss x mask) / sum(mask)."""
    return rows.agg((F.sum(F.col(loss) * F.col(mask)) / F.sum(mask)).alias("loss"))


def nats_per_byte(rows: DataFrame, by: str = "seq_id") -> DataFrame:
    """The mean over sequences of their loss over their bytes; bytes count at all positions."""
    each = rows.groupBy(by).agg((F.sum(F.col("loss") * F.col("mask")) / F.sum("n_bytes")).alias("x"))
    return each.agg(F.avg("x").alias("nats_per_byte"))


def masked_lm(rows: DataFrame) -> DataFrame:
    """Loss over positions with a label and attention, accuracy over positions with a label."""
    labelled = F.col("label") != -100
    both = labelled & (F.col("attention") == 1)
    return rows.agg(F.avg(F.when(both, F.col("loss"))).alias("loss"), F.avg(F.when(labelled, (F.col("label") == F.col("predicted")).cast("double"))).alias("accuracy"))


def evaluation(rows: DataFrame) -> DataFrame:
    """average_loss, chars_per_token, nats_per_char, perplexity of (loss, n_chars, is_special): a special's loss counts
    as zero but its position stays in the mean."""
    loss = F.when(F.col("is_special"), 0.0).otherwise(F.col("loss"))
    out = rows.agg(F.avg(loss).alias("average_loss"), F.avg("n_chars").alias("chars_per_token"), F.sum(loss).alias("_l"), F.sum("n_chars").alias("_c"))
    per = F.col("_l") / F.greatest(F.col("_c"), F.lit(1))
    return out.select("average_loss", "chars_per_token", per.alias("nats_per_char"), F.exp("average_loss").alias("perplexity"))


def classification(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """accuracy and mse."""
    return rows.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"), F.avg(F.pow(F.col(label) - F.col(predicted), F.lit(2))).alias("mse"))


def batch_mean(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """Means of batch means, not pooled."""
    each = rows.groupBy(batch).agg(F.avg("loss").alias("loss"), F.avg("accuracy").alias("accuracy"))
    return each.agg(F.avg("loss").alias("loss"), F.avg("accuracy").alias("accuracy"))


def bio_spans(tags: DataFrame, tag: str, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """(seq, kind, first, last): entities of B-/I- tags; an I- that doesn't go on an entity of its kind begins one."""
    order = Window.partitionBy(seq).orderBy(pos)
    kind, mark = F.substring_index(F.col(tag), "-", -1), F.substring(F.col(tag), 1, 1)
    before = F.lag(F.col(tag)).over(order)
    begins = (mark == "B") | ((mark == "I") & (F.coalesce(F.substring(before, 1, 1), F.lit("O")).isin("O") | (F.substring_index(before, "-", -1) != kind)))
    rows = tags.select(seq, pos, tag, kind.alias("kind"), F.when(begins, 1).otherwise(0).alias("_b")).withColumn("_e", F.sum("_b").over(order))
    return rows.where(F.substring(F.col(tag), 1, 1) != "O").groupBy(seq, "_e", "kind").agg(F.min(pos).alias("first"), F.max(pos).alias("last")).drop("_e")


def span_scores(tags: DataFrame, gold: str = "gold", predicted: str = "predicted", seq: str = "seq_id") -> DataFrame:
    """(kind, precision, recall, f1, support) over entity spans, with a row for ``overall``."""
    g, p = bio_spans(tags, gold, seq).withColumn("g", F.lit(1)), bio_spans(tags, predicted, seq).withColumn("p", F.lit(1))
    both = g.join(p, [seq, "kind", "first", "last"], "full_outer").select("kind", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    rows = both.unionByName(both.withColumn("kind", F.lit("overall")))
    out = rows.groupBy("kind").agg(F.sum(F.col("g") * F.col("p")).alias("hit"), F.sum("g").alias("support"), F.sum("p").alias("found"))
    precision = F.when(F.col("found") > 0, F.col("hit") / F.col("found")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    out = out.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1).select("kind", "precision", "recall", "f1", "support")


def flush_every(rows: DataFrame, steps: int, step: str = "step", by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """(flush, by.., mean): means over each ``steps`` steps, counted from step 1."""
    return rows.groupBy(F.floor((F.col(step) - 1) / steps).alias("flush"), *by).agg(F.avg("value").alias("mean"))


def learning_rate(step: Column, warmups: list[int], rates: list[float], steps: int, alpha: float = 0.0, random_warmup: int = 0, random_rate: float = 0.0) -> Column:
    """Linear warm-ups one after the other, each from zero to its rate, and then a cosine decay to alpha x the last rate."""
    edges = [random_warmup, *warmups]
    out = F.when(step < random_warmup, random_rate * step / max(random_warmup, 1))
    for i, rate in enumerate(rates):
        out = out.when(step < edges[i + 1], rate * (step - edges[i]) / (edges[i + 1] - edges[i]))
    last = max(steps - warmups[-1], 1)
    share = F.least((step - warmups[-1]) / last, F.lit(1.0))
    return out.otherwise(rates[-1] * ((1 - alpha) * 0.5 * (1 + F.cos(F.lit(math.pi) * share)) + alpha))


def hinge_losses(rivals: DataFrame, margin: float = 0.1) -> DataFrame:
    """(pretoken, loss): the weighted sum over rivals of max(0, margin - target + rival); an empty slot (null) counts 0."""
    gap = F.greatest(F.lit(0.0), margin - F.col("target") + F.col("rival"))
    return rivals.groupBy("pretoken", "weight").agg(F.sum(F.when(F.col("rival").isNotNull(), gap).otherwise(0.0)).alias("_l")).select("pretoken", (F.col("_l") * F.col("weight")).alias("loss"))


def padded_mean_length(rows: DataFrame, ids: str, fill: int) -> DataFrame:
    """The mean number of ids that aren't padding."""
    return rows.agg(F.avg(F.size(F.filter(ids, lambda x: x != fill))).alias("mean_tokens"))


def first_subword_labels(rows: DataFrame, all_tokens: bool = False, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """Adds label to (word, tag) by token: the tag at a word's first token; for its others -100, or the I- form of the
    tag if all tokens are labelled; -100 where there's no word."""
    before = F.lag("word").over(Window.partitionBy(seq).orderBy(pos))
    inner = F.regexp_replace("tag", "^B-", "I-") if all_tokens else F.lit("-100")
    label = F.when(F.col("word").isNull(), "-100").when(before.isNull() | (before != F.col("word")), F.col("tag")).otherwise(inner)
    return rows.withColumn("label", label)


def label_ids(rows: DataFrame, label: str) -> DataFrame:
    """(label, label_id): the distinct labels in order, from 0."""
    return rows.select(label).where(F.col(label).isNotNull()).distinct().withColumn("label_id", F.row_number().over(Window.orderBy(label)) - 1)


def argmax(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)) - 1


def first_wrong(losses: DataFrame, n: int = 50, order: str = "rank") -> DataFrame:
    """The first n rows with a positive loss."""
    return losses.where("loss > 0").orderBy(order).limit(n)


def mean_change(rows: DataFrame, before: str, after: str) -> DataFrame:
    """The mean absolute change of a score."""
    return rows.agg(F.avg(F.abs(F.col(after) - F.col(before))).alias("change"))
