"""Counts of pre-tokens and of substrings, and the log-probability priors that come from them."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.functions.text import pretokens
from glyphmill.operators.batching import seeded_order
from glyphmill.operators.ordering import numbered
from glyphmill.session import spread


def pretoken_counts(docs: DataFrame, split=pretokens, by: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """(by.., pretoken, n). Partial counts are added up before the shuffle, so frequent pre-tokens cost one row a task."""
    each = docs.select(*by, F.explode(split(F.col(text_col))).alias("pretoken"))
    return each.groupBy(*by, "pretoken").agg(F.count("*").alias("n"))


def top_k(counts: DataFrame, k: int, by: tuple[str, ...] = (), name: str = "pretoken") -> DataFrame:
    """The k most frequent, ties by name. With groups, Spark limits each group before the shuffle."""
    order = [F.desc("n"), F.col(name)]
    if not by:
        return counts.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


#: A vocabulary of up to so many pieces is broadcast as an automaton; a larger one is joined by shuffle.
BROADCAST_PIECES = 200_000


def _cut(counts: DataFrame, longest: int) -> DataFrame:
    """(piece, n): a row for every occurrence of every substring up to ``longest`` characters; null and empty texts have none."""
    texts = spread(counts.where("length(pretoken) > 0"), "pretoken")
    starts = texts.select("pretoken", "n", F.explode(F.sequence(F.lit(1), F.length("pretoken"))).alias("at"))
    room = F.least(F.lit(longest), F.length("pretoken") - F.col("at") + 1)
    sized = starts.select("pretoken", "n", "at", F.explode(F.sequence(F.lit(1), room)).alias("k"))
    return sized.select(F.substring(F.col("pretoken"), F.col("at"), F.col("k")).alias("piece"), "n")


def substrings(counts: DataFrame, longest: int) -> DataFrame:
    """(piece, n): every occurrence of every substring up to ``longest`` characters in distinct pre-tokens, with the
    pre-token's count. A pre-token of m characters gives at most m x longest rows, and they're added up in each task."""
    return _cut(counts, longest).groupBy("piece").agg(F.sum("n").alias("n"))


def _found(counts: DataFrame, pieces: list[str]) -> DataFrame:
    """(piece, n): overlapping occurrences of a list of pieces by an automaton that reads each text once. A task adds up first and
    gives a row for each piece it met."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, piece in enumerate(pieces):
        automaton.add_word(piece, i)
    automaton.make_automaton()
    held = counts.sparkSession.sparkContext.broadcast((automaton, pieces))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, pieces = held.value
        sums: dict[int, int] = {}
        for frame in frames:
            for text, n in zip(frame["pretoken"], frame["n"], strict=True):
                for _, i in automaton.iter(text):
                    sums[i] = sums.get(i, 0) + n
        if sums:
            yield pd.DataFrame({"piece": [pieces[i] for i in sums], "n": list(sums.values())})

    texts = spread(counts.where("pretoken IS NOT NULL").select("pretoken", "n"), "pretoken")
    return texts.mapInPandas(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def occurrences(counts: DataFrame, vocab: DataFrame, longest: int | None = None) -> DataFrame:
    """(id, piece, is_special, n): overlapping occurrences of each vocabulary piece of up to ``longest`` characters in all
    pre-tokens; 0 if it has none, or is null or empty.

    Up to BROADCAST_PIECES pieces go to the tasks as an automaton, so work grows with the texts and the hits. For more,
    substrings as long as the longest piece are cut and joined by shuffle.
    """
    size, most = vocab.agg(F.count("*"), F.coalesce(F.max(F.length("piece")), F.lit(1))).first()
    most = min(longest or most, most)
    if size > BROADCAST_PIECES:
        found = _cut(counts, most).join(vocab.select("piece").distinct(), "piece").groupBy("piece").agg(F.sum("n").alias("n"))
    else:
        wanted = vocab.where((F.length("piece") > 0) & (F.length("piece") <= most)).select("piece").distinct().collect()
        found = _found(counts, sorted(r.piece for r in wanted)) if wanted else counts.select(F.col("pretoken").alias("piece"), "n").where("false")
    return vocab.join(found, "piece", "left").select(*vocab.columns, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def log_prior(counted: DataFrame, count: Column) -> DataFrame:
    """Adds logp: ln((1 + count) / sum(1 + count)); 0.0 for special pieces, which do count in the sum."""
    raw = (F.lit(1) + count).cast("double")
    total = counted.agg(F.sum(raw).alias("_total"))
    out = counted.crossJoin(F.broadcast(total))
    return out.withColumn("logp", F.when(F.col("is_special"), F.lit(0.0)).otherwise(F.log(raw / F.col("_total")))).drop("_total")


def substring_prior(counts: DataFrame, vocab: DataFrame, longest: int | None = None) -> DataFrame:
    """The substring prior of a vocabulary (id, piece, is_special)."""
    return log_prior(occurrences(counts, vocab, longest), F.col("n"))


def token_prior(ids: DataFrame, vocab: DataFrame, mode: str = "reestimate") -> DataFrame:
    """The prior from encoded ids (id), or their counts (id, n): ``reestimate`` adds them up, ``use_tokenizer`` takes the
    vocabulary's scores."""
    if mode == "use_tokenizer":
        return vocab.withColumn("logp", F.when(F.col("is_special"), F.lit(0.0)).otherwise(F.coalesce("score", F.lit(-100000.0))))
    if mode != "reestimate":
        raise ValueError(f"unknown mode {mode}")
    found = ids.groupBy("id").agg((F.sum("n") if "n" in ids.columns else F.count("*")).alias("n"))
    return log_prior(vocab.join(found, "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))), F.col("n"))


def weighted_accuracy(rows: DataFrame, equal: Column, weight: Column) -> DataFrame:
    """sum(weight where equal) / sum(weight)."""
    return rows.agg((F.sum(F.when(equal, weight).otherwise(0)) / F.sum(weight)).alias("accuracy"))


def segmentation_accuracy(rows: DataFrame, equal: Column, wanted: str = "wanted", weight: str = "n") -> DataFrame:
    """The weighted accuracy over the rows that have a wanted piece; null if none has."""
    return weighted_accuracy(rows.where(F.size(wanted) > 0), equal, F.col(weight))


def language_vocabularies(docs: DataFrame, k: int, capped: list[str], cap: int, seed: int = 0, id_col: str = "doc_id", split=pretokens) -> DataFrame:
    """(lang, pretoken, n, rank): the top k pre-tokens of each language; a language without spaces (``capped``) is counted
    over a seeded sample of ``cap`` documents."""
    some = docs.where(F.col("lang").isin(capped))
    rest = docs.where(~F.coalesce(F.col("lang").isin(capped), F.lit(False)))
    sample = numbered(some, "_r", seeded_order(id_col, seed), ["lang"]).where(F.col("_r") < cap).drop("_r")
    return top_k(pretoken_counts(rest.unionByName(sample), split, by=("lang",)), k, by=("lang",))
