"""Seed substrings of a corpus: scores per batch, a window over the last batches, and the vocabulary they induce."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from glyphmill.functions.text import BLANKS, blank_run, byte_alphabet, pretokens, to_byte_level
from glyphmill.operators.sampling import normal
from glyphmill.operators.vocab import place_specials
from glyphmill.session import materialise, spread

FLOOR = -100000.0
#: Characters by which suffixes are dealt.
HEAD = 4


def first_pretokens(texts: DataFrame, by: Sequence[str], text_col: str = "text") -> DataFrame:
    """(by.., p, first): a row for each pre-token, and whether it is its text's first."""
    each = texts.select(*by, F.posexplode(pretokens(F.concat(F.lit(" "), F.col(text_col)), letters_only=True)).alias("at", "p"))
    return each.select(*by, "p", (F.col("at") == 0).alias("first"))


def cut_suffixes(counted: DataFrame, by: Sequence[str], max_length: int = 16, stride: int = 4) -> DataFrame:
    """(by.., n, suffix): what follows each stride-th start of pre-tokens (by.., p, first, n), up to max_length - 1 bytes. The first of
    a text has one more start at 0, so its others count from one earlier."""
    more = F.col("first").cast("int")
    each = counted.select(*by, "n", "p", more.alias("more"), to_byte_level(F.col("p")).alias("m"), F.explode(F.sequence(F.lit(0), F.length("p") - 1 + more, F.lit(stride))).alias("i"))
    start = F.octet_length(F.substring(F.col("p"), F.lit(2), F.col("i") - F.col("more")))
    return each.select(*by, "n", F.substring(F.col("m"), start + 1, F.lit(max_length - 1)).alias("suffix"))


def cut_pieces(counted: DataFrame, by: Sequence[str], max_length: int = 16, stride: int = 4) -> DataFrame:
    """(by.., n, piece): the substrings of pre-tokens (by.., p, first, n), as ``seed_scores`` defines them."""
    cut = cut_suffixes(counted, by, max_length, stride)
    return cut.select(*by, "n", "suffix", F.explode(F.sequence(F.lit(1), F.length("suffix"))).alias("k")).select(*by, "n", F.substring(F.col("suffix"), F.lit(1), F.col("k")).alias("piece"))


def _differ(column: pa.ChunkedArray) -> np.ndarray:
    """Whether a value isn't the one before; the first is."""
    here, last = column.slice(1), column.slice(0, len(column) - 1)
    other = pc.or_(pc.fill_null(pc.not_equal(here, last), False), pc.xor(pc.is_null(here), pc.is_null(last)))
    return np.concatenate([[True], other.to_numpy().astype(bool)])


def _prefix_sums(by: Sequence[str], shortest: int, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(by.., suffix, k, n): sums over the prefixes of k characters of sorted suffixes (by.., suffix, n). A prefix's suffixes stand
    together, so a batch is added up by runs; held from one batch to the next are its last row and the sums of that row's prefixes."""

    def picked(rows: pa.Table, at: np.ndarray, k: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        of = rows.select([*by, "suffix"]).take(pa.array(at))
        yield from of.append_column("k", pa.array(k, pa.int32())).append_column("n", pa.array(n, pa.int64())).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_ = None, np.zeros(longest + 1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
            n = rows["n"].to_numpy().copy()
            size = pc.utf8_length(rows["suffix"]).to_numpy()
            units = rows["suffix"].to_numpy().astype(f"<U{longest}").view(np.uint32).reshape(len(n), longest)
            # characters that a suffix shares with the one before
            shared = np.concatenate([[0], np.minimum.accumulate(units[1:] == units[:-1], axis=1).sum(axis=1)])
            for c in by:
                shared[_differ(rows[c])] = 0
            last = np.zeros_like(open_)
            out = []
            for k in range(shortest, longest + 1):
                if held is not None:
                    n[0] = open_[k]
                long = np.flatnonzero(size >= k)
                if not len(long):
                    continue
                new = shared[long] < k
                new[0] = True
                starts = np.flatnonzero(new)
                at, sums = long[starts], np.add.reduceat(n[long], starts)
                if long[-1] == len(n) - 1:
                    last[k], at, sums = sums[-1], at[:-1], sums[:-1]
                out.append((at, np.full(len(at), k), sums))
            held, open_ = rows.slice(len(n) - 1), last
            if out:
                yield from picked(rows, *map(np.concatenate, zip(*out, strict=True)))
        if held is not None:
            k = np.arange(shortest, pc.utf8_length(held["suffix"])[0].as_py() + 1)
            yield from picked(held, np.zeros(len(k), dtype=int), k, open_[k])

    return run


def seed_scores(texts: DataFrame, max_length: int = 16, stride: int = 4, by: str | Sequence[str] = "batch_id", text_col: str = "text") -> DataFrame:
    """(by.., piece, score): byte-level substrings from every stride-th start of each pre-token, of 1 to max_length - 1
    bytes; each occurrence scores the UTF-8 length of its printable form.

    Starts are the byte offsets of the pre-token's characters counted from the end of the first one; the first
    pre-token of a text, which gets a space in front, has one more start at 0. Pre-tokens are counted before they're
    cut up, so a frequent one is cut once for each batch. Suffixes, not their prefixes, are shuffled: they're dealt by their
    first HEAD characters and sorted, so longer pieces are added up where they are; shorter ones are few and are added up
    from the sums of what suffixes begin with.
    """
    by = [by] if isinstance(by, str) else list(by)
    counted = first_pretokens(texts, by, text_col).groupBy(*by, "p", "first").agg(F.count("*").alias("n"))
    head = lambda n: F.substring(F.col("suffix"), F.lit(1), n)
    score = F.sum(F.col("n") * F.octet_length("piece")).cast("long").alias("score")
    dealt = spread(cut_suffixes(counted, by, max_length, stride).withColumn("_head", F.xxhash64(*by, head(F.lit(HEAD)))), "_head")
    begun = dealt.groupBy(*by, head(F.lit(HEAD - 1)).alias("suffix")).agg(F.sum("n").alias("n"))
    short = begun.select(*by, "n", "suffix", F.explode(F.sequence(F.lit(1), F.length("suffix"))).alias("k")).select(*by, "n", head(F.col("k")).alias("piece"))
    short = short.groupBy(*by, "piece").agg(score)
    if max_length <= HEAD:
        return short
    schema = StructType([*(dealt.schema[c] for c in by), StructField("suffix", StringType()), StructField("k", IntegerType()), StructField("n", LongType())])
    # the hash first, as most comparisons end with it
    ordered = dealt.sortWithinPartitions("_head", *by, "suffix").select(*by, "suffix", "n")
    long = ordered.mapInArrow(_prefix_sums(by, HEAD, max_length - 1), schema).select(*by, head(F.col("k")).alias("piece"), "n")
    return long.select(*by, "piece", (F.col("n") * F.octet_length("piece")).cast("long").alias("score")).unionByName(short)


def window_scores(scores: DataFrame, last: int, by: str = "batch_id") -> DataFrame:
    """(window_id, piece, score): for each batch the sums over it and the ``last`` - 1 batches before; windows that
    aren't full are left out. Batches are numbered from 0 without gaps."""
    scores = materialise(scores.select(by, "piece", "score"), "window-scores")  # read twice, made once
    spread = scores.select(F.explode(F.sequence(F.col(by), F.col(by) + last - 1)).alias("window_id"), "piece", "score")
    top = scores.agg(F.max(by).alias("_top"))
    kept = spread.join(F.broadcast(top), F.col("window_id") <= F.col("_top")).where(F.col("window_id") >= last - 1)
    return kept.groupBy("window_id", "piece").agg(F.sum("score").alias("score"))


def recent_scores(scores: DataFrame, last: int, keys: Sequence[str], upto: int | None = None, by: str = "batch_id") -> DataFrame:
    """(keys.., piece, score): for each group the sums over the ``last`` batches it occurs in, up to a batch; a group that is
    rare reaches further back."""
    held = scores if upto is None else scores.where(F.col(by) <= upto)
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by)))
    batches = held.select(*keys, by).distinct().withColumn("_age", newest).where(F.col("_age") <= last).drop("_age")
    return held.join(batches, [*keys, by], "left_semi").groupBy(*keys, "piece").agg(F.sum("score").alias("score"))


def recent_texts(texts: DataFrame, last: int, keys: Sequence[str], by: str = "batch_id", text_col: str = "text") -> DataFrame:
    """The texts of the ``last`` batches that each group occurs in: those that ``recent_scores`` adds up, before they're cut up. A
    null text is no part of a batch, any other gives a piece. A few batches a group are found first, in a table whose size
    decides whether it's broadcast."""
    some = texts.where(F.col(text_col).isNotNull())
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by)))
    batches = some.select(*keys, by).distinct().withColumn("_age", newest).where(F.col("_age") <= last).drop("_age")
    return some.join(materialise(batches, "newest-batches"), [*keys, by], "left_semi")


def blank_inventory(spark: SparkSession, max_length: int = 16) -> DataFrame:
    """(piece): runs of a blank up to max_length - 1 long after any first blank."""
    of = spark.createDataFrame([(c,) for c in BLANKS], "c string")
    runs = of.select(F.col("c").alias("c1")).crossJoin(of.select(F.col("c").alias("c2")))
    return runs.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(max_length - 1)), lambda i: F.concat(F.col("c2"), F.repeat(F.col("c1"), i)))).alias("piece"))


def sampled_vocab(scores: DataFrame, specials: DataFrame, seed_size: int, noise_std: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, piece, is_special, score, byte_length, old_id): a vocabulary induced from seed scores with the special pieces
    (ref_id, piece) at their reference ids and score 0; old_id is a special's reference id."""
    induced = materialise(induce(scores, seed_size, noise_std=noise_std, seed=seed), "induced")
    placed = place_specials(induced.select("rank", "piece"), specials).join(induced.select("piece", "logp"), "piece", "left")
    score = F.when(F.col("is_special"), F.lit(0.0)).otherwise(F.col("logp"))
    return placed.select("id", "piece", "is_special", score.alias("score"), F.length("piece").alias("byte_length"), "old_id")


def induce(scores: DataFrame, seed_size: int, max_length: int = 16, noise_std: float = 0.0, seed: int = 0) -> DataFrame:
    """(rank, piece, logp): the alphabet at the least log-probability, the runs of blanks at 0.0, and then the best
    pieces by score until the whole list has seed_size (one at least); ties by piece.

    Pieces of one character or with two blanks don't stand as candidates; noise, seeded by the piece, is added to probabilities, and one
    that isn't positive counts as minus infinity (-100000).
    """
    spark = scores.sparkSession
    scores = materialise(scores.select("piece", "score"), "induced-scores")  # read twice and more, made once
    total = materialise(scores.agg(F.sum("score").alias("_sum"), F.min("score").alias("_min")), "induced-total")
    p = F.col("score") / F.col("_sum") + (normal(F.col("piece"), seed) * noise_std if noise_std else F.lit(0.0))
    candidates = scores.where((F.length("piece") > 1) & ~blank_run(F.col("piece"))).crossJoin(F.broadcast(total))
    candidates = candidates.select("piece", "score", F.when(p > 0, F.log(p)).otherwise(F.lit(FLOOR)).alias("logp"))
    fixed = 256 + 9 * (max_length - 1)
    best = candidates.orderBy(F.desc("score" if not noise_std else "logp"), "piece").limit(max(1, seed_size - fixed))
    best = best.withColumn("segment", F.lit(2)).withColumn("order", F.row_number().over(Window.orderBy(F.desc("logp"), F.desc("score"), "piece")))
    letters = spark.createDataFrame([(i, c) for i, c in sorted(byte_alphabet().items())], "order int, piece string").withColumn("segment", F.lit(0))
    letters = letters.crossJoin(F.broadcast(total)).withColumn("logp", F.log(F.col("_min") / F.col("_sum")))
    blanks = blank_inventory(spark, max_length).withColumn("segment", F.lit(1)).withColumn("logp", F.lit(0.0))
    blanks = blanks.withColumn("order", F.row_number().over(Window.orderBy("piece")))
    cols = ["segment", "order", "piece", "logp"]
    whole = letters.select(*cols).unionByName(blanks.select(*cols)).unionByName(best.select(*cols))
    return whole.select((F.row_number().over(Window.orderBy("segment", "order")) - 1).alias("rank"), "piece", "logp")
