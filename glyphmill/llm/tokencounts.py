"""Token counts: an exact histogram of encoded lengths, from which suffix sums answer for every context limit."""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A file of base64 tokens and ranks; it is read on the driver and sent to the workers, who needn't have it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenization pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Long runs of white space, which are cut out before the pattern sees them: it takes its stack from their length. The
#: characters are those that the pattern's \\s stands for.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@lru_cache(maxsize=2)
def _encoder(raw: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_length(encoder: tiktoken.Encoding, text: str) -> int:
    """The number of tokens of a text. A long run of white space is one piece (but for its last character, if more text
    follows), so it's encoded by itself; what stands before and behind it doesn't depend on it."""
    total = at = 0
    for run in _BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        total += len(encoder.encode_ordinary(text[at : run.start()])) + len(encoder._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(encoder.encode_ordinary(text[at:]))


def length_histogram(docs: DataFrame, source_col: str = "source", text_col: str = "text", ranks_path: str = RANKS) -> DataFrame:
    """(source, n_tokens, n_docs): how many documents of each source have each encoded length.

    Whole texts are encoded; special tokens' names count as plain text. A null or empty text has length 0, a null
    source is a source, repeated rows count each. Other columns are ignored; an empty table gives an empty histogram.
    Each task adds up its documents before anything is shuffled.
    """
    with open(ranks_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value)
        for batch in batches:
            counts = Counter(
                (source, encoded_length(encoder, text.as_py() or "")) for source, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            )
            rows = list(counts.items())
            cols = [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["source", "n_tokens", "n_docs"])

    source = docs.select(F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "source string, n_tokens long, n_docs long").groupBy("source", "n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each source, and for all together (scope ``all``), a row for each length that occurs, taken as a limit.

    docs_at_least and tokens_at_least are sums over this and longer lengths; tokens_total is over all lengths,
    truncated_total is the tokens that remain if each document is cut at the limit, quantile is the share of documents
    of this length or shorter. Between two lengths all of these follow from the next longer one (see ``answers``).
    """
    both = histogram.select(F.lit("source").alias("scope"), "source", "n_tokens", "n_docs").unionByName(
        histogram.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")).select(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("source"), "n_tokens", "n_docs")
    )
    scope = Window.partitionBy("scope", "source")
    longer = scope.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    tokens = F.col("n_docs") * F.col("n_tokens")
    out = both.withColumns(
        {
            "docs_at_least": F.sum("n_docs").over(longer),
            "tokens_at_least": F.sum(tokens).over(longer),
            "docs_total": F.sum("n_docs").over(scope),
            "tokens_total": F.sum(tokens).over(scope),
        }
    )
    cut = F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    share = (F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total")
    return out.withColumn("truncated_total", cut).withColumn("quantile", share)


def answers(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(scope, source, context_limit, docs_over, truncated_total) for any limits, exactly, from the suffix sums."""
    parts = []
    for limit in limits:
        over = F.col("n_tokens") > limit
        parts.append(
            F.struct(
                F.lit(limit).cast("long").alias("context_limit"),
                F.coalesce(F.max(F.when(over, F.col("docs_at_least"))), F.lit(0)).alias("docs_over"),
                (F.max("tokens_total") - F.coalesce(F.max(F.when(over, F.col("tokens_at_least"))), F.lit(0))
                 + F.coalesce(F.max(F.when(over, F.col("docs_at_least"))), F.lit(0)) * limit).alias("truncated_total"),
            )
        )
    grouped = sums.groupBy("scope", "source").agg(F.array(*parts).alias("a"))
    return grouped.select("scope", "source", F.explode("a").alias("a")).select("scope", "source", "a.*")


def quantile_lengths(sums: DataFrame, quantiles: list[float]) -> DataFrame:
    """(scope, source, q, n_tokens): the smallest length that at least a share q of the documents doesn't exceed."""
    parts = [F.struct(F.lit(float(q)).alias("q"), F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in quantiles]
    grouped = sums.groupBy("scope", "source").agg(F.array(*parts).alias("a"))
    return grouped.select("scope", "source", F.explode("a").alias("a")).select("scope", "source", "a.*")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Suffix sums for each source and for all documents."""
    return suffix_sums(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")))
