"""Repeated substrings from sorted suffixes: a row for each start of a text, not for each start and length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.session import spread


class _Path:
    """The open prefixes of the suffix read last: their sums, and the least and greatest character that followed each."""

    def __init__(self, longest: int) -> None:
        self.longest, self.text, self.first = longest, "", None
        self.n, self.low, self.high = [0] * (longest + 1), [""] * (longest + 1), [""] * (longest + 1)
        self.out: list[tuple[str, int, str, str]] = []

    def close(self, depth: int, at_end: bool = False) -> None:
        """Closes the prefixes longer than ``depth``. One that another range may share goes out as a part, whatever followed it."""
        for d in range(min(len(self.text), self.longest), depth, -1):
            if self.low[d] < self.high[d] or at_end or self.first[:d] == self.text[:d]:
                self.out.append((self.text[:d], self.n[d], self.low[d], self.high[d]))
            self.n[d - 1] += self.n[d]

    def add(self, suffix: str, n: int) -> None:
        if self.first is None:
            self.first = suffix
        common, most = 0, min(len(suffix), len(self.text), self.longest)
        while common < most and suffix[common] == self.text[common]:
            common += 1
        self.close(common)
        deepest = min(len(suffix), self.longest)
        for d in range(common, deepest + 1):
            after = suffix[d : d + 1]
            if d > common:
                self.n[d], self.low[d], self.high[d] = 0, after, after
            else:
                self.low[d], self.high[d] = min(self.low[d], after), max(self.high[d], after)
        self.n[deepest] += n
        self.text = suffix

    def rows(self) -> pd.DataFrame:
        found, self.out = self.out, []
        return pd.DataFrame(found, columns=["piece", "n", "low", "high"])


def repeated_substrings(counts: DataFrame, longest: int = 16, shortest: int = 2) -> DataFrame:
    """(piece, n): the substrings of texts (pretoken, n) that different characters follow (the end of a text is one of them),
    with how often they occur, overlaps included: the inner nodes of the suffix tree down to ``longest`` characters.

    Any other substring always goes on the same way, so a longer one stands for it. Suffixes, cut to one character more
    than the longest piece, are added up and sorted in sampled ranges; a task reads its range once with the open prefixes
    on a stack. Prefixes that a range shares with its neighbours, at most twice ``longest`` a range, are added up after.
    Null and empty texts have none; repeated rows add up.
    """
    starts = spread(counts, "pretoken").select("pretoken", "n", F.explode(F.sequence(F.lit(1), F.length("pretoken"))).alias("at")).where("at >= 1 AND at <= length(pretoken)")
    suffixes = starts.select(F.substring(F.col("pretoken"), F.col("at"), F.lit(longest + 1)).alias("suffix"), "n").groupBy("suffix").agg(F.sum("n").alias("n"))
    ranges = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = _Path(longest)
        for frame in frames:
            for suffix, n in zip(frame["suffix"], frame["n"], strict=True):
                path.add(suffix, n)
            yield path.rows()
        path.close(0, at_end=True)
        yield path.rows()

    parts = suffixes.repartitionByRange(ranges, "suffix").sortWithinPartitions("suffix").mapInPandas(run, "piece string, n long, low string, high string")
    whole = parts.groupBy("piece").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return whole.where((F.col("low") < F.col("high")) & (F.length("piece") >= shortest)).select("piece", "n")


def seed_pieces(counts: DataFrame, size: int, longest: int = 16) -> DataFrame:
    """(piece, n): every character of the texts, and the ``size`` repeated substrings that cover the most, by n times
    length; ties by piece."""
    chars = counts.select(F.explode(F.split("pretoken", "")).alias("piece"), "n").where("piece <> ''").groupBy("piece").agg(F.sum("n").alias("n"))
    best = repeated_substrings(counts, longest).orderBy(F.desc(F.col("n") * F.length("piece")), "piece").limit(size)
    return chars.unionByName(best)
