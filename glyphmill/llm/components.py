"""Connected components by alternating large-star and small-star steps, all in joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.session import materialise


def _fingerprint(edges: DataFrame) -> tuple:
    """Equal for equal edge sets: their number and two 31-bit sums of row hashes."""
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.sum(h.bitwiseAND(0x7FFFFFFF)), F.sum(F.shiftrightunsigned(h, 33))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the smallest node that can be reached.

    A node with any number of neighbours is handled by a partial minimum and a join, never gathered as a list. Each
    round's edges are a written table, so a lost executor costs one round at most. Self-loops, repeated edges and
    an empty table are fine; an edge with a null end is ignored. The rounds grow with the logarithm of the size.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    )
    current = materialise(pairs.distinct(), "edges")
    seen = _fingerprint(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a != b")
            .distinct()
        )
        current = materialise(small, "edges")
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
