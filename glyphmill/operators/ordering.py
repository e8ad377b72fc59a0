"""Row numbers of an order without one task that sorts everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.session import materialise


def numbered(df: DataFrame, name: str, order: Sequence[str | Column], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``name``, each row's place in its group's order, from 0; equal rows of an order number in any way.

    Rows are dealt into ranges of (by, order) whose bounds Spark samples, so ranges are of like size for any type and any
    outlier, and a group that holds most of the rows has many of them. Each range is sorted, its rows get consecutive
    ids, and the table is written once; a place is the id less the first of its group in that range, plus the group's
    rows in earlier ranges. What is summed in one task is a row for each range and group. Null counts as a value.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = [*[F.col(b) for b in by], *order]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    rows = materialise(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = starts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    starts = starts.select(*[F.col(k).alias(f"_of_{k}") for k in [*by, "_part"]], "_shift")
    condition = F.lit(True)
    for k in [*by, "_part"]:
        condition &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(starts, condition).withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)
