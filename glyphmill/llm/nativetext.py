"""Words as a Spark expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The word pattern [^\x20\x09-\x0D]+, and what stands between words.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for null. Splitting costs less than extracting matches."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")
