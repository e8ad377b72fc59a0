import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import counts as C
from glyphmill.operators import encode as E
from glyphmill.operators import suffixes as X


def plain_repeats(counts: dict[str, int], longest: int, shortest: int) -> dict[str, int]:
    n, after = Counter(), {}
    for text, m in counts.items():
        for i in range(len(text)):
            for k in range(1, min(longest, len(text) - i) + 1):
                n[text[i : i + k]] += m
                after.setdefault(text[i : i + k], set()).add(text[i + k : i + k + 1])
    return {p: m for p, m in n.items() if len(after[p]) > 1 and len(p) >= shortest}


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_repeated_substrings_for_any_ranges(spark, ranges):
    draw = random.Random(ranges)
    counts = {"".join(draw.choice("abé") for _ in range(draw.randint(1, 14))): draw.randint(1, 9) for _ in range(150)}
    counts |= {"a" * 60: 1000, "ab" * 25: 7}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        df = spark.createDataFrame(list(counts.items()), "pretoken string, n long")
        for longest, shortest in ((5, 1), (16, 2)):
            found = X.repeated_substrings(df, longest, shortest).collect()
            assert len(found) == len({r.piece for r in found})
            assert {r.piece: r.n for r in found} == plain_repeats(counts, longest, shortest)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repeated_substrings_of_nothing_and_of_repeated_rows(spark):
    assert X.repeated_substrings(spark.createDataFrame([], "pretoken string, n long")).count() == 0
    rows = spark.createDataFrame([("", 3), (None, 3), ("xyx", 1), ("xyx", 2), ("xyz", 1)], "pretoken string, n long")
    assert {r.piece: r.n for r in X.repeated_substrings(rows).collect()} == {"xy": 4}
    assert {r.piece: r.n for r in X.seed_pieces(rows, 5).collect()} == {"x": 7, "y": 4, "z": 1, "xy": 4}


def test_removal_losses_by_hand(spark):
    scores = {"a": -2.0, "b": -2.0, "ab": -1.0, "ba": -3.0}
    used = {"a": 4.0, "b": 2.0, "ab": 6.0}
    found = E.removal_losses(spark.createDataFrame([("ab",), ("ba",)], "piece string"), scores, used)
    wanted = 6 * (math.log(6 / 12) - math.log(10 / 18) - math.log(8 / 18))
    assert found["ba"] == 0.0 and found["ab"] == pytest.approx(wanted)


def test_training_keeps_what_the_texts_need(spark):
    counts = spark.createDataFrame([("therein", 50), ("there", 200), ("herein", 30), ("in", 300), ("q", 1)], "pretoken string, n long")
    seeds = {r.piece: -5.0 for r in X.seed_pieces(counts, 40).collect()}
    vocab = E.train_unigram(counts, seeds, 10)
    assert len(vocab) <= 10 and set("therinq") <= set(vocab)
    assert E.best_segmentation("therein", vocab, 16) in (["there", "in"], ["there", "i", "n"], ["therein"])
    assert E.train_unigram(counts.where("false"), seeds, 10) == seeds


def test_occurrences_by_automaton_and_by_join(spark, monkeypatch):
    draw = random.Random(5)
    texts = ["".join(draw.choice("abcdé") for _ in range(draw.randint(1, 20))) for _ in range(400)] + ["", None]
    pieces = {"".join(draw.choice("abcdé") for _ in range(draw.randint(1, 7))) for _ in range(3000)}
    vocab = spark.createDataFrame([(i, p, False) for i, p in enumerate([*sorted(pieces), "a", "", None, "<s>"])], "id int, piece string, is_special boolean")
    counts = spark.createDataFrame([(t, i % 7 + 1) for i, t in enumerate(texts)], "pretoken string, n long")
    for longest in (None, 4):
        monkeypatch.setattr(C, "BROADCAST_PIECES", 200_000)
        by_automaton = {r.id: r.n for r in C.occurrences(counts, vocab, longest).collect()}
        monkeypatch.setattr(C, "BROADCAST_PIECES", 10)
        assert by_automaton == {r.id: r.n for r in C.occurrences(counts, vocab, longest).collect()}
        assert by_automaton[0] > 0 and len(by_automaton) == vocab.count()
    assert {r.n for r in C.occurrences(counts.where("false"), vocab).collect()} == {0}


def test_fifty_thousand_pieces(spark):
    """Rows out grow with what is found, not with the texts' substrings."""
    vocab = spark.range(50_000).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("w"), F.col("id"), F.lit("x")).alias("piece"), F.lit(False).alias("is_special"))
    counts = spark.range(0, 50_000, 5).select(F.concat(F.lit("-w"), F.col("id"), F.lit("x-")).alias("pretoken"), F.lit(2).cast("long").alias("n"))
    found = C.occurrences(counts, vocab).agg(F.sum("n"), F.count_if(F.col("n") > 0), F.count("*")).first()
    assert tuple(found) == (20_000, 10_000, 50_000)
