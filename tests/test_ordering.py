import random

from pyspark.sql import functions as F

from glyphmill.operators.ordering import numbered


def places(rows, by, order):
    out, seen = {}, {}
    for r in sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in order(r))):
        out[r[0]] = seen.get(by(r), 0)
        seen[by(r)] = out[r[0]] + 1
    return out


def test_row_numbers(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, -5, 10**12, *range(40)]) if i % 3 else i * i) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, g string, x long").repartition(7)
    got = {r.k: r.at for r in numbered(df, "at", ["x", "k"], ["g"]).collect()}
    assert got == places(rows, lambda r: r[1], lambda r: (r[2], r[0]))
    got = {r.k: r.at for r in numbered(df, "at", ["x", "k"]).collect()}
    assert got == places(rows, lambda r: 0, lambda r: (r[2], r[0]))
    named = [(k, g, f"{k * 7919 % 900:03x}") for k, g, _ in rows]
    df = spark.createDataFrame(named, "k long, g string, x string")
    got = {r.k: r.at for r in numbered(df, "at", [F.concat("x", F.lit("z"))], ["g"]).collect()}
    assert got == {k: v for k, v in places([(k, g, int(x, 16)) for k, g, x in named], lambda r: r[1], lambda r: (r[2],)).items()}


def test_edges_of_row_numbers(spark):
    one = spark.createDataFrame([(5, 1.5), (5, 2.5), (5, None)], "x long, y double")
    assert sorted(r.at for r in numbered(one, "at", ["x"]).collect()) == [0, 1, 2]
    assert [(r.y, r.at) for r in numbered(one, "at", ["y"]).orderBy("at").collect()] == [(None, 0), (1.5, 1), (2.5, 2)]
    assert numbered(one.limit(0), "at", ["x"]).count() == 0


def test_any_type_and_any_outlier_makes_many_ranges(spark):
    df = spark.range(4000).select("id", (F.col("id") * 0.5).alias("x"), F.when(F.col("id") == 7, 10**15).otherwise(F.col("id")).alias("y"), (F.col("id") % 2).alias("g"))
    for order in ("x", "y"):
        rows = numbered(df, "at", [order], ["g"])
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
        assert sorted(r.at for r in rows.where("g = 1").collect()) == list(range(2000))
        at = rows.select("at", order, "g").orderBy("g", order).collect()
        assert [r.at for r in at] == [*range(2000), *range(2000)]
