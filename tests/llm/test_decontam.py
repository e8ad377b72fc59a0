import re

import duckdb
import numpy as np

from glyphmill.llm.decontam import OP2_SQL, find_leaks, op2_decontam, window_minima

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def sets(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items):
    out = {}
    wanted = [(i, s) for i, t in items if (s := sets(t))]
    short = [(i, w) for i, t in items if 0 < len(w := words(t)) < 5]
    for d, t in docs:
        own = sets(t)
        for i, s in wanted:
            if len(s & own) / len(s) >= 0.8:
                out[d, i] = max(out.get((d, i), 0), len(s & own) / len(s))
        for i, w in short:
            if tuple(w) in sets(t, len(w)):
                out[d, i] = 1.0
    return out


def test_window_minima():
    rng = np.random.default_rng(0)
    value, first = rng.integers(0, 1000, 50), np.array([0, 0, 7, 50])
    got = window_minima(value, first, 4)
    want = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        want += [value[x : min(x + 8, b)].min() for x in range(a, b, 4)]
    assert got.tolist() == want


def test_query_matches_brute_force(spark):
    read = lambda n: [tuple(r) for r in spark.read.parquet(f"{SF}/{n}.parquet").selectExpr(*(["doc_id", "text"] if n == "documents" else ["item_id", "text"])).collect()]
    got = {(r.doc_id, r.item_id): r.containment for r in op2_decontam(spark, SF).collect()}
    assert got == brute(read("documents"), read("benchmark")) and got


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = sorted((r.doc_id, r.item_id, r.containment) for r in op2_decontam(spark, SF).collect())
    assert got == sorted(con.execute(OP2_SQL).fetchall()) and got


def test_partial_copies_and_edges(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, say(int(n))) for i, n in enumerate(rng.integers(6, 90, 40))] + [(100, None), (101, "too short"), (102, "Word"), (103, "one, two three four"), (104, "w1"), (None, say(30)), (5, say(20))]
    docs = []
    for d in range(120):
        i, t = items[int(rng.integers(0, 40))]
        w = t.split()
        if d % 3 == 0:
            w[len(w) // 2] = "changed"
        if d % 4 == 0:
            w = w[: len(w) * 9 // 10]
        text = f"{say(int(rng.integers(0, 600)))} {' '.join(w).upper() if d % 5 == 0 else ', '.join(w)} {say(int(rng.integers(0, 600)))}"
        docs.append((d if d % 50 else None, text))
    docs += [(7, None), (7, None), (8, ""), (9, items[3][1]), (9, items[3][1]), (10, "x " * 100000 + items[4][1]), (11, "not too short"), (12, "one two three"), (13, "a word"), (14, "so one two three four five six")]
    df = spark.createDataFrame([(*d, 0, "q") for d in docs], "doc_id long, text string, item_id int, keys string")
    of = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.containment for r in find_leaks(df, of).groupBy("doc_id", "item_id").agg({"containment": "max"}).toDF("doc_id", "item_id", "containment").collect()}
    assert got == brute(docs, items)
    assert find_leaks(df.limit(0), of).count() == 0 and find_leaks(df, of.limit(0)).count() == 0
