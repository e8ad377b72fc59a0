import random

import duckdb

from glyphmill.llm import linededup
from glyphmill.llm.linededup import OP4_SQL, dedup_lines, line_decisions, op4_line_dedup

SF = "/root/testdata/sf0.001"


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows):
    lines = []
    for i, t in rows:
        if t is not None:
            lines += [((i is not None, i or 0, j), w) for j, x in enumerate(t.split("\n")) if (w := x.encode().split())]
    lines.sort(key=lambda x: x[0])
    gone = set()
    for k, (at, w) in enumerate(lines):
        if any(w == v or (min(len(w), len(v)) >= 8 and distance_at_most_one(w, v)) for a, v in lines[:k] if a < at):
            gone.add(at)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, t))
            continue
        kept = [x for j, x in enumerate(t.split("\n")) if (i is not None, i or 0, j) not in gone]
        if len(kept) < len(t.split("\n")) and not " ".join(kept).split():
            continue
        out.append((i, "\n".join(kept)))
    return out


def test_query_matches_its_sql(spark):
    want = duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'") or duckdb.sql(OP4_SQL).fetchall()
    got = [tuple(r) for r in op4_line_dedup(spark, SF).collect()]
    assert sorted(got) == sorted(want) and sum(r[2] for r in got) > 0


def test_texts_match_brute_force(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.choice([2, 3, 7, 8, 9, 12, 20]))) for _ in range(40)]
    rows = [(None, "\n".join(base[:3])), (None, None), (500, None), (501, ""), (502, "\n\n"), (503, "a b c\na b c"), (504, "long " * 30000 + "\n" + "long " * 30001), (504, "other id text here")]
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                kind, at = rng.randint(0, 2), rng.randrange(len(w))
                w = w[:at] + [["new"], ["new", w[at]], []][kind] + w[at + 1 :]
                w = w or ["x"]
            lines.append(("  " if rng.random() < 0.2 else " ").join(w))
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, line_no int, h1 string")
    out = dedup_lines(df)
    assert out.columns == df.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(brute(rows), key=key)
    assert dedup_lines(df.limit(0)).count() == 0


def test_repeated_rows_are_treated_alike(spark):
    df = spark.createDataFrame([(1, "one two three\nfour five six"), (1, "one two three\nfour five six"), (2, "four five six\nseven eight nine")], "doc_id long, text string")
    assert sorted(r.text for r in dedup_lines(df).collect()) == ["one two three\nfour five six"] * 2 + ["seven eight nine"]


def test_plans_hash_a_text_once_and_filter_before_the_join(spark, monkeypatch):
    plans, write = {}, linededup.materialise

    def keep(df, name, *more):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name, *more)

    monkeypatch.setattr(linededup, "materialise", keep)
    df = spark.createDataFrame([(1, "a b c d e f g h i j\nx"), (2, "a b c d e f g h i k\ny")], "doc_id long, text string")
    assert [(r.doc_id, r.gone) for r in line_decisions(df).collect()] == [(2, [0])]
    above, below = plans["lines"].split("Generate posexplode", 1)
    assert "xxhash64(text" not in above and "xxhash64(text" in below
    joins = [x for x in plans["line-meetings"].split("\n") if "Join " in x]
    assert len(joins) == 2 and "_slot" in joins[1] and "_slot" not in joins[0]  # the bit table's join is the inner, earlier one
