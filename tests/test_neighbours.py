import numpy as np
import pytest

from glyphmill.operators import neighbours
from glyphmill.operators.neighbours import most_similar


def plain(queries, table, k):
    unit = lambda v: np.asarray(v) / max(np.linalg.norm(v), 1e-300)
    out = {}
    for q, a in queries:
        s = sorted((-round(float(unit(a) @ unit(b)), 12), n) for n, b in table)
        out |= {(q, n): -x for x, n in s[:k]}
    return out


@pytest.mark.parametrize("clusters", [1, 5, 64])
def test_most_similar_is_exact(spark, clusters):
    draw = np.random.default_rng(clusters)
    middles = draw.normal(size=(6, 8)) * 3
    table = [(i, (middles[min(i % 12, 5)] + draw.normal(size=8) * 0.3).tolist()) for i in range(2500)]
    table += [(3000 + i, table[0][1]) for i in range(20)] + [(4000, [0.0] * 8)]
    queries = [(f"q{i}", v) for i, v in table[::25]]
    t = spark.createDataFrame(table, "id long, vec array<double>")
    q = spark.createDataFrame(queries, "id string, vec array<double>")
    found = {(r.id, r.n): r.s for r in most_similar(q, t, 7, clusters).collect()}
    wanted = plain(queries, table, 7)
    assert found.keys() == wanted.keys()
    assert all(abs(found[x] - wanted[x]) < 1e-9 for x in wanted)


def test_most_similar_of_few_and_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0])]
    t = spark.createDataFrame(rows, "id int, vec array<float>")
    found = {(r.id, r.n): r.s for r in most_similar(t, t).collect()}
    assert found == {(i, j): float(i == j and i < 3) for i in (1, 2, 3) for j in (1, 2, 3)}
    assert most_similar(t, t.where("false")).count() == 0 and most_similar(t.where("false"), t).count() == 0


def test_no_plan_compares_all_pairs(spark):
    draw = np.random.default_rng(1)
    t = spark.createDataFrame([(i, draw.normal(size=4).tolist()) for i in range(50)], "id int, vec array<double>")
    text = most_similar(t, t)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_string_ids_tie_in_order(spark):
    t = spark.createDataFrame([(f"n{i}", [1.0, float(i % 2)]) for i in range(30)], "id string, vec array<double>")
    found = most_similar(t, t, 3).where("id = 'n1'").collect()
    assert sorted(r.n for r in found) == ["n1", "n11", "n13"]


def test_a_row_travels_to_shares_not_to_clusters(spark):
    draw = np.random.default_rng(2)
    t = spark.createDataFrame([(i, draw.normal(size=16).tolist()) for i in range(600)], "id int, vec array<double>")
    plan = most_similar(t, t)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(q_share" in plan and "hashpartitioning(cluster#" in plan
    assert neighbours._shares(1_000_000, 64) == neighbours.SHARES and neighbours._shares(2_000_000, 64) == 16


def test_many_blocks_give_k_rows_a_query(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    draw = np.random.default_rng(3)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    q, m = unit(draw.normal(size=(20, 6))), unit(draw.normal(size=(300, 6)))
    m[200:] = m[:100]
    table = {0: (np.arange(150), m[:150]), 1: (np.arange(150, 300), m[150:])}
    at, n, s = neighbours._best(q, np.full(20, -np.inf), np.ones((20, 2), dtype=bool), table, 4)
    assert len(at) == 80
    for i in range(20):
        want = sorted((-x, j) for j, x in enumerate(np.round(m @ q[i], 12)))[:4]
        assert [(-x, j) for x, j in zip(s[at == i], n[at == i], strict=True)] == want
