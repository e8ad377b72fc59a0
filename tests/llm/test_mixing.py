import itertools
from collections import Counter, defaultdict

import numpy as np

from glyphmill.llm.mixing import even_picks, fit_budget, mix, op6_mixing, source_targets, with_size

SF = "/root/testdata/sf0.001"


def test_fit_budget_finds_the_best_sum():
    rng = np.random.default_rng(3)
    for _ in range(60):
        k = int(rng.integers(1, 5))
        lengths = rng.choice(np.arange(1, 40), k, replace=False)
        counts = rng.integers(1, 4, k)
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 5))
        picks = fit_budget(lengths, counts, budget)
        assert (picks >= 0).all() and (picks <= counts).all()
        got = int((picks * lengths).sum())
        best = max(s for x in itertools.product(*[range(c + 1) for c in counts]) if (s := int((np.array(x) * lengths).sum())) <= budget)
        assert got == best
        even = counts if budget >= total else even_picks(lengths, counts, budget)
        assert 0 <= min(budget, total) - int((even * lengths).sum()) < max(lengths)


def test_all_lengths_are_taken_alike():
    rng = np.random.default_rng(4)
    lengths = np.unique(np.concatenate([rng.integers(1, 400, 300), (rng.pareto(2.5, 5000) * 600 + 1).astype(int)]))
    for counts in (np.ones(len(lengths), int), rng.integers(1, 5, len(lengths))):
        for share in (0.2, 0.5, 0.77):
            budget = int((lengths * counts).sum() * share)
            picks = fit_budget(lengths, counts, budget)
            assert budget - 1 <= (picks * lengths).sum() <= budget
            for part in np.array_split(np.arange(len(lengths)), 10):
                assert abs(picks[part].sum() - share * counts[part].sum()) <= 0.03 * counts[part].sum() + 3


def test_targets_are_reshared():
    t = source_targets({"a": 10, "b": 1000, "c": 1000, None: 5})
    assert t["a"] == 20 and t[None] == 10
    assert abs(sum(t.values()) - 1.5 * 2015) < 1e-6 and all(t[s] <= 2 * n for s, n in {"a": 10, "b": 1000, "c": 1000, None: 5}.items())
    assert source_targets({}) == {}


def test_query(spark):
    rows = op6_mixing(spark, SF).collect()
    again = op6_mixing(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(rows) == sorted(again) and len(rows) == len(docs)
    size, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == len(docs[r.doc_id].text.encode().split())
        assert 0 <= r.taken <= 2 * r["size"]
        size[docs[r.doc_id].source] += r["size"]
        taken[docs[r.doc_id].source] += r.taken
    want = source_targets(dict(size))
    for r in rows:
        s = docs[r.doc_id].source
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6
    sizes = defaultdict(list)
    for r in rows:
        sizes[docs[r.doc_id].source].append(r["size"])
    for s, own in sizes.items():
        sums = {0}
        for n in own:
            sums |= {x + n for x in sums}
        budget = want[s] % size[s] if want[s] < 2 * size[s] else 0
        best = max(x for x in sums if x <= budget)
        assert taken[s] % size[s] <= budget and taken[s] % size[s] >= 0.999 * best


def test_edges(spark):
    schema = "doc_id long, text string, source string, target string, taken string"
    rows = [(None, "a b c", None, "x", "y"), (1, None, "s", "x", "y"), (1, None, "s", "x", "y"), (2, "", "s", None, None), (3, "w " * 200000, "é", "", "")]
    rows += [(9, "k l m n", "s", "", "")] * 7
    got = mix(with_size(spark.createDataFrame(rows, schema))).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert {r.target for r in got if r.source is None} == {6.0}
    assert mix(with_size(spark.createDataFrame([], schema))).count() == 0
