import math
import random
import re

import numpy as np

from glyphmill.llm import lexical


def plain(docs, items, k):
    """Rows (item number, rank, doc_id, score) by the definition; docs: (id, text)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(lexical.TERM, (t or "").translate(low)) for _, t in docs]
    n, total = sum(1 for w in words if w), sum(map(len, words))
    out = []
    for number, (_, text) in enumerate(items):
        terms = set(re.findall(lexical.TERM, (text or "").translate(low)))
        scores = []
        for (doc, _), w in zip(docs, words, strict=True):
            score = 0
            for t in terms & set(w):
                df = sum(1 for x in words if t in x)
                m = 50 + 50 * len(w) * n // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 20 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc))
        out += [(items[number][0], r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 40, 5])
    raw, at = lexical.pack_ints(values)
    assert lexical.unpack_ints(raw.tobytes()).tolist() == values.tolist()
    assert [lexical.unpack_ints(raw[a:b].tobytes()).tolist() for a, b in zip(at, at[1:], strict=False)] == [[v] for v in values.tolist()]
    assert lexical.unpack_ints(b"").tolist() == []


def test_heaps_give_the_best_of_all():
    rng = random.Random(3)
    for _ in range(300):
        n, k = rng.randint(1, 60), rng.randint(1, 8)
        lists = []
        for _ in range(rng.randint(0, 7)):
            docs = sorted(rng.sample(range(n), rng.randint(1, n)))
            adds = [rng.randint(0, 4) for _ in docs]
            lists.append((docs, adds, max(adds)))
        scores = {}
        for docs, adds, _ in lists:
            for d, a in zip(docs, adds, strict=True):
                scores[d] = scores.get(d, 0) + a
        want = sorted(((s, d) for d, s in scores.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
        assert lexical.best_documents(lists, k) == want


def test_search_equals_a_plain_ranking(spark, monkeypatch):
    rng = random.Random(1)
    vocabulary = ["Ab", "ab", "é1", "x", "yy", "zz9", "ärm", "Q", "rare"]
    docs = [(i if i % 9 else None, " ".join(rng.choices(vocabulary, weights=[9, 9, 5, 5, 3, 3, 2, 2, 1], k=rng.choice([0, 3, 3, 30])))) for i in range(150)]
    docs += [(7, "x yy"), (7, "x yy"), (500, None), (501, "--- !"), (502, "x, " * 40000)]
    items = [(1, "Rare x-yy"), (1, "Rare x-yy"), (2, "unknown"), (3, None), (4, "é1 ab AB zz9 q ärm")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "k").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "ITEM_BLOCK", 2)
    index = lexical.materialise(lexical.build_index(df, "k"), "postings")
    found = sorted((tuple(r) for r in lexical.search(index, asked, k=12).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert found == plain(docs, items, 12)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    empty = lexical.materialise(lexical.build_index(none), "postings")
    assert lexical.search(empty, items).count() == 0
    index = lexical.materialise(lexical.build_index(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")), "postings")
    assert lexical.search(index, items.limit(0)).count() == 0
    assert [(r.rank, r.doc_id) for r in lexical.search(index, items).collect()] == [(1, 1)]
