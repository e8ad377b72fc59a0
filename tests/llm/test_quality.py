import math
import re
from collections import Counter

import numpy as np

from glyphmill.llm.arrowtext import Hasher
from glyphmill.llm.gbdt import fit
from glyphmill.llm.quality import _CLASSES, FEATURES, classify, learn, op7_quality, statistics

SF = "/root/testdata/sf0.01"


def test_trees_learn_a_rule_and_flat_traversal_agrees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = fit(x, y)
    p = forest.predict(x)
    assert ((p >= 0.5) == (y == 1)).mean() > 0.97

    def walk(row):
        m = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            i = 0
            for _ in range(forest.depth):
                i = 2 * i + 1 if row[f[i]] <= t[i] else 2 * i + 2
            m += v[i - 2**forest.depth + 1]
        return 1 / (1 + np.exp(-m))

    assert np.allclose([walk(r) for r in x[:50]], p[:50])
    assert np.allclose(fit(np.zeros((0, 5)), np.zeros(0)).predict(x[:2]), 0.5)


def test_statistics_of_known_texts():
    texts = [b"", b"One one two!\n#a ##", b"  "]
    offs = np.cumsum([0, *map(len, texts)])
    x = statistics(np.frombuffer(b"".join(texts), np.uint8), offs, Hasher())
    f = {k: x[1, i] for i, k in enumerate(FEATURES)}
    assert x.shape == (3, len(FEATURES)) and not x[0].any()
    assert f["type_share"] == 4 / 5 and f["twin_share"] == 1 / 5 and f["bare_word_share"] == 1 / 5 and f["symbol_end_share"] == 2 / 5
    assert f["upper_share"] == 1 / 18 and f["words_per_line"] == 2.5 and f["top_word_share"] == 2 / 5


def plain(text):
    """The statistics of one text, word by word."""
    w = re.findall(rb"[^\x20\x09-\x0d]+", text)
    low, n = [x.lower() for x in w], max(len(w), 1)
    sizes = [len(x) for x in w]
    mean = sum(sizes) / n
    words, pairs = Counter(low), Counter(zip(low, low[1:], strict=False))
    wordy = set(_CLASSES["lower"] + _CLASSES["upper"] + _CLASSES["digit"] + _CLASSES["high"])
    shares = [sum(b in members for b in text) / max(len(text), 1) for members in _CLASSES.values()]
    return [
        *shares, math.log1p(len(text)), math.log1p(len(w)), mean, math.sqrt(max(sum(s * s for s in sizes) / n - mean**2, 0)), math.log1p(max(sizes, default=0)),
        len(words) / n, max(words.values(), default=0) / n, sum(a == b for a, b in zip(low, low[1:], strict=False)) / n,
        sum(c for c in pairs.values() if c > 1) / n, sum(not wordy & set(x) for x in w) / n, sum(x[-1] in _CLASSES["symbol"] + _CLASSES["loud"] for x in w) / n,
        len(w) / (text.count(b"\n") + 1),
    ]


def test_statistics_of_all_texts(spark):
    texts = [(r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [b"", b" ", b"\n\n", "é É ç\u00a0x".encode(), b"a a a A!", b"# ## #", b"x"]
    offs = np.cumsum([0, *map(len, texts)])
    got = statistics(np.frombuffer(b"".join(texts), np.uint8), offs, Hasher())
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-6)


def test_held_out_accuracy(spark):
    got = op7_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50
    assert np.mean([r.predicted == r.quality for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    schema = "doc_id long, text string, score string, predicted string, quality string"
    rows = [(None, "x y", "a", "b", "c"), (1, None, "a", "b", "c"), (1, None, "a", "b", "c"), (2, "", "a", "b", "c"), (3, "é " * 100000, "a", "b", "c")]
    df = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0), (3, 1)], "doc_id long, quality long")
    got = classify(df, learn(df, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], schema)
    assert classify(none, learn(none, labels)).count() == 0
    assert classify(df, learn(df, labels.limit(0))).count() == 5
