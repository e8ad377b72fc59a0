import binascii
import math
from collections import Counter

import numpy as np

from glyphmill.llm.lm_scoring import Filter, LmModel, _build_segments, _pack, _unpack, build_segment, expected, levels, op1_lm_scoring, score_documents

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, block string"


def plain(rows, mass=50.0):
    """Exact base scores, and the model's scores with counts that are quantised but never wrong."""
    def toks(t):
        return [*(t or "").encode().lower().split(), None]

    held = [i is not None and binascii.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    uni, bi, begins = Counter(), Counter(), 0
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            w = toks(t)
            begins += 1
            uni.update(w)
            bi.update(zip(["<s>", *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)
    q = lambda c: float(expected(levels(np.array([c])))[0]) if c else 0.0
    out = []
    for (i, t), h in zip(rows, held, strict=True):
        w = toks(t)
        base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = 0.0
        for u, x in zip(["<s>", *w], w, strict=False):
            c = begins if u == "<s>" else q(uni[u])
            score += math.log10((min(q(bi[u, x]), c) + mass * (q(uni[x]) + 0.5) / (n + 0.5 * (v + 1))) / (c + mass))
        out.append((i, h, len(w), sum(uni[x] > 0 for x in w), n, base, score))
    return out


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        counts = rng.integers(0, 400, len(keys))
        k, c = _unpack(_pack(keys, counts))
        assert (k == keys).all() and (c == counts).all()


def test_filter_never_forgets():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 64, 20000, dtype=np.uint64))
    counts = rng.integers(1, 300, len(keys))
    data = build_segment(keys, counts, 12, 4, 1 << 20)
    got = Filter(data, np.array([0, len(data)]), 4).level(keys)
    assert (got >= levels(counts)).all() and (got == levels(counts)).mean() > 0.97
    other = rng.integers(0, 1 << 64, 20000, dtype=np.uint64)
    assert (Filter(data, np.array([0, len(data)]), 4).level(other) > 0).mean() < 0.03


def test_filter_grows_with_its_ngrams(spark):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 64, 200000, dtype=np.uint64))
    counts = np.where(rng.random(len(keys)) < 0.5, rng.integers(1, 60, len(keys)), 0)
    row = (7, 1, 5, _pack(keys[:1000], counts[:1000]), _pack(keys, counts))
    counted = spark.createDataFrame([row], "seg int, block long, texts long, tokens binary, bigrams binary")
    (r,) = _build_segments(counted, LmModel(least_segments=1 << 16)).where("kind = 1").collect()
    level = np.frombuffer(r.both, np.uint8)
    assert (level[counts > 0] >= levels(counts[counts > 0])).all() and (level[counts == 0] > 0).mean() < 0.03


def test_full_filter_ends_at_the_largest_level():
    keys = np.arange(1, 50, dtype=np.uint64)
    assert (Filter(np.full(8, 255, np.uint8), np.array([0, 8]), 4, 9).level(keys) == 9).all()


def test_scores(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None, "a null id"), (1, None), (1, None), (7001, ""), (7002, " \t\n"), (7003, "new " * 50000), (7004, rows[0][1])]
    got = score_documents(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    worst = 0
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(plain(rows), key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
        worst = max(worst, abs(g[6] - w[6]) / w[2])
    assert worst < 0.1, worst


def test_held_out_likelihood_beats_unigrams_on_copies(spark):
    text = " ".join(f"w{i % 97}x{i % 13}" for i in range(400))
    rows = [(i, text + f" t{i}") for i in range(40)]
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert got and all(r.score > r.base_score for r in got)


def test_held_out_documents_are_likelier_than_by_unigrams(spark):
    got = op1_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").collect()
    tokens = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / tokens > sum(r.base_score for r in got) / tokens + 0.3
    assert all(math.isfinite(r.score) for r in got)


def test_empty(spark):
    assert score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    assert score_documents(spark.createDataFrame([(1, None, "", "")], SCHEMA)).count() == 1
