import math
import re
from collections import Counter

import xxhash

from glyphmill.llm.quality_rules import BUCKETS, LEAST_RATIO, judge, op10_quality_rules, ratios

SF = "/root/testdata/sf0.001"
W = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = W.findall(text or "")
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def check(rows, got):
    want = sorted(((i is None, i or 0), *base(t)) for i, t in rows)
    assert want == sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_query(spark):
    got = op10_quality_rules(spark, SF).collect()
    check([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], got)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.kept for r in got if label.get(r.doc_id) == 1 and not r.base_failed)
    assert not any(r.kept for r in got if label.get(r.doc_id) == 0)


def buckets(text):
    """Buckets of all one- and two-word n-grams: chained XXH64 with seed 42."""
    h = lambda w, seed: xxhash.xxh64_intdigest(w.encode(), seed=seed)
    w = W.findall(text or "")
    ones = [h(x, 42) for x in w]
    return [x % BUCKETS for x in ones] + [h(b, a) % BUCKETS for a, b in zip(ones, w[1:], strict=False)]


def test_ratio_of_every_document(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}
    grams = {i: buckets(t) for i, t in docs.items()}
    raw = Counter(b for x in grams.values() for b in x)
    trusted = Counter(b for i in good if i in grams for b in grams[i])
    n_raw, n_trusted = raw.total(), trusted.total()
    assert 0 < n_trusted < n_raw

    def one(b):
        p = raw[b] / n_raw
        return math.log((trusted[b] + BUCKETS * p) / (n_trusted + BUCKETS)) - math.log(p)

    got = op10_quality_rules(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = sum(map(one, grams[r.doc_id])) / max(len(grams[r.doc_id]), 1)
        assert math.isclose(r.ratio, want, abs_tol=1e-8)
        assert abs(want - LEAST_RATIO) > 1e-8 and r.kept == (not r.base_failed and want >= LEAST_RATIO)


def test_edges(spark):
    rows = [(None, "a b c a b c"), (1, None), (1, None), (2, ""), (3, " \n\t\n"), (4, "x\nx\n x\nx y z x y z x y z"), (5, "é# " * 60000), (6, "a b"), (7, "a a a a"), (8, "q w e r q w e t q w")]
    df = spark.createDataFrame([(*r, "c", 5) for r in rows], "doc_id long, text string, n_words string, bucket int")
    labels = spark.createDataFrame([(1, 1), (None, 1), (5, 1), (2, None)], "doc_id long, quality long")
    check(rows, judge(df, ratios(df, labels)).collect())
    flat = judge(df, ratios(df, labels.limit(0))).collect()
    assert {r.ratio for r in flat} == {0.0}
    assert judge(df.limit(0), ratios(df.limit(0), labels)).count() == 0


def test_every_labelled_document_is_trusted(spark):
    docs = spark.range(12_000).selectExpr("id AS doc_id", "concat('word', id % 700, ' own', id) AS text")
    labels = docs.selectExpr("cast(doc_id AS int) AS doc_id", "1 AS quality")
    assert {r.r for r in ratios(docs, labels).select("r").distinct().collect()} == {0}  # trusted and raw counts are the same


def test_a_text_is_hashed_once_not_for_each_word(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality long")
    plan = judge(df, ratios(df, labels))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate posexplode", 1)
    assert "xxhash64(text" not in above and "xxhash64(text" in below
