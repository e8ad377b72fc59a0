import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from glyphmill.llm.langid import LangModel, Predictor, grams, identify, learn, op8_langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op8_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_matches_a_plain_version(spark):
    docs = [(i * 5 + 3, t, k) for i, (t, k) in enumerate([("the cat sat", "en"), ("the dog", "en"), ("der hund und die katze", "de"), ("das haus", "de")])]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    from zlib import crc32

    used = [d for d in docs if crc32(str(d[0]).encode()) % 5]
    model = learn(df)
    words, parts = defaultdict(Counter), defaultdict(Counter)
    for _, t, k in used:
        for w in re.findall("[a-z]+", t):
            words[k][w] += 1
            for n in range(1, 5):
                parts[k].update(f"{n}{g}" for g in grams(w, n))
    langs = sorted(words)
    assert model.langs == langs
    sums = {(k, n): sum(c for g, c in parts[k].items() if g[0] == n) for k in langs for n in "1234"}
    tests = ["the katze", "catter", "zzz", "hundehaus the"]
    names, _ = Predictor(model)(pa.array(tests))
    for text, name in zip(tests, names, strict=True):
        total = {k: math.log(sum(d[2] == k for d in used) / len(used)) for k in langs}
        for w in text.split():
            if any(w in words[k] for k in langs):
                for k in langs:
                    total[k] += math.log((words[k][w] or 0.5) / (sum(words[k].values()) + 1))
                continue
            for n in (4, 3, 2, 1):
                known = [f"{n}{g}" for g in grams(w, n) if any(f"{n}{g}" in parts[k] for k in langs)]
                if known:
                    for k in langs:
                        total[k] += np.mean([math.log((parts[k][g] or 0.5) / (sums[k, str(n)] + 1)) for g in known])
                    break
        assert name == max(langs, key=total.get)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string, lang_pred string"
    rows = [(None, "abc", "en", "", ""), (1, None, "en", "", ""), (2, "", None, "", ""), (2, "", None, "", ""), (3, "123 !?", "en", "", ""), (6, "hello " * 90000, "en", "", "")]
    df = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, r.text and r.text[:5]): r.lang_pred for r in identify(df, learn(df)).collect()}
    assert got[1, None] == got[3, "123 !"] == got[2, ""] == "und" and got[6, "hello"] == "en"
    assert identify(df, learn(df)).count() == 6
    none = spark.createDataFrame([], schema)
    assert identify(none, learn(none)).count() == 0
    assert {r.lang_pred for r in identify(df, learn(none)).collect()} == {"und"}
    empty = LangModel([], np.zeros(0), np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), {}, np.zeros((0, 0), np.float32))
    assert Predictor(empty)(pa.array(["a"]))[0] == ["und"]
