import random
import re

import numpy as np

from glyphmill.llm import licenses

SF = "/root/testdata/sf0.001"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_base(text):
    w, places = words(text), []
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    places.sort()
    ends = (places[0][0], places[-1][0]) if places else (None, None)
    return (len(w), len(places), *ends, ",".join(sorted({x for _, x in places})))


def plain_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1], best[-1].index(best[-1][-1])


def test_base_over_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = licenses.op13_licenses(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(docs[r.doc_id])
        named = set(r.labels.split(",")) - {""}
        assert set(r.base_labels.split(",")) - {""} <= named and 0 <= r.score <= 1
        gnu = "general public license, version 3" in docs[r.doc_id].lower()
        assert named == set(r.base_labels.split(",")) - {""} | ({"gpl-3"} if gnu else set())
        assert (r.score > 0) == bool(named)


def changed(rng, text, share):
    """A text with some of its words replaced, left out, or followed by another."""
    out = []
    for w in text.split():
        if rng.random() < share:
            out += rng.choice([["zonk"], [], [w, "zonk"]])
        else:
            out.append(w)
    return " ".join(out)


def test_changed_templates_are_found_and_prose_is_not(spark):
    rng = random.Random(2)
    prose = [w for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").collect() for w in r.text.split()]
    docs, want = [], {}
    longer = [(label, text) for label, _, text in licenses.TEMPLATES if len(text.split()) > 12]
    for i in range(60):
        label, text = longer[i % len(longer)]
        before, after = (" ".join(rng.sample(prose, 40)) for _ in range(2))
        docs.append((i, f"{before} {changed(rng, text, 0.06)}\n{after}", 1))
        want[i] = label
    docs += [(1000 + i, " ".join(rng.sample(prose, 200)), 1) for i in range(60)]
    df = spark.createDataFrame(docs, "id long, body string, spans int").repartition(4)
    rows = {r.doc_id: r.spans for r in licenses.scan_licenses(df, id_col="id", text_col="body").collect()}
    assert all(not rows[i] for i in rows if i >= 1000)
    right = [i for i in want if [s.label for s in rows[i]] == [want[i]] and abs(rows[i][0].first - 40) <= 8]
    assert len(right) >= 0.9 * len(want)


def test_similar_licenses_are_told_apart(spark):
    texts = {
        "Licensed under the GNU Lesser General Public License, version 3.": ["lgpl-3"],
        "licensed under the gnu general public license version 2": ["gpl-2"],
        "Released under the NEW License.": [],
        "released under the mit license " * 30: ["mit"],
        "Under CC BY-NC 4.0 and the Apache License, Version 2.0": ["apache-2", "cc-by-nc"],
        "cc by": [],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(df).collect():
        assert sorted({s.label for s in r.spans}) == list(texts.values())[r.doc_id]
        if r.doc_id == 3:
            assert r.n_base == 30 and len(r.spans) >= 30


def test_common_words_by_rows():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert licenses.common_words(np.array(a, int), np.array(b, int)) == plain_common(a, b)


def test_edges(spark):
    schema = "doc_id long, text string, base string, template int"
    assert licenses.scan_licenses(spark.createDataFrame([], schema)).count() == 0
    long = "pad " * 60000 + "licensed under the apache license version 2 0 " + "pad " * 10
    rows = [(None, long, "x", 1), (1, None, None, None), (2, "", "x", 1), (3, " .. ", "x", 1), (4, "under the mit license", "x", 1), (4, "under the mit license", "x", 1)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6
    found = {r.doc_id: (r.n_words, r.n_base, r.first_word, sorted({s.label for s in r.spans})) for r in got}
    assert found[None] == (60018, 1, 60003, ["apache-2"])
    assert found[1] == found[2] == found[3] == (0, 0, None, [])
    assert found[4] == (4, 1, 0, ["mit"])
