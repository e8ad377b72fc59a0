import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import batching as B
from glyphmill.operators import counts as C
from glyphmill.operators import encode as E
from glyphmill.operators import metrics as M
from glyphmill.operators import sampling as R
from glyphmill.operators import seeds as S
from glyphmill.operators import vectors as V
from glyphmill.operators import vocab as W
from glyphmill.operators import fitting
from glyphmill.operators.fitting import _merged, fit_scores, fit_unigram


def test_substring_prior(spark):
    counts = spark.createDataFrame([("aa", 3), ("aba", 1)], "pretoken string, n long")
    vocab = spark.createDataFrame([(0, "a", False), (1, "aa", False), (2, "b", False), (3, "<s>", True)], "id int, piece string, is_special boolean")
    got = {r.piece: round(r.logp, 6) for r in C.substring_prior(counts, vocab).collect()}
    assert got == {"a": -0.575364, "aa": -1.386294, "b": -2.079442, "<s>": 0.0}


@pytest.mark.parametrize(
    ("text", "stride", "want"),
    [
        ("ab cd", 2, {"Ġ": 4, "Ġab": 4, "Ġcd": 4, "Ġa": 3, "Ġc": 3, "ab": 2, "a": 1, "d": 1}),
        ("ab cd", 1, {"Ġab": 8, "Ġ": 6, "Ġa": 6, "Ġcd": 4, "Ġc": 3, "ab": 2, "cd": 2, "a": 1, "b": 1, "c": 1, "d": 1}),
        ("é", 1, {"ĠÃ©": 12, "ĠÃ": 8, "Ġ": 4, "©": 2}),
    ],
)
def test_seed_scores(spark, text, stride, want):
    texts = spark.createDataFrame([(0, text)], "batch_id int, text string")
    assert {r.piece: r.score for r in S.seed_scores(texts, 4, stride).collect()} == want


def test_merges_by_heap_and_repair_in_joins(spark):
    def rescan(text, ranks):
        parts = list(text)
        while True:
            found = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(5)
    for _ in range(200):
        pieces = ["".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(0, 12))]
        merges = W.repair_merges(pieces, [("a", "b"), ("b", "a"), ("a", "b")][: rng.randint(0, 3)])
        ranks = {m: i for i, m in enumerate(merges)}
        text = "".join(rng.choices("abcd", k=rng.randint(0, 30)))
        assert E.merge_encode(text, ranks) == rescan(text, ranks)
    assert E.merge_encode("a" * 100000, {("a", "a"): 0}) == ["aa"] * 50000
    pieces, merges = ["ab", "abc", "xyz", "xyw", "c", "abd"], [("a", "b"), ("b", "c"), ("a", "b"), ("ab", "d")]
    table = spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "rank long, left string, right string")
    got = W.repaired_merges(spark.createDataFrame([(p,) for p in pieces], "piece string"), table).orderBy("rank").collect()
    assert [(r.left, r.right) for r in got] == W.repair_merges(pieces, merges) and [r.rank for r in got] == list(range(len(got)))


def test_seed_scores_add_up_over_batches_of_rows(spark):
    """Runs that go on from one Arrow batch to the next, null batch ids, and pieces of one to 15 bytes."""
    words = ["abcdefgh", "abcdefghi", "abcdxyz", "abc", "ab", "a", "äbcdefgh", "\u4f60\u597d\u4e16\u754c", "abcdefghijklmnopqrstuvwxyz", "1234567890"]
    rows = [(b, " ".join(words[(i * 7 + j * j) % len(words)] for j in range(9))) for i, b in enumerate([0, 1, None, 1, 0, 2, None])]
    texts = spark.createDataFrame(rows, "batch_id int, text string")
    counted = S.first_pretokens(texts, ["batch_id"]).groupBy("batch_id", "p", "first").agg(F.count("*").alias("n"))
    want = S.cut_pieces(counted, ["batch_id"]).groupBy("batch_id", "piece").agg(F.sum(F.col("n") * F.octet_length("piece")).alias("score"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        found = [tuple(r) for r in S.seed_scores(texts).collect()]
    finally:
        spark.conf.set(key, before)
    assert len(found) == len(set(found)) and set(found) == {tuple(r) for r in want.collect()} and max(len(r[1]) for r in found) == 15


def test_seed_scores_shuffle_suffixes_not_their_pieces(spark):
    texts = spark.createDataFrame([(0, "one two three")], "batch_id int, text string")
    plan = S.seed_scores(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "mapInArrow" in plan or "MapInArrow" in plan
    for max_length in (2, 4, 5):
        found = {r.piece for r in S.seed_scores(texts, max_length).collect()}
        assert max(map(len, found)) == max_length - 1


def test_scores_are_made_once(spark):
    """What reads seed scores more than once reads a table, not the texts again."""
    texts = spark.createDataFrame([(0, "one two"), (1, "two three")], "batch_id int, text string")
    scores = S.seed_scores(texts)
    special = spark.createDataFrame([(0, "<s>")], "ref_id int, piece string")
    one = scores.groupBy("piece").agg(F.sum("score").alias("score"))
    for out in (S.window_scores(scores, 2), S.induce(one, 500), S.sampled_vocab(one, special, 500)):
        assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_seed_window(spark):
    scores = spark.createDataFrame([(0, "p", 1), (1, "q", 5), (2, "p", 2)], "batch_id int, piece string, score long")
    got = {(r.window_id, r.piece): r.score for r in S.window_scores(scores, 2).collect()}
    assert got == {(1, "p"): 1, (1, "q"): 5, (2, "q"): 5, (2, "p"): 2}


def test_induced_list_sizes(spark):
    scores = spark.createDataFrame([("ab", 9), ("abc", 5), ("a", 50), ("ĠĠx", 40)], "piece string, score long")
    for size, n in ((393, 2), (391, 1), (392, 1)):
        rows = S.induce(scores, size).orderBy("rank").collect()
        assert len(rows) == 391 + n and rows[391].piece == "ab"
    assert S.blank_inventory(spark).distinct().count() == 135


def test_special_placement(spark):
    pieces = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "rank int, piece string")
    place = lambda rows: [r.piece for r in W.place_specials(pieces, spark.createDataFrame(rows, "ref_id int, piece string")).orderBy("id").collect()]
    assert place([(0, "s0"), (2, "s2")]) == ["s0", "x", "s2", "y", "z"]
    assert place([(10, "s")]) == ["x", "y", "z", "s"]
    assert place([(1, "y"), (0, "s")]) == ["s", "y", "x", "z"]


def test_byte_vocab_and_merges(spark):
    vocab = spark.createDataFrame([(0, "<s>", 0.0, True), (1, "<0x41>", -1.0, False), (2, "▁a", -2.0, False)], "id int, piece string, score double, is_special boolean")
    got = {r.piece: r.id for r in W.to_byte_vocab(vocab).collect()}
    assert got["<s>"] == 0 and got["A"] == 1 and got["Ġa"] == 2 and len(got) == 3 + 255
    merges = W.repair_merges(["ab", "abc", "xyz"], [("a", "b"), ("a", "b")])
    assert merges == [("a", "b"), ("ab", "c"), ("x", "y"), ("xy", "z")]
    ranks = {m: i for i, m in enumerate(merges)}
    assert E.merge_encode("xyzabc", ranks) == ["xyz", "abc"] and E.merge_encode("", ranks) == []
    doc = {"type": "Sequence", "processors": [{"type": "RobertaProcessing", "sep": ["</s>", 1], "cls": ["<s>", 9]}, {"type": "TemplateProcessing", "special_tokens": {"x": {"id": "x", "ids": [4], "tokens": ["<s>"]}}}]}
    fixed = W.fix_template(doc, {"<s>": 0, "</s>": 2})["processors"]
    assert fixed[0]["sep"] == ["</s>", 2] and fixed[0]["cls"] == ["<s>", 0] and fixed[1]["special_tokens"]["x"]["ids"] == [0]
    assert W.same_vocab(vocab, vocab) and not W.same_vocab(vocab, vocab.where("id > 0"))
    assert W.same_specials({"bos_token": "a"}, {"bos_token": "a"}) and not W.same_specials({"bos_token": "a"}, {})


def test_packing(spark):
    rows = spark.createDataFrame([(i, "en", "x" * n) for i, n in enumerate([10, 10, 20])], "doc_id long, lang string, text string")
    got = {r.doc_id: (r.unit, r.unit_chars) for r in B.pack(rows, 16).collect()}
    order = [r.doc_id for r in rows.orderBy(*B.seeded_order()).collect()]
    lengths, unit, total, held, want = [10, 10, 20], 0, 0, [], {}
    for i in order:
        held, total = [*held, i], total + lengths[i] + 4
        if total >= 16:
            want |= {j: (unit, total - 4) for j in held}
            unit, total, held = unit + 1, 0, []
    assert got == want


def test_blocks_batches_and_quota(spark):
    ids = spark.createDataFrame([(i, i) for i in range(9)], "at int, id int")
    assert [r.ids for r in B.blocks(ids, 4, ["at"]).orderBy("block").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7]]
    assert B.blocks(ids.limit(3), 4, ["at"]).count() == 0
    rows = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(8)], "doc_id long, lang string")
    batches = B.fixed_batches(rows, 2)
    assert batches.count() == 6 and batches.select("lang", "batch").distinct().count() == 3
    q = B.split_quota(spark.createDataFrame([("x", 100)], "lang string, n_pages long"), 50, 0.01).first()
    assert (q.n, q.n_valid, q.n_train) == (51, 1, 50)


def test_shares(spark):
    sizes = spark.createDataFrame([("a", 90), ("b", 10)], "lang string, n_pages long")
    got = {r.lang: (round(r.raw_share, 6), round(r.share, 6)) for r in R.language_shares(sizes, 0.5).collect()}
    assert got == {"a": (0.948683, 0.75), "b": (0.316228, 0.25)}
    weights = spark.createDataFrame([("en", 14.0)] + [(f"c{i}", 1.0) for i in range(6)], "lang string, weight double")
    assert {round(r.share, 6) for r in R.language_shares(weights, 1.0, weight="weight").collect()} == {0.7, 0.05}


def test_coverage_and_batches(spark):
    items = spark.createDataFrame([(i, -float(i % 5)) for i in range(30)] + [(30, -100000.0)], "id int, logp double")
    rows = R.coverage_sample(items, 20, 2, 6, 1).collect()
    assert {r.sample for r in rows} == set(range(6)) and all(sum(x.sample == s for x in rows) == 20 for s in range(6))
    assert all(sum(r.id == i for r in rows) >= 2 for i in range(31)) and len({(r.sample, r.id) for r in rows}) == len(rows)
    with pytest.raises(ValueError, match="multiple"):
        R.coverage_sample(items, 20, 4, 6, 1)
    filled = R.equal_batches(items, 8, 1)
    assert filled.count() == 32 and filled.where("padding").count() == 1
    drawn = spark.range(4000).select(R.noise_std(F.col("id"), 0, 1, 1).alias("none"), R.noise_std(F.col("id"), 1, 0, 1).alias("one"), R.vocabulary_size(F.col("id"), 10, 100, 5, 20, 3).alias("size"), R.normal(F.col("id"), 3).alias("z"))
    got = drawn.agg(F.max("none"), F.min("one"), F.min("size"), F.max("size"), F.avg("z"), F.stddev("z")).first()
    assert got[:4] == (0.0, 1.0, 5, 20) and abs(got[4]) < 0.05 and abs(got[5] - 1) < 0.05
    assert sorted(drawn.collect()) == sorted(drawn.repartition(16).collect())


def test_coverage_without_room_keeps_the_first_of_each_deal(spark):
    items = spark.createDataFrame([(i, -float(i % 5)) for i in range(300)], "id int, logp double")
    with pytest.raises(ValueError, match="room"):
        R.coverage_sample(items, 20, 2, 6, 1)
    for batch, wide in ((20, True), (99, True), (101, False)):  # 100 ids are dealt to each sample
        rows = R.coverage_sample(items, batch, 2, 6, 1, strict=False).collect()
        assert all(sorted(r.pos for r in rows if r.sample == s) == list(range(batch)) for s in range(6))
        dealt = {}
        for p in range(2):
            order = sorted(range(300), key=lambda i: (hashlib.md5(f"{i}:{p}:1".encode()).hexdigest(), i))
            for r, i in enumerate(order):
                dealt.setdefault(p * 3 + r % 3, []).append(i)
        for s in range(6):
            found = [r.id for r in sorted(rows, key=lambda r: r.pos) if r.sample == s]
            assert found[:100] == sorted(dealt[s])[:batch] if wide else set(dealt[s]) < set(found)


def test_least_keys_hold_ties_and_gaps(spark):
    draw = random.Random(3)
    rows = [(i, [draw.choice([0.5, 0.1, draw.random()]), None if i % 3 else draw.random(), None]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, keys array<double>")
    for parts in (1, 7):
        found = R.least_keys(df.repartition(parts), 9).collect()
        assert len(found) <= 9 * 3 * parts
        for s in range(3):
            wanted = sorted((k[s], i) for i, k in rows if k[s] is not None)[:9]
            assert sorted((r["_key"], r.id) for r in found if r.sample == s)[:9] == wanted
    assert R.least_keys(df.where("false"), 9).count() == 0


def test_segmentation_matches_all_splits():
    scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -2.6, "aba": -3.6, "bb": -9.0}

    def every(text):
        if not text:
            return [[]]
        return [[text[:k], *rest] for k in range(1, len(text) + 1) if text[:k] in scores for rest in every(text[k:])]

    for text in ("a", "abab", "bbaba", "abba", ""):
        ranked = sorted(every(text), key=lambda s: (-sum(map(scores.get, s)), len(s), s))
        assert E.best_segmentation(text, scores, 3) in [s for s in ranked if math.isclose(sum(map(scores.get, s)), sum(map(scores.get, ranked[0])))]
        assert E.n_best_segmentations(text, scores, 3, 4) == ranked[:4]
        got = E.expected_counts(text, scores, 3)
        p = np.exp([sum(map(scores.get, s)) for s in ranked])
        for piece in scores:
            assert math.isclose(got.get(piece, 0.0), sum(w * s.count(piece) for w, s in zip(p, ranked, strict=True)) / p.sum(), abs_tol=1e-9)
    assert E.best_segmentation("azb", scores, 3) == ["a", "z", "b"] and E.longest_match("abac", {"ab", "aba"}, 3) == ["aba", "c"]


def test_unigram_fit_meets_known_optima():
    target, rivals = np.array([[1.0, 0, 0]]), np.array([[0, 1.0, 1.0]])
    start = np.array([-2.0, -0.5, -0.5])
    for norm, optimum in (("l1", 1.1e-3), ("linf", 1.1e-3 / 3), ("none", 0.0)):
        fit = fit_unigram(target, rivals, np.array([0]), np.array([2.0]), start, norm=norm)
        assert fit.scores[1] + fit.scores[2] - fit.scores[0] <= -0.1 + 1e-6
        assert math.isclose(fit.objective, optimum, rel_tol=1e-3, abs_tol=1e-9) and fit.bound <= optimum + 1e-12
    dear = fit_unigram(target, rivals, np.array([0]), np.array([2.0]), start, strength=10.0)
    assert np.array_equal(dear.scores, start) and math.isclose(dear.objective, 2.2)
    alone = fit_unigram(target, rivals[:0], np.array([], int), np.array([2.0]), start)
    assert np.array_equal(alone.scores, start) and alone.objective == 0.0
    with pytest.raises(ValueError, match="norm"):
        fit_unigram(target, rivals, np.array([0]), np.array([2.0]), start, norm="l2")


def test_unigram_fit_reaches_its_bound():
    random = np.random.default_rng(0)
    for norm in ("l1", "linf"):
        target, rivals = random.integers(0, 3, (30, 20)), random.integers(0, 3, (80, 20))
        owner, weight, start = random.integers(0, 30, 80), random.exponential(1, 30), -random.exponential(4, 20)
        fit = fit_unigram(target, rivals, owner, weight, start, strength=0.1, norm=norm)
        away = fit.scores - start
        loss = (weight[owner] * np.maximum(0.1 + (rivals - target[owner]) @ fit.scores, 0)).sum()
        assert math.isclose(fit.objective, loss + 0.1 * (np.abs(away).sum() if norm == "l1" else np.abs(away).max()), rel_tol=1e-9)
        assert 0 <= fit.objective - fit.bound <= 1e-4 * fit.objective
        for _ in range(200):
            other = fit.scores + random.normal(0, 0.1, 20)
            loss = (weight[owner] * np.maximum(0.1 + (rivals - target[owner]) @ other, 0)).sum()
            assert loss + 0.1 * (np.abs(other - start).sum() if norm == "l1" else np.abs(other - start).max()) >= fit.bound


@pytest.mark.parametrize(("norm", "dense"), [("l1", 2048), ("linf", 2048), ("l1", 0)])
def test_scores_fitted_in_passes_are_as_good(spark, monkeypatch, norm, dense):
    monkeypatch.setattr(fitting, "DENSE", dense)
    size = 8 if dense else 4
    random = np.random.default_rng(1)
    target, rivals = random.integers(0, 3, (20, size)), random.integers(0, 3, (40, size))
    rivals[0] = target[0]
    owner, weight, start = np.concatenate([[0], random.integers(0, 20, 39)]), random.exponential(1, 20), -random.exponential(4, size)
    plain = fit_unigram(target, rivals, owner, weight, start, strength=0.1, norm=norm)
    names = [f"p{i}" for i in range(size)]
    spell = lambda counts: [n for n, c in zip(names, counts, strict=True) for _ in range(c)]
    rows = [(spell(target[o]), spell(r), float(weight[o])) for r, o in zip(rivals, owner, strict=True)]
    encodings = spark.createDataFrame(rows, "wanted array<string>, pieces array<string>, weight double")
    diffs = fitting.differences(encodings, {n: i for i, n in enumerate(names)})
    fit = fit_scores(diffs, start, strength=0.1, norm=norm)
    assert fit.objective <= plain.objective * (1 + 1e-3) and plain.bound * (1 - 1e-9) <= fit.objective
    assert 0 <= fit.objective - fit.bound <= 1e-3 * fit.objective and fit.bound <= plain.objective + 1e-9


def test_rounds_of_a_fit_are_not_carried_along(spark, monkeypatch):
    monkeypatch.setattr(fitting, "CUT", 4, raising=False)
    deep, merged = [], fitting._merged
    monkeypatch.setattr(fitting, "_merged", lambda each, add: (merged(each, add), deep.append(each.toDebugString().count(b"PythonRDD")))[0])
    random = np.random.default_rng(1)
    rows = [([0, 1, 2], random.integers(1, 3, 3).tolist(), float(np.exp(4 * random.normal()))) for _ in range(20)]
    rows += [([0, 2], [-1, 1], 1.0), ([1], [-1], 3.0)]
    fit = fit_scores(spark.createDataFrame(rows, "idx array<int>, val array<int>, weight double"), np.array([-1.0, -2.0, -4.0]), within=0, rounds=14)
    assert len(deep) > 20 and max(deep) < 12 and 0 <= fit.objective - fit.bound


def test_packing_in_ranges_equals_packing_in_order(spark, monkeypatch):
    monkeypatch.setattr(B, "RANGE", 5)
    monkeypatch.setattr(B, "FAN", 3)
    rng = random.Random(8)
    rows = [(i, "x" * rng.choice([0, 1, 2, 3, 7, 30, 41]), rng.choice(["a", "a", "a", None, "b"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    order = {r.doc_id: r.o for r in df.select("doc_id", B.seeded_order()[0].alias("o")).collect()}
    want = []
    for lang in ("a", "b", None):
        unit, total, held = 0, 0, []
        for i, text, _ in sorted((r for r in rows if r[2] == lang and r[1]), key=lambda r: (order[r[0]], r[0])):
            held.append(i)
            total += len(text) + 4
            if total >= 40:
                want += [(lang, j, unit, total - 4) for j in held]
                unit, total, held = unit + 1, 0, []
    got = [(r.lang, r.doc_id, r.unit, r.unit_chars) for r in B.pack(df, 40).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > 200
    assert B.pack(df.limit(0), 40).count() == 0
    for _ in range(100):
        lengths = np.array([rng.randint(1, 30) for _ in range(rng.randint(0, 20))])
        after, filled = B.range_map(lengths, 17)
        for start in range(17):
            total, units = start, 0
            for n in lengths:
                total += n
                if total >= 17:
                    total, units = 0, units + 1
            assert (after[start], filled[start]) == (total, units)


def test_scores_without_rivals_stay(spark):
    none = spark.createDataFrame([], "idx array<int>, val array<int>, weight double")
    assert fit_scores(none, np.array([-1.0])).scores.tolist() == [-1.0]
    same = spark.createDataFrame([([], [], 2.0)], "idx array<int>, val array<int>, weight double")
    assert math.isclose(fit_scores(same, np.array([-1.0])).objective, 0.2)


def test_unigram_training(spark):
    counts = spark.createDataFrame([("abab", 10), ("ab", 5), ("ba", 1)], "pretoken string, n long")
    vocab = E.train_unigram(counts, {p: -2.0 for p in ("a", "b", "ab", "ba", "bab", "aba")}, 3, rounds=2)
    assert set(vocab) == {"a", "b", "ab"} and vocab["ab"] > vocab["b"]


def test_sums_reach_the_driver_as_one_value(spark):
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    for parts in (1, 3, 40):
        sc.setJobGroup(f"merged-{parts}", "")
        assert _merged(sc.parallelize(range(1, 21), parts).map(np.array), np.add) == 210  # some of 40 parts are empty
        last = [tracker.getStageInfo(max(tracker.getJobInfo(j).stageIds)) for j in tracker.getJobIdsForGroup(f"merged-{parts}")]
        assert [x.numTasks for x in last] == [1]
    sc.setJobGroup("", "")


def test_means_of_parts_are_made_of_whole_vectors(spark):
    rows = [(1, 2, [1.0, 5.0]), (1, 2, [2.0, None]), (1, 3, [6.0, 1.0]), (2, 1, [None, 4.0]), (2, 1, None), (3, 1, [1.5])]
    df = spark.createDataFrame(rows, "id int, part int, vec array<float>")
    means = lambda d: {r.id: r.vec for r in d.collect()}
    assert means(V._means_of_few(df)) == means(V.mean_vectors(df)) == {1: [3.0, 3.0], 2: [None, 4.0], 3: [1.5]}
    source = spark.createDataFrame([(1, [1.0, 1.0]), (9, [9.0, 9.0])], "id int, vec array<double>")
    out = V.lexical_transfer(spark.createDataFrame([(0, None)], "id int, source_id int"), source, spark.createDataFrame([(0, 1)], "id int, part int"), 9, "bfvt")
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_vectors(spark):
    params = lambda x: spark.createDataFrame([("p", [x])], "path string, data array<double>")
    assert V.delta_merge(params(1.0), params(3.0), params(2.0), 0.5).first().data == [1.5]
    with pytest.raises(ValueError, match="partner"):
        V.delta_merge(params(1.0), params(3.0), params(2.0).where("false"), 0.5)
    source = spark.createDataFrame([(1, [1.0, 1.0]), (9, [9.0, 9.0])], "id int, vec array<double>")
    target = spark.createDataFrame([(0, None)], "id int, source_id int")
    pieces = spark.createDataFrame([(0, 1), (0, None)], "id int, part int")
    assert [V.lexical_transfer(target, source, pieces, 9, m).first().vec for m in ("no", "fvt", "bfvt")] == [[9.0, 9.0], [9.0, 9.0], [1.0, 1.0]]
    table = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "id int, vec array<double>")
    back = spark.createDataFrame([(0, [10.0]), (1, [11.0])], "id int, vec array<double>")
    assert V.gather_with_fallback(spark.createDataFrame([(5,)], "id int"), table, back, 4).first().vec == [11.0]
    row = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>").select(V.softmax(F.col("v")).alias("s"), V.layer_norm(F.col("v")).alias("n"), V.gelu(F.col("v")).alias("g")).first()
    x = np.array([1.0, 2.0, 3.0])
    assert np.allclose(row.s, np.exp(x) / np.exp(x).sum()) and np.allclose(row.n, (x - 2) / np.sqrt(2 / 3 + 1e-5)) and abs(row.g[0] - 0.8412) < 1e-3


def test_metrics(spark):
    rows = spark.createDataFrame([(0, 1.0, 1, 1), (0, 2.0, 1, 2), (0, 3.0, 0, 1)], "seq_id int, loss double, mask int, n_bytes int")
    assert M.causal_loss(rows).first().loss == 1.5 and M.nats_per_byte(rows).first().nats_per_byte == 0.75
    assert M.spread(spark.createDataFrame([(1.0,), (3.0,)], "v double"), "v").first().std == 1.0
    words = spark.createDataFrame([(0, i, w, t) for i, (w, t) in enumerate([(None, "O"), (0, "B-PER"), (0, "B-PER"), (1, "O"), (None, "O")])], "seq_id int, pos int, word int, tag string")
    labels = lambda every: [r.label for r in M.first_subword_labels(words, every).orderBy("pos").collect()]
    assert labels(False) == ["-100", "B-PER", "-100", "O", "-100"] and labels(True) == ["-100", "B-PER", "I-PER", "O", "-100"]
    rival = spark.createDataFrame([("a", 2.0, -2.0, -2.5), ("b", 2.0, -2.0, -1.5), ("c", 2.0, -2.0, None)], "pretoken string, weight double, target double, rival double")
    assert {r.pretoken: round(r.loss, 9) for r in M.hinge_losses(rival).collect()} == {"a": 0.0, "b": 1.2, "c": 0.0}


def test_dense_remap_keeps_empty_sequences(spark):
    rows = spark.createDataFrame([(0, [9, -100, 4]), (1, []), (2, None), (3, [4])], "seq_id int, ids array<int>")
    assert {r.seq_id: r.ids for r in W.dense_remap(rows).collect()} == {0: [1, -100, 0], 1: [], 2: [], 3: [0]}


def test_encoded_surfaces(spark):
    vocab = spark.createDataFrame([(5, "<s>", True), (6, "abab", False), (7, "az", False)], "id int, piece string, is_special boolean")
    got = E.encoded_surfaces(vocab, {"a": -2.0, "b": -2.0, "ab": -1.0}, {"a": 1, "b": 2, "ab": 3}, 2, fill=-1)
    assert {r.id: (r.surface, r.truncated) for r in got.collect()} == {5: ([5, -1], False), 6: ([3, 3], False), 7: ([1, 0], False)}


def test_expected_counts_as_probabilities_and_as_logarithms(monkeypatch):
    rng = random.Random(4)
    scores = {c: -rng.uniform(3, 20) for c in "abcde"} | {"".join(rng.choices("abcde", k=rng.randint(2, 6))): -rng.uniform(4, 12) for _ in range(200)} | {"x": -45.0}
    texts = ["".join(rng.choices("abcdez" if i % 9 == 0 else "abcde", k=rng.randint(0, 40))) for i in range(300)] + ["x" * 30, "axb", ""]
    found = [E.expected_counts(t, scores, 6) for t in texts]
    assert E._plain_counts([(i, i + 1, "x", -45.0) for i in range(30)], 30) is None
    monkeypatch.setattr(E, "SHORT", -1)
    for got, want in zip(found, (E.expected_counts(t, scores, 6) for t in texts), strict=True):
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
