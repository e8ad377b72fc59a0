from collections import Counter

import corpus_pipeline
from glyphmill.llm.mixing import source_targets
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_linededup import brute as without_lines

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def test_stages_against_brute_force(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontam", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {"documents": [tuple(r) for r in docs.collect()]}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert name == "mixing" or docs.columns == columns
        seen[name] = [tuple(r) for r in docs.collect()]

    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r[0] for r in seen["quality"]}
    assert set(seen["quality"]) <= set(seen["documents"])
    assert sum(label.get(r[0]) == 1 for r in seen["quality"]) >= 0.97 * sum(q == 1 for q in label.values())
    assert sum(label.get(i) == 0 for i in kept) <= 0.2 * sum(q == 0 for q in label.values())

    assert sorted((r[0], r[1]) for r in seen["line_dedup"]) == sorted(without_lines([(r[0], r[1]) for r in seen["quality"]]))

    sets = {r[0]: shingles(r[1]) for r in seen["line_dedup"]}
    left = {r[0] for r in seen["near_dedup"]}
    assert set(seen["near_dedup"]) <= set(seen["line_dedup"])
    for a in left:
        assert all(similarity(sets[a], sets[b]) < 0.9 for b in left if b < a)
    for a in set(sets) - left:
        assert max(similarity(sets[a], sets[b]) for b in sets if b != a) > 0.65

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {d for d, _ in leaks([(r[0], r[1]) for r in seen["near_dedup"]], items)}
    assert sorted(seen["decontam"]) == sorted(r for r in seen["near_dedup"] if r[0] not in found)

    size, taken = Counter(), Counter()
    for r in seen["decontam"]:
        size[r[3]] += len((r[1] or "").split())
    for r in docs.collect():
        taken[r.source] += r.taken
        assert r.copies > 0 and r.taken == r.copies * len(r.text.split()) <= 2 * len(r.text.split())
    target = source_targets(dict(size))
    assert all(taken[s] <= target[s] for s in size) and sum(taken.values()) > 0.9 * sum(target.values())


def test_stages_with_edges(spark, tmp_path):
    read = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "", "en", None, 0), (7, "same id", "en", "a", 7), (7, "same id", "en", "a", 7), (7, "other text", None, "b", 1)]
    docs = read.unionByName(spark.createDataFrame(odd, read.schema))
    for c in ("size", "copies", "target", "taken", "node", "key", "line", "n", "h1", "item", "score"):
        docs = docs.withColumn(c, docs.doc_id.cast("string"))
    for empty in (False, True):
        rows = docs.limit(0) if empty else docs
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, rows, SF).write.parquet(f"{tmp_path}/{empty}{i}")
            before, rows = rows, spark.read.parquet(f"{tmp_path}/{empty}{i}")
            assert name == "mixing" or rows.columns == docs.columns
            assert (rows.count() == 0) == empty and rows.count() <= before.count()


def test_run_returns_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "copies", "taken", "target"} <= set(rows.columns) and rows.count() > 50
