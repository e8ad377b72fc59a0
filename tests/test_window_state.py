import pytest
from pyspark.sql import functions as F

from glyphmill.operators.seeds import recent_scores, recent_texts, seed_scores
from glyphmill.sources.tables import stream_corpus
from glyphmill.streaming.window_state import WindowState, _newest

KEYS = ("lang", "pool")
COLUMNS = "lang string, pool int, batch_id long, text string"


@pytest.fixture(autouse=True)
def two_stores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def wanted(spark, rows):
    return shown(recent_scores(seed_scores(spark.createDataFrame(rows, COLUMNS), by=(*KEYS, "batch_id")), 2, KEYS))


def shown(df):
    return sorted(tuple(r) for r in df.select(*KEYS, "piece", "score").collect())


def test_state_resumes_and_forgets(spark, tmp_path):
    parts = [
        [("en", 0, 0, "ab cd"), ("de", 0, 0, "über uns"), ("en", 1, 0, "other pool")],
        [("en", 0, 1, "cd ef"), ("en", 0, 2, "ab ab")],
        [("en", 0, 2, "more of it"), ("en", 0, 0, "late"), ("de", 0, 5, "zwei")],  # a batch in two parts, and one below the window
    ]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        state = WindowState(spark, f"{tmp_path}/checkpoint", KEYS, 2, shares=3)  # a new object each time: all it knows is in the checkpoint
        state.run(stream_corpus(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema))
        assert shown(state.scores()) == wanted(spark, [r for p in parts[: i + 1] for r in p])
    held = {(r.lang, r.pool, r.batch_id) for r in state.batches().collect()}
    assert held == {("en", 0, 1), ("en", 0, 2), ("en", 1, 0), ("de", 0, 0), ("de", 0, 5)}
    more = [("en", 0, 3, "peeked"), ("fr", 0, 0, "neu")]
    assert shown(state.peek(spark.createDataFrame(more, COLUMNS))) == wanted(spark, [r for p in parts for r in p] + more)
    assert shown(state.scores()) == wanted(spark, [r for p in parts for r in p])


def test_null_texts_and_groups(spark, tmp_path):
    rows = [("en", 0, 0, "ab"), ("en", 0, 1, "cd"), ("en", 0, 2, None), (None, 0, 0, "no language"), (None, 0, 1, "")]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/in")
    state = WindowState(spark, f"{tmp_path}/checkpoint", KEYS, 2, shares=2)
    state.run(stream_corpus(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema))
    held = state.batches().select("lang", "batch_id").distinct().collect()
    assert {(r.lang, r.batch_id) for r in held} == {("en", 0), ("en", 1), (None, 0), (None, 1)}
    assert {r.piece for r in state.scores().where("lang = 'en'").collect()} >= {"Ġab", "Ġcd"}
    assert state.scores().where(F.col("lang").isNull()).count()


def test_only_texts_of_the_window_are_cut(spark):
    rows = [(lang, b % 2, b, f"{lang} {b}") for b in range(40) for lang in ("en", "de") if lang == "en" or b < 9] + [("en", 0, 50, None), ("fr", 0, 3, "")]
    texts = spark.createDataFrame(rows, COLUMNS)
    kept = recent_texts(texts, 2, KEYS)
    assert kept.count() == 9 and shown(recent_scores(seed_scores(kept, by=(*KEYS, "batch_id")), 2, KEYS)) == wanted(spark, rows)


def test_a_task_passes_on_its_newest_batches(spark):
    rows = [("en", i % 2, (i * 7) % 100, f"text {i}") for i in range(300)] + [(None, 0, 4, "none")]
    texts = spark.createDataFrame(rows, COLUMNS)
    least = sorted({r[2] for r in rows if r[:2] == ("en", 0)})[-2], sorted({r[2] for r in rows if r[:2] == ("en", 1)})[-2]
    inside = sorted((r for r in rows if r[0] is None or r[2] >= least[r[1]]), key=str)
    assert sorted(map(tuple, _newest(texts.coalesce(1), KEYS, 2).collect()), key=str) == inside
    for parts, most in ((5, 1 << 26), (1, 0)):
        found = _newest(texts.repartition(parts), KEYS, 2, most).select("lang", "pool", "batch_id", "text").collect()
        assert set(inside) <= set(map(tuple, found)) <= set(rows) and len(found) == len(set(found))
