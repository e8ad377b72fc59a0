import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.operators.seeds import seed_scores
from glyphmill.sources import tables as S
from glyphmill.streaming.seed_stream import SeedWindow, event_flush


def test_corpus_round_trip_prunes_languages(spark, tmp_path):
    docs = spark.createDataFrame([("a", "en"), ("b", "de"), ("c", "en")], "text string, lang string")
    S.write_corpus(docs, f"{tmp_path}/c")
    got = S.read_corpus(spark, f"{tmp_path}/c", ["flan"])
    assert sorted(r.text for r in got.collect()) == ["a", "c"]
    assert "PartitionFilters: [" in got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert [r.text for r in S.read_head(S.read_corpus(spark, f"{tmp_path}/c"), 2, "text").collect()] == ["a", "b"]


def test_registry_and_lists(spark, tmp_path):
    (tmp_path / "r.csv").write_text("lang_code,n_pages\nen,5\n-,7\nzh,9")
    (tmp_path / "l.txt").write_text("en,14\npython,1\n")
    assert [tuple(r) for r in S.read_registry(spark, f"{tmp_path}/r.csv").collect()] == [("en", 5), ("zh", 9)]
    assert S.read_registry(spark, f"{tmp_path}/r.csv", ["zh"]).count() == 1
    assert [tuple(r) for r in S.read_languages(spark, f"{tmp_path}/l.txt").collect()] == [("en", 14.0), ("python", 1.0)]
    schema = T.StructType([T.StructField("x", T.IntegerType())])
    (tmp_path / "a.json").write_text('{"x": 1}\n')
    assert S.read_splits(spark, {"train": f"{tmp_path}/a.json"}, schema)["train"].first().x == 1
    with pytest.raises(ValueError, match="csv"):
        S.read_splits(spark, {"train": "a.json", "test": "b.csv"}, schema)


def test_lines_and_parameters(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1.23456)], "index int, prediction double")
    assert S.prediction_lines(rows, regression=True).first().value == "0\t1.235" and S.prediction_lines(rows).first().value == "0\t1.23456"
    assert S.tag_lines(spark.createDataFrame([(["O", "B-X"],)], "tags array<string>")).first().value == "O B-X"
    for name, value in (("a", 1.0), ("b", 2.0)):
        spark.createDataFrame([("p", [value])], "path string, data array<double>").write.parquet(f"{tmp_path}/{name}")
    assert S.read_parameters(spark, [f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/a"]).first().data == [2.0]
    S.write_text(spark.createDataFrame([("x",)], "text string"), f"{tmp_path}/t")
    S.write_text(spark.createDataFrame([("y",)], "text string"), f"{tmp_path}/t")
    assert [r.value for r in spark.read.text(f"{tmp_path}/t").collect()] == ["x"]


def test_seed_stream_equals_the_batch_form(spark, tmp_path):
    batches = [["ab cd ab"], ["cd ef"], ["ab gh"]]
    schema = T.StructType([T.StructField("text", T.StringType())])
    window = SeedWindow(spark, f"{tmp_path}/state", 2)
    for i, texts in enumerate(batches):
        spark.createDataFrame([(t,) for t in texts], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        window.run(S.stream_corpus(spark, f"{tmp_path}/in", schema), f"{tmp_path}/checkpoint")
        if i:
            want = seed_scores(spark.createDataFrame([(0, t) for b in batches[i - 1 : i + 1] for t in b], "batch_id int, text string"))
            assert {r.piece: r.score for r in window.scores(i).collect()} == {r.piece: r.score for r in want.collect()}
    peeked = {r.piece for r in window.peek(spark.createDataFrame([("zz",)], schema), 2).collect()}
    assert "Ġzz" in peeked and "Ġef" not in peeked and "Ġzz" not in {r.piece for r in window.scores(2).collect()}
    window.push(spark.createDataFrame([("ab gh",)], schema), 2)
    assert {r.piece: r.score for r in window.scores(2).collect()} == {r.piece: r.score for r in want.collect()}


def test_event_stream_equals_the_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    query = event_flush(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("flushed").trigger(availableNow=True).start()
    query.awaitTermination()
    shown = lambda df: sorted(tuple(r) for r in df.select(F.date_format("start", "yyyy-MM-dd"), "event_type", "n", F.round("value", 4)).collect())
    assert shown(spark.table("flushed")) == shown(event_flush(events, "1 day"))


def test_saved_folders_and_registry_lookup(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    S.write_saved(rows, f"{tmp_path}/plain")
    S.write_saved(rows.where("id = 1"), f"{tmp_path}/dict", "train")
    assert S.read_saved(spark, f"{tmp_path}/plain").count() == 2 and S.read_saved(spark, f"{tmp_path}/dict").first().text == "a"
    data = pa.table({"other": [0, 0], "text": pa.array(["x", None], pa.large_string())})
    (tmp_path / "arrow/train").mkdir(parents=True)
    for name, make in (("1.arrow", pa.ipc.new_stream), ("2.arrow", pa.ipc.new_file)):
        with make(f"{tmp_path}/arrow/train/{name}", data.schema) as out:
            out.write_table(data)
    schema = T.StructType([T.StructField("text", T.StringType())])
    assert sorted(str(r.text) for r in S.read_saved(spark, f"{tmp_path}/arrow", schema).collect()) == ["None", "None", "x", "x"]
    registry = spark.createDataFrame([("en", 5)], "lang_code string, n_pages long")
    langs = spark.createDataFrame([("en",), ("de",)], "lang string")
    assert S.lookup_pages(langs.where("lang = 'en'"), registry).first().n_pages == 5
    with pytest.raises(Exception, match="no registry entry for de"):
        S.lookup_pages(langs, registry).collect()


def test_windows_of_groups_reach_back(spark, tmp_path):
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
    window = SeedWindow(spark, f"{tmp_path}/state", 2, keys=("lang",))
    for i, rows in enumerate(([("aa", "de"), ("xx", "en")], [("bb", "de")], [("cc", "de")])):
        window.push(spark.createDataFrame(rows, schema), i)
    pieces = {(r.lang, r.piece) for r in window.scores(2).collect()}
    assert {("en", "Ġxx"), ("de", "Ġbb"), ("de", "Ġcc")} <= pieces and ("de", "Ġaa") not in pieces
    peeked = {(r.lang, r.piece) for r in window.peek(spark.createDataFrame([("dd", "de")], schema), 2).collect()}
    assert {("en", "Ġxx"), ("de", "Ġcc"), ("de", "Ġdd")} <= peeked and ("de", "Ġbb") not in peeked


def test_a_batch_is_one_file(spark, tmp_path):
    rows = spark.range(1000).repartition(7)
    S.write_batches(rows, f"{tmp_path}/b", 64)
    S.write_batches(rows.where("id < 64"), f"{tmp_path}/b", 64)
    assert sorted(len(list(p.glob("*.parquet"))) for p in (tmp_path / "b").glob("batch=*")) == [1] * 16
    assert spark.read.parquet(f"{tmp_path}/b").where("batch = id div 64").count() == 1000
