"""Further operator queries: sinks, parameters, seeded masks and pools, sequence counts, list operations, fitted vocabularies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.functions import text as T
from glyphmill.operators import batching as B
from glyphmill.operators import counts as C
from glyphmill.operators import metrics as M
from glyphmill.operators import sampling as R
from glyphmill.operators import vectors as V
from glyphmill.operators import vocab as W
from glyphmill.plans.text_queries import mapped_sql, pretokens_sql
from glyphmill.sources import tables as S


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def prediction_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_id").alias("index"), F.round("value", 2).alias("prediction"))
    return S.prediction_lines(rows, regression=True).withColumnRenamed("value", "line")


def tag_lines(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.transform(F.split("text", " "), lambda w: F.when(F.length(w) > 5, "B-X").otherwise("O"))
    rows = table(spark, sf, "benchmark").select("item_id", tags.alias("tags"))
    return rows.select("item_id", F.array_join("tags", " ").alias("line"))


def argmax_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", M.argmax(F.col("embedding")).cast("long").alias("dim"))


def _parameters(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    path = F.array(F.when(F.col("label") < 5, "encoder").otherwise("head"), F.concat(F.lit("layers_"), F.col("label").cast("string")), F.concat(F.lit("w"), F.col("vec_id").cast("string")))
    return e.select(path.alias("path"), F.array((F.col("label") + 1).cast("long"), F.lit(64).cast("long")).alias("shape"))


def parameter_paths(spark: SparkSession, sf: str) -> DataFrame:
    kept = V.drop_parameters(_parameters(spark, sf), ["head"])
    return kept.select(F.array_join(V.rename_layers(F.col("path")), "/").alias("path"))


def parameter_count(spark: SparkSession, sf: str) -> DataFrame:
    return V.parameter_count(_parameters(spark, sf)).select(F.col("n").cast("long").alias("n"))


def masked_tokens(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    rows = table(spark, sf, "benchmark").select("item_id", F.posexplode(R.mask_tokens(ids, F.col("item_id"), 99, 5)).alias("pos", "x"))
    return rows.select("item_id", F.col("pos").cast("long").alias("pos"), F.col("x.input").cast("long").alias("input"), F.col("x.label").cast("long").alias("label"))


def pool_choice(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", R.pool(F.col("doc_id"), 4, 5).cast("long").alias("pool"))


def sequence_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The four most frequent ids of each sequence."""
    each = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("w")).select("conv_id", "turn", F.length("w").alias("id"))
    n = each.groupBy("conv_id", "turn", "id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc("n"), "id"))
    return n.withColumn("rank", rank.cast("long")).where("rank <= 4").select("conv_id", "turn", "rank", F.col("id").cast("long").alias("id"), "n")


def mean_one_weights(spark: SparkSession, sf: str) -> DataFrame:
    top = C.top_k(C.pretoken_counts(table(spark, sf, "documents")), 1000)
    mean = top.agg(F.avg("n").alias("_m"))
    return top.crossJoin(F.broadcast(mean)).select("pretoken", F.round(F.col("n") / F.col("_m"), 6).alias("weight"))


def concat_lists(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("rank"), F.col("n_name").alias("piece"))
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("rank"), F.col("r_name").alias("piece"))
    return W.ordered_concat([regions, nations]).select(F.col("rank").cast("long").alias("rank"), "piece")


def gather_pieces(spark: SparkSession, sf: str) -> DataFrame:
    vocab = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("piece"))
    stored = table(spark, sf, "labels").select(F.col("doc_id").alias("pos"), F.pmod("doc_id", F.lit(30)).cast("int").alias("id"))
    return W.gather_pieces(vocab, stored)


def scored_vocab(spark: SparkSession, sf: str) -> DataFrame:
    vocab = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("piece"))
    scores = spark.createDataFrame([("BUILDING", -1.5), ("MACHINERY", -2.5)], "piece string, score double")
    return W.with_scores(vocab, scores).select("id", "piece", "score")


def remapped_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    rows = table(spark, sf, "benchmark").select("item_id", W.remap(ids, {1: -100, 2: 20, 3: 30}).alias("ids"))
    return rows.select("item_id", F.array_join("ids", ",").alias("ids"))


def softmax_kl(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    v = v.withColumn("p", V.softmax(F.col("v")))
    uniform = F.transform("p", lambda x: F.lit(math.log(1 / 64)))
    logs = F.transform("p", lambda x: F.log(x))
    return v.select("vec_id", F.round(F.element_at("p", 1), 6).alias("first"), F.round(V.kl_with_log_targets(uniform, logs), 6).alias("kl"))


def byte_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Running byte offsets of the characters of each distinct pre-token."""
    counts = C.pretoken_counts(table(spark, sf, "documents")).select("pretoken")
    each = counts.select("pretoken", F.posexplode(F.split("pretoken", "")).alias("at", "c"))
    before = F.sum(F.octet_length("c")).over(Window.partitionBy("pretoken").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    starts = each.withColumn("start", F.coalesce(before, F.lit(0))).groupBy("pretoken").agg(F.array_sort(F.collect_list("start")).alias("s"))
    return starts.select("pretoken", F.array_join("s", ",").alias("offsets"))


def worker_stride(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    return B.stride(rows, 3, B.seeded_order("doc_id", 7)).select("doc_id", F.col("worker").cast("long").alias("worker"))


def marker_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    words = C.pretoken_counts(table(spark, sf, "benchmark"), split=lambda c: F.split(c, " ")).where("pretoken != ''")
    marked = words.select("pretoken", T.clean_marker(F.col("pretoken"), continuation="on").alias("piece"))
    return marked


def overlap_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many of each language's 500 most frequent pre-tokens English has among its own."""
    top = C.top_k(C.pretoken_counts(table(spark, sf, "documents"), by=("lang",)), 500, by=("lang",))
    target = top.select(F.struct("lang", "rank").alias("id"), F.col("pretoken").alias("piece"))
    source = top.where("lang = 'en'").select(F.col("pretoken").alias("piece"), F.col("rank").alias("id"))
    found = W.overlap(target, source).select("id.lang", "source_id")
    return found.groupBy("lang").agg(F.count("*").alias("n"), F.count("source_id").alias("n_overlap"))


QUERIES = {
    f.__name__: f
    for f in (
        prediction_lines, tag_lines, argmax_dimension, parameter_paths, parameter_count, masked_tokens, pool_choice, sequence_counts, mean_one_weights, concat_lists,
        gather_pieces, scored_vocab, remapped_ids, softmax_kl, byte_lengths, worker_stride, marker_cleanup, overlap_counts,
    )
}

_U = "('0x' || substr(md5({} || ':5'), 1, 13))::BIGINT / 4503599627370496.0"
SQL = {
    "prediction_lines": "SELECT event_id || chr(9) || printf('%3.3f', round(value, 2)) AS line FROM events",
    "tag_lines": "SELECT item_id, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN length(w) > 5 THEN 'B-X' ELSE 'O' END), ' ') AS line FROM benchmark",
    "argmax_dimension": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS dim FROM embeddings",
    "parameter_paths": "SELECT 'encoder/' || label || '/w' || vec_id AS path FROM embeddings WHERE label < 5",
    "parameter_count": "SELECT sum((label + 1) * 64)::BIGINT AS n FROM embeddings",
    "masked_tokens": f"""WITH s AS (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark), w AS (SELECT item_id, unnest(range(len(ws))) AS pos, length(unnest(ws)) AS id FROM s),
u AS (SELECT *, {_U.format("item_id || '-' || pos")} < 0.15 AS m FROM w) SELECT item_id, pos, CASE WHEN m THEN 99 ELSE id END AS input, CASE WHEN m THEN id ELSE -100 END AS label FROM u""",
    "pool_choice": f"SELECT doc_id, floor({_U.format('doc_id::VARCHAR')} * 4)::BIGINT AS pool FROM documents",
    "sequence_counts": """WITH n AS (SELECT conv_id, turn, length(w) AS id, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations) GROUP BY ALL)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, id) AS rank, id, n FROM n QUALIFY rank <= 4""",
    "mean_one_weights": f"WITH c AS (SELECT pretoken, count(*) AS n FROM ({pretokens_sql()}) GROUP BY pretoken ORDER BY n DESC, pretoken LIMIT 1000) SELECT pretoken, round(n / avg(n) OVER (), 6) AS weight FROM c",
    "concat_lists": "SELECT r_regionkey::BIGINT AS rank, r_name AS piece FROM region UNION ALL SELECT 5 + n_nationkey, n_name FROM nation",
    "gather_pieces": "SELECT doc_id AS pos, n_name AS piece FROM labels JOIN nation ON n_nationkey = doc_id % 30",
    "scored_vocab": "SELECT c_custkey AS id, c_mktsegment AS piece, CASE c_mktsegment WHEN 'BUILDING' THEN -1.5 WHEN 'MACHINERY' THEN -2.5 ELSE 0.0 END::DOUBLE AS score FROM customer",
    "remapped_ids": "SELECT item_id, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE length(w) WHEN 1 THEN -100 WHEN 2 THEN 20 WHEN 3 THEN 30 ELSE length(w) END), ',') AS ids FROM benchmark",
    "softmax_kl": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM v)
SELECT vec_id, round(p[1], 6) AS first, round(list_sum(list_transform(p, lambda x: x * (ln(x) - ln(1 / 64.0)))), 6) AS kl FROM p""",
    "byte_lengths": f"WITH c AS (SELECT DISTINCT pretoken FROM ({pretokens_sql()})) SELECT pretoken, array_to_string(list_transform(range(0, length(pretoken)), lambda j: strlen(substr(pretoken, 1, j))), ',') AS offsets FROM c",
    "worker_stride": "SELECT item_id AS doc_id, (row_number() OVER (ORDER BY md5(item_id::VARCHAR || ':7:0'), item_id) - 1) % 3 AS worker FROM benchmark",
    "marker_cleanup": f"WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS pretoken FROM benchmark), m AS (SELECT pretoken, CASE WHEN starts_with(pretoken, 'on') THEN substr(pretoken, 3) ELSE ' ' || pretoken END AS t FROM w WHERE pretoken <> '') SELECT pretoken, coalesce({mapped_sql('t')}, '') AS piece FROM m",
    "overlap_counts": f"""WITH p AS ({pretokens_sql('lang')}), c AS (SELECT lang, pretoken, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT lang, pretoken FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, pretoken) <= 500)
SELECT r.lang, count(*) AS n, count(e.pretoken) AS n_overlap FROM r LEFT JOIN (SELECT pretoken FROM r WHERE lang = 'en') e USING (pretoken) GROUP BY r.lang""",
}
