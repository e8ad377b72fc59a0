"""Queries over saved folders, registries, endless streams, windows of groups, and vocabularies by language."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from glyphmill.functions import text as T
from glyphmill.operators import batching as B
from glyphmill.operators import counts as C
from glyphmill.operators import metrics as M
from glyphmill.operators import seeds as S
from glyphmill.operators import vectors as V
from glyphmill.operators import vocab as W
from glyphmill.plans.source_queries import folder, table
from glyphmill.plans.text_queries import _TABLE, _seed_sql, mapped_sql, pretokens_sql
from glyphmill.sources import tables as IO


def saved_split(spark: SparkSession, sf: str) -> DataFrame:
    """Both splits of a saved dict of splits."""
    path, rows = folder(spark, "saved"), table(spark, sf, "benchmark").select("item_id", "text")
    for at, split in enumerate(("train", "test")):
        IO.write_saved(rows.where(F.col("item_id") % 2 == at), path, split)
    parts = [IO.read_saved(spark, path, split=s).select(F.lit(s).alias("split"), "item_id", F.md5("text").alias("digest")) for s in ("train", "test")]
    return parts[0].unionByName(parts[1])


def arrow_split(spark: SparkSession, sf: str) -> DataFrame:
    """The train split of a folder of Arrow streams, which tasks write and tasks read."""
    path, kind = folder(spark, "arrow"), Y.StructType([Y.StructField("doc_id", Y.LongType()), Y.StructField("lang", Y.StringType())])

    def pack(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"content": [sink.getvalue().to_pybytes()]})

    streams = table(spark, sf, "documents").select("doc_id", "lang").mapInArrow(pack, "content binary")
    return IO.arrow_rows(streams, kind)


def code_contents(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus whose texts stand in another column."""
    rows = IO.rename_content(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")))
    return rows.select("doc_id", F.md5("text").alias("digest"))


def registry_pages(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    registry = docs.groupBy(F.col("lang").alias("lang_code")).agg(F.count("*").alias("n_pages"))
    return IO.lookup_pages(docs.select("doc_id", "lang"), registry).select("doc_id", "lang", "n_pages")


def gathered_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a table for all ids, gathered and written in batches of 64 of them, one batch twice."""
    path, v = folder(spark, "gathered"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    ids = v.select("id")
    for part in (ids, ids.where("id < 64")):
        IO.write_batches(V.gather(part, v), path, 64)
    return spark.read.parquet(path).select(F.col("batch").cast("long").alias("batch"), "id", F.round(V.total(F.col("vec")), 5).alias("total"))


def identity_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """A table that stays where the vocabularies are equal, and one that is taken from the unknown row where they aren't."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("piece"))
    moved = n.withColumn("piece", F.lower("piece"))
    unknown = lambda: v.select("id").crossJoin(F.broadcast(v.where("id = 9").select("vec")))  # noqa: E731  one row
    both = [V.transfer_unless_equal(n, other, v, unknown).withColumn("kind", F.lit(kind)) for kind, other in (("same", n), ("moved", moved))]
    return both[0].unionByName(both[1]).select("kind", "id", F.round(V.total(F.col("vec")), 5).alias("total"))


def recent_window(spark: SparkSession, sf: str) -> DataFrame:
    """The last two batches of each language and pool, whichever they are."""
    keys = ("lang", "pool")
    texts = table(spark, sf, "documents").select("lang", (F.col("doc_id") % 2).alias("pool"), F.floor(F.col("doc_id") / 32).alias("batch_id"), "text")
    return S.recent_scores(S.seed_scores(S.recent_texts(texts, 2, keys), by=(*keys, "batch_id")), 2, keys)


def restarted_stream(spark: SparkSession, sf: str) -> DataFrame:
    """1,000 steps of each label's stream, which is exhausted and starts anew."""
    rows = table(spark, sf, "embeddings").select("label", "vec_id")
    return B.restarting(rows, 1000, "label", "vec_id", seed=3).select("label", F.col("pos").cast("long").alias("pos"), F.col("epoch").cast("long").alias("epoch"), "vec_id")


def language_vocabularies(spark: SparkSession, sf: str) -> DataFrame:
    """300 pre-tokens of each language; German and French stand for languages that are sampled."""
    out = C.language_vocabularies(table(spark, sf, "documents"), 300, ["de", "fr"], 20, seed=5)
    return out.select("lang", "pretoken", "n", F.col("rank").cast("long").alias("rank"))


def seed_unigram(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of a word-level vocabulary in byte-level form, with scores from their substrings' counts."""
    counts = C.pretoken_counts(table(spark, sf, "documents")).select(T.to_byte_level(F.col("pretoken")).alias("pretoken"), "n")
    words = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("id"), F.concat(F.lit("▁"), F.lower(F.substring("n_name", 1, 2))).alias("piece"), F.lit(False).alias("is_special"))
    vocab = spark.createDataFrame([(0, "<s>", True)], "id int, piece string, is_special boolean").unionByName(words)
    return W.seed_unigram(vocab, counts).select(F.col("id").cast("long").alias("id"), "piece", "is_special", F.round("score", 6).alias("score"))


def dense_remap(spark: SparkSession, sf: str) -> DataFrame:
    """Ids (three for each word length, -100 for words of one letter) as places among the ids in use."""
    ids = F.transform(F.split("text", " "), lambda w, i: F.when(F.length(w) == 1, -100).otherwise(F.length(w) * 10 + i % 3))
    out = W.dense_remap(table(spark, sf, "benchmark").select("item_id", ids.alias("ids")), "item_id")
    return out.select("item_id", F.array_join("ids", ",").alias("ids"))


def special_match(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.concat(F.lit("token_"), "n_nationkey").alias("name"), F.concat(F.lit("<"), "n_name", F.lit(">")).alias("piece"), F.col("n_nationkey").alias("id"))
    return W.match_specials(n, n.where("id % 3 > 0").select("name", F.lower("piece").alias("piece"), (F.col("id") + 100).alias("id")))


def first_wrong(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 users with a rival ahead of the target by more than the margin."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("pretoken"), F.lit(1.0).alias("weight"), F.lit(-2.0).alias("target"), (-F.col("value") / 4).alias("rival"))
    losses = M.hinge_losses(rows, margin=0.0).withColumnRenamed("pretoken", "rank")
    return M.first_wrong(losses, 50).select("rank", F.round("loss", 6).alias("loss"))


def score_change(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_totalprice").cast("double").alias("before"), (F.col("o_orderkey") % 1000).cast("double").alias("after"))
    return M.mean_change(rows, "before", "after").select(F.round("change", 4).alias("change"))


QUERIES = {
    f.__name__: f
    for f in (
        saved_split, arrow_split, code_contents, registry_pages, gathered_batches, identity_transfer, recent_window, restarted_stream, language_vocabularies,
        seed_unigram, dense_remap, special_match, first_wrong, score_change,
    )
}

_SUM = "list_sum(list_transform(embedding, lambda x: x::DOUBLE))"
_LIST = _TABLE.replace("'", "''")
SQL = {
    "saved_split": "SELECT CASE WHEN item_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, item_id, md5(text) AS digest FROM benchmark",
    "arrow_split": "SELECT doc_id, lang FROM documents",
    "code_contents": "SELECT doc_id, md5(text) AS digest FROM documents",
    "registry_pages": "SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n_pages FROM documents",
    "gathered_batches": f"SELECT (vec_id // 64)::BIGINT AS batch, vec_id AS id, round({_SUM}, 5) AS total FROM embeddings",
    "identity_transfer": f"SELECT 'same' AS kind, vec_id AS id, round({_SUM}, 5) AS total FROM embeddings UNION ALL SELECT 'moved', vec_id, (SELECT round({_SUM}, 5) FROM embeddings WHERE vec_id = 9) FROM embeddings",
    "recent_window": _seed_sql("lang || '|' || (doc_id % 2) || '|' || (doc_id // 32)") + """, keyed AS (SELECT string_split(batch_id, '|') AS b, piece, score FROM scores),
grouped AS (SELECT b[1] AS lang, b[2]::BIGINT AS pool, b[3]::BIGINT AS batch, piece, score FROM keyed), newest AS (SELECT DISTINCT lang, pool, batch FROM grouped QUALIFY dense_rank() OVER (PARTITION BY lang, pool ORDER BY batch DESC) <= 2)
SELECT lang, pool, piece, sum(score)::BIGINT AS score FROM grouped JOIN newest USING (lang, pool, batch) GROUP BY ALL""",
    "restarted_stream": """WITH s AS (SELECT label, vec_id, count(*) OVER (PARTITION BY label) AS size FROM embeddings), e AS (SELECT *, unnest(range((999 + size) // size)) AS epoch FROM s),
p AS (SELECT label, vec_id, epoch, epoch * size + row_number() OVER (PARTITION BY label, epoch ORDER BY md5(vec_id || ':3:' || epoch), vec_id) - 1 AS pos FROM e) SELECT label, pos, epoch, vec_id FROM p WHERE pos < 1000""",
    "language_vocabularies": f"""WITH d AS (SELECT lang, text FROM documents QUALIFY lang NOT IN ('de', 'fr') OR row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':5:0'), doc_id) <= 20),
p AS ({pretokens_sql('lang', source='d')}), c AS (SELECT lang, pretoken, count(*) AS n FROM p GROUP BY ALL) SELECT lang, pretoken, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, pretoken) AS rank FROM c QUALIFY rank <= 300""",
    "seed_unigram": f"""WITH c AS (SELECT {mapped_sql('pretoken')} AS t, n FROM (SELECT pretoken, count(*) AS n FROM ({pretokens_sql()}) GROUP BY pretoken)),
w AS (SELECT 0 AS id, '<s>' AS piece, true AS is_special UNION ALL SELECT n_nationkey + 1, 'Ġ' || lower(substr(n_name, 1, 2)), false FROM nation), x AS (SELECT unnest(string_split('{_LIST}', '')) AS piece EXCEPT SELECT piece FROM w),
v AS (SELECT * FROM w UNION ALL SELECT (SELECT max(id) FROM w) + row_number() OVER (ORDER BY piece), piece, false FROM x),
o AS (SELECT piece, sum(n) AS n FROM (SELECT n, unnest(list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1)) || list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS piece FROM c) GROUP BY piece)
SELECT id, piece, is_special, round(CASE WHEN is_special THEN 0.0 ELSE ln((1 + coalesce(n, 0)) / sum(1 + coalesce(n, 0)) OVER ()) END, 6) AS score FROM v LEFT JOIN o USING (piece)""",
    "dense_remap": """WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM benchmark),
x AS (SELECT item_id, i, CASE WHEN length(w) = 1 THEN -100 ELSE length(w) * 10 + i % 3 END AS id FROM w), d AS (SELECT id, CASE WHEN id < 0 THEN id ELSE dense_rank() OVER (PARTITION BY id < 0 ORDER BY id) - 1 END AS new FROM (SELECT DISTINCT id FROM x))
SELECT item_id, string_agg(new, ',' ORDER BY i) AS ids FROM x JOIN d USING (id) GROUP BY item_id""",
    "special_match": "SELECT 'token_' || n_nationkey AS name, '<' || n_name || '>' AS piece, n_nationkey AS id, CASE WHEN n_nationkey % 3 > 0 THEN '<' || lower(n_name) || '>' END AS source_piece, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey + 100 END AS source_id FROM nation",
    "first_wrong": "SELECT user_id AS rank, round(sum(greatest(0, 2 - value / 4)), 6) AS loss FROM events GROUP BY user_id HAVING sum(greatest(0, 2 - value / 4)) > 0 ORDER BY user_id LIMIT 50",
    "score_change": "SELECT round(avg(abs(o_orderkey % 1000 - o_totalprice)), 4) AS change FROM orders",
}
