"""Queries over embeddings, labels, events and conversations, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.functions import text as T
from glyphmill.operators import counts as C
from glyphmill.operators import encode as E
from glyphmill.operators import metrics as M
from glyphmill.operators import sampling as R
from glyphmill.operators import vectors as V
from glyphmill.operators.ordering import numbered
from glyphmill.plans.text_queries import mapped_sql, pretokens_sql
from glyphmill.streaming.seed_stream import event_flush


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


def _digest(name: str = "vec") -> list:
    """A vector as a sum and a weighted sum, rounded."""
    weighted = F.aggregate(F.transform(name, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return [F.round(V.total(F.col(name)), 5).alias("total"), F.round(weighted, 4).alias("weighted"), F.size(name).cast("long").alias("dim")]


def embedding_gather(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "labels").select("doc_id", F.pmod("doc_id", F.lit(600)).alias("id"))
    return V.gather(ids, _vectors(spark, sf).select("id", "vec")).select("doc_id", "id", F.round(F.element_at("vec", 1), 6).alias("first"))


def fallback_gather(spark: SparkSession, sf: str) -> DataFrame:
    vecs = _vectors(spark, sf)
    ids = table(spark, sf, "labels").select("doc_id", F.pmod("doc_id", F.lit(420)).alias("id"))
    own = vecs.where("id < 400").select("id", "vec")
    extra = vecs.where("id >= 400").select((F.col("id") - 400).alias("id"), "vec")
    return V.gather_with_fallback(ids, own, extra, 400).select("doc_id", "id", F.round(F.element_at("vec", 1), 6).alias("first"))


def special_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    vecs = _vectors(spark, sf).select("id", "vec")
    new = vecs.where("id % 50 = 0").select("id", F.transform("vec", lambda x: x * -2).alias("vec"))
    return V.overwrite(vecs, new).select("id", *_digest())


def concat_split(spark: SparkSession, sf: str) -> DataFrame:
    vecs = _vectors(spark, sf).select("id", "vec")
    both = V.concat_tables(vecs, vecs.select("id", F.reverse("vec").alias("vec")))
    return V.split_table(both, 64).select("id", F.round(F.element_at("vec_in", 1), 6).alias("first_in"), F.round(F.element_at("vec_out", 1), 6).alias("first_out"), F.size("vec_out").cast("long").alias("dim_out"))


def piece_mean(spark: SparkSession, sf: str) -> DataFrame:
    return V.mean_vectors(_vectors(spark, sf).select(F.col("label").alias("id"), "vec")).select(F.col("id").cast("long").alias("id"), *_digest())


def _transfer(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    source = _vectors(spark, sf).select("id", "vec")
    target = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, F.pmod("doc_id", F.lit(500))).alias("source_id"))
    pieces = target.select("id", F.explode(F.array(F.pmod("id", F.lit(7)), F.pmod("id", F.lit(900)))).alias("p")).select("id", F.when(F.col("p") < 500, F.col("p")).alias("part"))
    return V.lexical_transfer(target, source, pieces, 499, mode).select("id", *_digest())


def lexical_no(spark: SparkSession, sf: str) -> DataFrame:
    return _transfer(spark, sf, "no")


def lexical_fvt(spark: SparkSession, sf: str) -> DataFrame:
    return _transfer(spark, sf, "fvt")


def lexical_bfvt(spark: SparkSession, sf: str) -> DataFrame:
    return _transfer(spark, sf, "bfvt")


def _parameters(spark: SparkSession, sf: str, factor: float) -> DataFrame:
    return _vectors(spark, sf).select(F.concat(F.lit("layers_"), F.col("id").cast("string")).alias("path"), F.transform("vec", lambda x: x * factor + 1).alias("data"))


def delta_merge(spark: SparkSession, sf: str) -> DataFrame:
    parts = [_parameters(spark, sf, f) for f in (1.0, 3.0, 2.0)]
    return V.delta_merge(*parts, 0.5, F.col("path").endswith("7")).select("path", *_digest("data"))


def rescale(spark: SparkSession, sf: str) -> DataFrame:
    vecs = _vectors(spark, sf)
    return V.rescale(vecs.where("label < 5").select("id", "vec"), vecs.where("label >= 5").select("id", "vec")).select("id", F.round(V.total(F.col("vec")), 4).alias("total"))


def column_moments(spark: SparkSession, sf: str) -> DataFrame:
    vecs = _vectors(spark, sf)
    out = V.column_moments(vecs).join(V.column_moments(vecs, sample=True).select("pos", F.col("std").alias("std_sample")), "pos")
    return out.select(F.col("pos").cast("long").alias("pos"), *[F.round(c, 6).alias(c) for c in ("mean", "std", "std_sample")])


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    vecs = _vectors(spark, sf)
    return vecs.select("id", F.col("vec").alias("predicted"), (F.col("label") < 6).alias("mask")).join(vecs.select((F.col("id") - 1).alias("id"), F.col("vec").alias("target")), "id")


def cosine_huber(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("predicted"), F.col("target")
    return _pairs(spark, sf).select("id", F.round(V.cosine(a, b), 6).alias("cosine"), F.round(V.total(V.huber(a, b, 0.5)), 6).alias("huber"), F.round(V.norm(a), 6).alias("norm"))


def lexical_losses(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    rows = [V.lexical_loss(pairs, k).select(F.lit(k).alias("kind"), F.round("loss", 6).alias("loss")) for k in ("mse", "rmse", "huber")]
    rows.append(V.identity_loss(pairs).select(F.lit("identity").alias("kind"), F.round("loss", 6).alias("loss")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def similar_transfer(spark: SparkSession, sf: str) -> DataFrame:
    vecs = _vectors(spark, sf).select("id", "vec")
    return V.similar_transfer(vecs, vecs).select("id", F.round(V.total(F.col("vec")), 5).alias("total"))


def projector(spark: SparkSession, sf: str) -> DataFrame:
    weight, bias = [[(i * 7 + j * 3) % 5 / 10 - 0.2 for j in range(64)] for i in range(64)], [i / 100 for i in range(64)]
    x = _vectors(spark, sf).select("id", F.col("vec").alias("x"))
    x = x.withColumn("h", V.gelu(V.project(F.col("x"), weight, bias))).withColumn("y", F.zip_with("h", "x", lambda a, b: a + b))
    return x.select("id", V.layer_norm(F.col("y")).alias("vec")).select("id", *_digest())


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("step"), "user_id", F.col("event_type").alias("lang"), F.col("value").alias("loss"), (F.col("event_id") % 3 != 0).cast("long").alias("mask"), (F.col("event_id") % 5 + 1).alias("n_bytes"))


def metrics_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("lang", F.octet_length("text").alias("n_bytes"))
    return M.spread(rows, "n_bytes", "lang").select("lang", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def metrics_known_langs(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([("en",), ("de",), ("xx",)], "lang string")
    return M.mean_by(table(spark, sf, "documents"), "n_chars", known=known).select("lang", F.round("mean", 6).alias("mean"))


def loss_bpb(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf)
    per = M.nats_per_byte(rows.withColumnRenamed("user_id", "seq_id"))
    return M.causal_loss(rows).crossJoin(per).select(F.round("loss", 6).alias("loss"), F.round("nats_per_byte", 6).alias("nats_per_byte"))


def mlm_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select("loss", F.when(F.col("step") % 4 == 0, -100).otherwise(F.col("step") % 3).alias("label"), (F.col("step") % 2).alias("predicted"), (F.col("step") % 10 != 0).cast("int").alias("attention"))
    return M.masked_lm(rows).select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select((F.col("loss") / 1000).alias("loss"), F.col("n_bytes").alias("n_chars"), (F.col("step") % 7 == 0).alias("is_special"))
    return M.evaluation(rows).select(*[F.round(c, 6).alias(c) for c in ("average_loss", "chars_per_token", "nats_per_char", "perplexity")])


def label_map(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "documents").select("doc_id", F.concat_ws("-", "lang", "source").alias("name"))
    ids = M.label_ids(names, "name")
    return names.join(F.broadcast(ids) if ids.count() < 10_000 else ids, "name").select("doc_id", "name", F.col("label_id").cast("long").alias("label_id"))


def binary_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 900).cast("int").alias("predicted"))
    rows = table(spark, sf, "labels").join(docs, "doc_id").withColumnRenamed("quality", "label")
    return M.classification(rows).select(F.round("accuracy", 9).alias("accuracy"), F.round("mse", 9).alias("mse"))


def batch_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select(F.floor(F.col("step") / 64).alias("batch"), "loss", (F.col("mask") * 1.0).alias("accuracy"))
    return M.batch_mean(rows).select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "benchmark").select(F.col("item_id").alias("seq_id"), F.posexplode(F.split("text", " ")).alias("pos", "w"))
    tag = F.when(F.length("w") < 3, "O").when(F.length("w") < 5, "B-SHORT").when(F.length("w") < 8, "I-SHORT").otherwise("I-LONG")
    guess = F.when(F.length("w") < 4, "O").when(F.length("w") < 5, "B-SHORT").when(F.length("w") < 8, "I-SHORT").otherwise("I-LONG")
    return w.select("seq_id", "pos", tag.alias("gold"), guess.alias("predicted"), "w")


def bio_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = _words(spark, sf).select("seq_id", F.col("pos").cast("long").alias("pos"), F.when(F.col("pos") % 9 != 0, F.floor(F.col("pos") / 2)).alias("word"), F.col("gold").alias("tag"))
    out = M.first_subword_labels(rows).withColumnRenamed("label", "first_only")
    return M.first_subword_labels(out, all_tokens=True).select("seq_id", "pos", "first_only", F.col("label").alias("all_tokens"))


def span_f1(spark: SparkSession, sf: str) -> DataFrame:
    out = M.span_scores(_words(spark, sf))
    return out.select("kind", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("long").alias("support"))


def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "events").select(F.col("event_id").alias("step"))
    rate = M.learning_rate(F.col("step"), [100, 300], [1e-3, 5e-4], 900, alpha=0.1, random_warmup=20, random_rate=2e-3)
    return steps.select("step", F.round(rate, 12).alias("rate"))


def log_flush(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select(F.col("step") + 1, "lang", "loss").toDF("step", "metric", "value")
    return M.flush_every(rows, 50).select(F.col("flush").cast("long").alias("flush"), "metric", F.round("mean", 6).alias("mean"))


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = event_flush(table(spark, sf, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def hinge_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select((F.col("step") % 40).alias("pretoken"), F.lit(2.0).alias("weight"), F.lit(-2.0).alias("target"), F.when(F.col("step") % 6 != 0, -F.col("loss") / 10).alias("rival"))
    return M.hinge_losses(rows).select("pretoken", F.round("loss", 6).alias("loss"))


def id_remap(spark: SparkSession, sf: str) -> DataFrame:
    kept = numbered(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "new_id", ["doc_id"])
    return table(spark, sf, "documents").select("doc_id").join(kept, "doc_id", "left").select("doc_id", F.coalesce("new_id", F.lit(-100)).cast("long").alias("new_id"))


def padded_lengths(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("role", F.transform(F.split("text", " "), lambda w: F.length(w) % 5).alias("ids"))
    return rows.groupBy("role").agg(F.round(F.avg(F.size(F.filter("ids", lambda x: x != 0))), 6).alias("mean_tokens"))


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """20 samples of 100 ids, each id twice; over 1,000 ids don't fit, and a sample keeps the first that it was dealt."""
    items = _vectors(spark, sf).select("id", (F.element_at("vec", 1) * 10).alias("logp"))
    return R.coverage_sample(items, 100, 2, 20, 4, strict=False).select("sample", "pos", "id")


def equal_batches(spark: SparkSession, sf: str) -> DataFrame:
    return R.equal_batches(_vectors(spark, sf).select("id"), 64, 5).select(F.col("batch").cast("long").alias("batch"), "pos", "id", "padding")


def surface_matrix(spark: SparkSession, sf: str) -> DataFrame:
    counts = C.pretoken_counts(table(spark, sf, "benchmark"))
    vocab = counts.select(T.to_byte_level(F.col("pretoken")).alias("piece"), F.lit(False).alias("is_special")).withColumn("id", F.row_number().over(Window.orderBy("piece")))
    out = E.byte_surfaces(vocab, 7)
    return out.select(F.col("id").cast("long").alias("id"), F.array_join("surface", ",").alias("surface"), "truncated")


QUERIES = {
    f.__name__: f
    for f in (
        embedding_gather, fallback_gather, special_overwrite, concat_split, piece_mean, lexical_no, lexical_fvt, lexical_bfvt, delta_merge, rescale, column_moments,
        cosine_huber, lexical_losses, similar_transfer, projector, metrics_by_lang, metrics_known_langs, loss_bpb, mlm_metrics, eval_metrics, label_map,
        binary_accuracy, batch_means, bio_labels, span_f1, lr_schedule, log_flush, event_windows, hinge_loss, id_remap, padded_lengths, coverage, equal_batches,
        surface_matrix,
    )
}

_V = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label FROM embeddings)"


def _digest_sql(name: str = "vec") -> str:
    return f"round(list_sum({name}), 5) AS total, round(list_sum(list_transform({name}, lambda x, i: x * i)), 4) AS weighted, len({name}) AS dim"


def _mean_sql(source: str, key: str) -> str:
    return f"SELECT {key}, list(x ORDER BY pos) AS vec FROM (SELECT {key}, pos, avg(x) AS x FROM (SELECT {key}, unnest(range(64)) AS pos, unnest(vec) AS x FROM {source}) GROUP BY ALL) GROUP BY {key}"


def _transfer_sql(mode: str) -> str:
    ok = {"no": "false", "fvt": "bool_and(known)", "bfvt": "bool_or(known)"}[mode]
    return f"""WITH {_V}, t AS (SELECT doc_id AS id, CASE WHEN quality = 0 THEN doc_id % 500 END AS source_id FROM labels),
p AS (SELECT id, CASE WHEN p < 500 THEN p END AS part, coalesce(p < 500 AND p <> 499, false) AS known FROM (SELECT id, unnest([id % 7, id % 900]) AS p FROM t)),
g AS (SELECT id FROM p GROUP BY id HAVING {ok}), k AS (SELECT p.id, v.vec FROM p JOIN g USING (id) JOIN v ON v.id = p.part WHERE p.known), m AS ({_mean_sql('k', 'id')}),
o AS (SELECT t.id, coalesce(v.vec, m.vec, (SELECT vec FROM v WHERE id = 499)) AS vec FROM t LEFT JOIN v ON v.id = t.source_id LEFT JOIN m ON m.id = t.id)
SELECT id, {_digest_sql()} FROM o"""


_EV = "e AS (SELECT event_id AS step, user_id, event_type AS lang, value AS loss, (event_id % 3 <> 0)::BIGINT AS mask, event_id % 5 + 1 AS n_bytes FROM events)"
_PAIRS = "p AS (SELECT a.id, a.vec AS x, b.vec AS y, a.label < 6 AS mask FROM v a JOIN v b ON b.id = a.id + 1)"
_WORDS = "s AS (SELECT item_id AS seq_id, string_split(text, ' ') AS ws FROM benchmark), w AS (SELECT seq_id, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM s), g AS (SELECT seq_id, pos, CASE WHEN length(w) < 3 THEN 'O' WHEN length(w) < 5 THEN 'B-SHORT' WHEN length(w) < 8 THEN 'I-SHORT' ELSE 'I-LONG' END AS gold, CASE WHEN length(w) < 4 THEN 'O' WHEN length(w) < 5 THEN 'B-SHORT' WHEN length(w) < 8 THEN 'I-SHORT' ELSE 'I-LONG' END AS predicted FROM w)"


def _spans_sql(tag: str) -> str:
    return f"""(SELECT seq_id, kind, min(pos) AS first, max(pos) AS last FROM (SELECT *, sum(b) OVER (PARTITION BY seq_id ORDER BY pos) AS e FROM (
SELECT seq_id, pos, {tag} AS t, split_part({tag}, '-', -1) AS kind, CASE WHEN {tag}[1] = 'B' OR ({tag}[1] = 'I' AND (coalesce(lag({tag}) OVER q, 'O') = 'O' OR split_part(lag({tag}) OVER q, '-', -1) <> split_part({tag}, '-', -1))) THEN 1 ELSE 0 END AS b
FROM g WINDOW q AS (PARTITION BY seq_id ORDER BY pos))) WHERE t <> 'O' GROUP BY seq_id, e, kind)"""


_GELU = "0.5 * z * (1 + tanh(0.7978845608028654 * (z + 0.044715 * z * z * z)))"
_PROJECTOR = f"""WITH {_V}, h AS (SELECT id, vec, list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 64), lambda j: vec[j + 1] * ((i * 7 + j * 3) % 5 / 10.0::DOUBLE - 0.2::DOUBLE))) + i / 100.0::DOUBLE) AS p FROM v),
g AS (SELECT id, vec, list_transform(p, lambda z: {_GELU}) AS g FROM h), y AS (SELECT id, list_transform(g, lambda a, i: a + vec[i]) AS y FROM g), c AS (SELECT id, list_transform(y, lambda a: a - list_sum(y) / 64) AS c FROM y),
n AS (SELECT id, list_transform(c, lambda a: a / sqrt(list_sum(list_transform(c, lambda b: b * b)) / 64 + 1e-5)) AS vec FROM c) SELECT id, {_digest_sql()} FROM n"""

_U4 = "greatest(('0x' || substr(md5({} || ':4'), 1, 13))::BIGINT / 4503599627370496.0, 1e-15)"
_COVERAGE = f"""WITH i AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 10 AS logp FROM embeddings),
r AS (SELECT id, p, row_number() OVER (PARTITION BY p ORDER BY md5(id || ':' || p || ':4'), id) - 1 AS r FROM i, (SELECT unnest([0, 1]) AS p)),
d AS (SELECT (p * 10 + r % 10)::INT AS sample, id, 0.0::DOUBLE AS k FROM r), e AS (SELECT s::INT AS sample, id, logp FROM i, (SELECT unnest(range(20)) AS s) WHERE logp > -100000),
a AS (SELECT * FROM d UNION ALL SELECT e.sample, e.id, -ln({_U4.format("e.id || '-' || e.sample")}) / exp(e.logp) FROM e ANTI JOIN d ON d.sample = e.sample AND d.id = e.id)
SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY k, id) - 1 AS pos, id FROM a QUALIFY pos < 100"""
_SURFACES = f"""WITH c AS (SELECT DISTINCT pretoken FROM ({pretokens_sql(source='benchmark')})), m AS (SELECT {mapped_sql('pretoken')} AS piece, hex(encode(pretoken)) AS h FROM c)
SELECT row_number() OVER (ORDER BY piece) AS id, array_to_string(list_transform(range(0, 7), lambda i: CASE WHEN 2 * i < length(h) THEN ('0x' || substr(h, 2 * i + 1, 2))::INT ELSE 0 END), ',') AS surface, length(h) > 14 AS truncated FROM m"""

SQL = {
    "projector": _PROJECTOR,
    "coverage": _COVERAGE,
    "surface_matrix": _SURFACES,
    "embedding_gather": f"WITH {_V} SELECT doc_id, doc_id % 600 AS id, round(vec[1], 6) AS first FROM labels LEFT JOIN v ON v.id = doc_id % 600",
    "fallback_gather": f"WITH {_V} SELECT doc_id, doc_id % 420 AS id, round(vec[1], 6) AS first FROM labels LEFT JOIN v ON v.id = doc_id % 420",
    "special_overwrite": f"WITH {_V}, o AS (SELECT id, CASE WHEN id % 50 = 0 THEN list_transform(vec, lambda x: x * -2) ELSE vec END AS vec FROM v) SELECT id, {_digest_sql()} FROM o",
    "concat_split": f"WITH {_V} SELECT id, round(vec[1], 6) AS first_in, round(vec[64], 6) AS first_out, 64::BIGINT AS dim_out FROM v",
    "piece_mean": f"WITH {_V}, m AS ({_mean_sql('v', 'label')}) SELECT label::BIGINT AS id, {_digest_sql()} FROM m",
    "lexical_no": _transfer_sql("no"),
    "lexical_fvt": _transfer_sql("fvt"),
    "lexical_bfvt": _transfer_sql("bfvt"),
    "delta_merge": f"WITH {_V}, o AS (SELECT 'layers_' || id AS path, CASE WHEN id % 10 = 7 THEN list_transform(vec, lambda x: x + 1) ELSE list_transform(vec, lambda x: x + 1 + 0.5 * ((x * 3 + 1) - (x * 2 + 1))) END AS data FROM v) SELECT path, {_digest_sql('data')} FROM o",
    "rescale": f"""WITH {_V}, u AS (SELECT id, label < 5 AS own, unnest(range(64)) AS pos, unnest(vec) AS x FROM v), m AS (SELECT own, pos, avg(x) AS mean, stddev_pop(x) AS std FROM u GROUP BY ALL),
c AS (SELECT a.pos, b.std / (a.std + 1e-8) AS w, b.mean - a.mean * (b.std / (a.std + 1e-8)) AS b FROM m a JOIN m b ON a.pos = b.pos WHERE a.own AND NOT b.own) SELECT id, round(sum(x * w + b), 4) AS total FROM u JOIN c USING (pos) WHERE own GROUP BY id""",
    "column_moments": f"WITH {_V}, u AS (SELECT unnest(range(64)) AS pos, unnest(vec) AS x FROM v) SELECT pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(stddev_samp(x), 6) AS std_sample FROM u GROUP BY pos",
    "cosine_huber": f"""WITH {_V}, {_PAIRS}, z AS (SELECT id, x, y, list_transform(list_zip(x, y), lambda q: abs(q[1] - q[2])) AS d FROM p)
SELECT id, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 6) AS cosine, round(list_sum(list_transform(d, lambda e: 0.5 * least(e, 0.5) * least(e, 0.5) + 0.5 * (e - least(e, 0.5)))), 6) AS huber, round(sqrt(list_dot_product(x, x)), 6) AS norm FROM z""",
    "lexical_losses": f"""WITH {_V}, {_PAIRS}, z AS (SELECT mask::INT AS m, list_transform(list_zip(x, y), lambda q: q[1] - q[2]) AS d, sqrt(list_dot_product(y, y)) AS n FROM p),
k AS (SELECT m, n, list_dot_product(d, d) AS mse, sqrt(list_dot_product(d, d)) AS rmse, list_sum(list_transform(d, lambda e: 0.5 * least(abs(e), 0.001) * least(abs(e), 0.001) + 0.001 * (abs(e) - least(abs(e), 0.001)))) / 64 / 0.001 / 30 AS hub FROM z)
SELECT 'mse' AS kind, round(sum(mse * m) / (sum(m) + 1e-8) / avg(n), 6) AS loss FROM k UNION ALL SELECT 'rmse', round(sum(rmse * m) / (sum(m) + 1e-8) / avg(n), 6) FROM k
UNION ALL SELECT 'huber', round(sum(hub * m) / (sum(m) + 1e-8) / avg(n), 6) FROM k UNION ALL SELECT 'identity', round(avg(mse), 6) FROM k""",
    "similar_transfer": f"""WITH {_V}, s AS (SELECT q.id, v.id AS n, list_dot_product(q.vec, v.vec) / (sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(v.vec, v.vec))) AS s, list_sum(v.vec) AS t FROM v q, v),
r AS (SELECT id, s, t FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, n) <= 10) SELECT id, round(sum(exp(s / 0.1) * t) / sum(exp(s / 0.1)), 5) AS total FROM r GROUP BY id""",
    "metrics_by_lang": "SELECT lang, round(avg(strlen(text)), 6) AS mean, round(stddev_pop(strlen(text)), 6) AS std FROM documents GROUP BY lang",
    "metrics_known_langs": "SELECT k.lang, round(coalesce(avg(n_chars), 'nan'::DOUBLE), 6) AS mean FROM (SELECT unnest(['en', 'de', 'xx']) AS lang) k LEFT JOIN documents d USING (lang) GROUP BY k.lang",
    "loss_bpb": f"WITH {_EV}, s AS (SELECT sum(loss * mask) / sum(n_bytes) AS x FROM e GROUP BY user_id) SELECT round((SELECT sum(loss * mask) / sum(mask) FROM e), 6) AS loss, round(avg(x), 6) AS nats_per_byte FROM s",
    "mlm_metrics": f"WITH {_EV}, l AS (SELECT loss, CASE WHEN step % 4 = 0 THEN -100 ELSE step % 3 END AS label, step % 2 AS p, step % 10 <> 0 AS att FROM e) SELECT round(avg(loss) FILTER (label <> -100 AND att), 6) AS loss, round(avg((label = p)::INT) FILTER (label <> -100), 6) AS accuracy FROM l",
    "eval_metrics": f"WITH {_EV}, l AS (SELECT CASE WHEN step % 7 = 0 THEN 0 ELSE loss / 1000 END AS loss, n_bytes AS c FROM e) SELECT round(avg(loss), 6) AS average_loss, round(avg(c), 6) AS chars_per_token, round(sum(loss) / greatest(sum(c), 1), 6) AS nats_per_char, round(exp(avg(loss)), 6) AS perplexity FROM l",
    "label_map": "WITH n AS (SELECT doc_id, lang || '-' || source AS name FROM documents), i AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS label_id FROM (SELECT DISTINCT name FROM n)) SELECT doc_id, name, label_id FROM n JOIN i USING (name)",
    "binary_accuracy": "WITH r AS (SELECT quality AS l, (n_chars > 900)::INT AS p FROM labels JOIN documents USING (doc_id)) SELECT round(avg((l = p)::INT), 9) AS accuracy, round(avg((l - p) * (l - p)), 9) AS mse FROM r",
    "batch_means": f"WITH {_EV}, b AS (SELECT avg(loss) AS loss, avg(mask) AS accuracy FROM e GROUP BY step // 64) SELECT round(avg(loss), 6) AS loss, round(avg(accuracy), 6) AS accuracy FROM b",
    "bio_labels": f"""WITH {_WORDS}, r AS (SELECT seq_id, pos, CASE WHEN pos % 9 <> 0 THEN pos // 2 END AS word, gold AS tag FROM g), l AS (SELECT *, lag(word) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM r)
SELECT seq_id, pos, CASE WHEN word IS NULL THEN '-100' WHEN b IS NULL OR b <> word THEN tag ELSE '-100' END AS first_only, CASE WHEN word IS NULL THEN '-100' WHEN b IS NULL OR b <> word THEN tag ELSE regexp_replace(tag, '^B-', 'I-') END AS all_tokens FROM l""",
    "span_f1": f"""WITH {_WORDS}, a AS {_spans_sql('gold')}, b AS {_spans_sql('predicted')},
j AS (SELECT coalesce(a.kind, b.kind) AS kind, (a.kind IS NOT NULL)::INT AS g, (b.kind IS NOT NULL)::INT AS p FROM a FULL JOIN b ON a.seq_id = b.seq_id AND a.kind = b.kind AND a.first = b.first AND a.last = b.last),
u AS (SELECT kind, g, p FROM j UNION ALL SELECT 'overall', g, p FROM j), r AS (SELECT kind, sum(g * p) AS hit, sum(g)::BIGINT AS support, sum(p) AS found FROM u GROUP BY kind),
q AS (SELECT kind, support, CASE WHEN found > 0 THEN hit / found ELSE 0 END AS pr, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS re FROM r)
SELECT kind, support, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 9) AS f1 FROM q""",
    "lr_schedule": "SELECT event_id AS step, round(CASE WHEN event_id < 20 THEN 2e-3 * event_id / 20 WHEN event_id < 100 THEN 1e-3 * (event_id - 20) / 80 WHEN event_id < 300 THEN 5e-4 * (event_id - 100) / 200 ELSE 5e-4 * (0.9 * 0.5 * (1 + cos(pi() * least((event_id - 300) / 600, 1.0))) + 0.1) END, 12) AS rate FROM events",
    "log_flush": f"WITH {_EV} SELECT step // 50 AS flush, lang AS metric, round(avg(loss), 6) AS mean FROM e GROUP BY ALL",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "hinge_loss": f"WITH {_EV} SELECT step % 40 AS pretoken, round(2 * sum(CASE WHEN step % 6 <> 0 THEN greatest(0, 0.1 + 2 - loss / 10) ELSE 0 END), 6) AS loss FROM e GROUP BY ALL",
    "id_remap": "WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM labels WHERE quality = 1) SELECT doc_id, coalesce(n, -100) AS new_id FROM documents LEFT JOIN k USING (doc_id)",
    "padded_lengths": "SELECT role, round(avg(len(list_filter(string_split(text, ' '), lambda w: length(w) % 5 <> 0))), 6) AS mean_tokens FROM conversations GROUP BY role",
    "equal_batches": "WITH r AS (SELECT vec_id AS id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR || ':5'), vec_id) - 1 AS r FROM embeddings), u AS (SELECT id, r, false AS padding FROM r UNION ALL SELECT 0, unnest(range((SELECT count(*) FROM r), (SELECT (count(*) + 63) // 64 * 64 FROM r))), true) SELECT r // 64 AS batch, r % 64 AS pos, id, padding FROM u",
}
