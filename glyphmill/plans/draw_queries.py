"""Queries that draw normal numbers from hashes of keys: noise on seed scores, fallback rows, sizes and noise levels by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import sampling as R
from glyphmill.operators import seeds as S
from glyphmill.operators import vectors as V
from glyphmill.plans import text_queries

NOISE, SEED = 2e-5, 7


def noisy_seed_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of ``seed_topk`` with noise on their probabilities."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.lit(0).alias("batch_id"), "text")
    scores = S.seed_scores(docs).select("piece", "score")
    return S.induce(scores, 1391, noise_std=NOISE, seed=SEED).select("piece", F.round("logp", 6).alias("logp"))


def random_fallback_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each vector, drawn from each dimension's mean and deviation over all vectors: its first number and its sum."""
    vecs = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = R.random_rows(vecs.select("id"), V.column_moments(vecs), SEED)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return rows.select("id", F.round(F.element_at("vec", 1), 6).alias("first"), F.round(total, 5).alias("total"))


def sampled_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """A vocabulary size and a noise level for each document as a step."""
    step = F.col("doc_id")
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", R.vocabulary_size(step, 32768, 8192, 16384, 49152, SEED).alias("size"), F.round(R.noise_std(step, 1e-5, 4.0, SEED), 12).alias("noise")
    )


QUERIES = {f.__name__: f for f in (noisy_seed_topk, random_fallback_rows, sampled_sizes)}


def _normal(key: str) -> str:
    u = "(('0x' || substr(md5({} || ':7'), 1, 13))::BIGINT / 4503599627370496.0)"
    return f"(sqrt(-2 * ln(1 - {u.format(key)})) * cos(2 * pi() * {u.format(f"{key} || '-b'")}))"


SQL = {
    "noisy_seed_topk": text_queries.SQL["seed_topk"].replace("best AS (SELECT piece, score FROM scores WHERE", f"""noisy AS (SELECT piece, score / s + {NOISE} * {_normal("piece")} AS p FROM scores, tot),
best AS (SELECT piece, CASE WHEN p > 0 THEN ln(p) ELSE -100000 END AS logp FROM noisy WHERE""").replace("ORDER BY score DESC, piece LIMIT 1000", "ORDER BY logp DESC, piece LIMIT 1000").replace("round(ln(score / s), 6) FROM best, tot", "round(logp, 6) FROM best"),
    "random_fallback_rows": f"""WITH u AS (SELECT unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std FROM u GROUP BY pos),
r AS (SELECT vec_id, pos, mean + std * {_normal("(vec_id || ':' || pos)")} AS x FROM embeddings, m) SELECT vec_id AS id, round(max(x) FILTER (pos = 0), 6) AS first, round(sum(x), 5) AS total FROM r GROUP BY vec_id""",
    "sampled_sizes": f"""WITH r AS (SELECT doc_id, {_normal("doc_id::VARCHAR")} AS z FROM documents)
SELECT doc_id, trunc(least(greatest(32768 + 8192 * z, 16384), 49152))::INT AS size, round(exp(ln(1e-5) + 4 * z), 12) AS noise FROM r""",
}
