"""Queries over sources and sinks, each written to the shared folder and read again, and over further vocabulary operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y
from pyspark.sql.window import Window

from glyphmill.functions import text as T
from glyphmill.operators import batching as B
from glyphmill.operators import counts as C
from glyphmill.operators import encode as E
from glyphmill.operators import metrics as M
from glyphmill.operators import seeds as S
from glyphmill.operators import vectors as V
from glyphmill.operators import vocab as W
from glyphmill.plans.text_queries import _TABLE, _seed_sql, mapped_sql, pretokens_sql
from glyphmill.session import shared_dir
from glyphmill.sources import tables as IO


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/glyphmill-{name}-{uuid.uuid4().hex}"


def corpus_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The French and German texts of a corpus that is stored by language."""
    path = folder(spark, "corpus")
    IO.write_corpus(table(spark, sf, "documents"), path)
    return IO.read_corpus(spark, path, ["fr", "de"]).select("lang", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


def corpus_head(spark: SparkSession, sf: str) -> DataFrame:
    return IO.read_head(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), 50, "doc_id")


def registry_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A registry of languages and their pages without its placeholder, within a list."""
    path = folder(spark, "registry")
    sizes = table(spark, sf, "documents").groupBy(F.col("lang").alias("lang_code")).agg(F.count("*").alias("n_pages"))
    sizes.unionByName(spark.createDataFrame([("-", 7)], "lang_code string, n_pages long")).coalesce(1).write.csv(path, header=True)
    return IO.read_registry(spark, path, ["en", "fr", "de", "-"])


def language_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Codes with a weight for every other nation."""
    path = folder(spark, "languages")
    weight = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("double"))
    table(spark, sf, "nation").select("n_name", weight.alias("weight")).write.csv(path)
    return IO.read_languages(spark, path)


def split_files(spark: SparkSession, sf: str) -> DataFrame:
    """Training and validation files, as CSV and as JSON."""
    schema = Y.StructType([Y.StructField("c_custkey", Y.LongType()), Y.StructField("c_name", Y.StringType())])
    rows, parts = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name"), []
    for kind in ("csv", "json"):
        files = {n: f"{folder(spark, n)}.{kind}" for n in ("train", "validation")}
        for at, path in enumerate(files.values()):
            rows.where(F.col("c_custkey") % 2 == at).write.options(**({"header": "true"} if kind == "csv" else {})).format(kind).save(path)
        parts += [df.select(F.lit(kind).alias("kind"), F.lit(n).alias("part"), "*") for n, df in IO.read_splits(spark, files, schema).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A text sink's lines."""
    path = folder(spark, "text")
    IO.write_text(table(spark, sf, "benchmark"), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def prior_store(spark: SparkSession, sf: str) -> DataFrame:
    path, p = folder(spark, "priors"), table(spark, sf, "part")
    for kind, logp in (("substring", -F.col("p_size").cast("double")), ("token", F.col("p_size") / 2.0)):
        IO.write_prior(p.select(F.col("p_partkey").alias("id"), logp.alias("logp")), path, kind)
    return spark.read.parquet(path).select("kind", "id", "logp")


def parameter_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Three shard files, of which one is named twice and a later one replaces what an earlier one has."""
    rows, paths = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("path"), F.col("s_acctbal").alias("value")), []
    for i in range(3):
        paths.append(folder(spark, "shard"))
        rows.where(F.col("path") % 4 != i).withColumn("value", F.col("value") + i).write.parquet(paths[-1])
    return IO.read_parameters(spark, [paths[0], *paths, paths[1]])


def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "metrics")
    e = table(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("lang"), F.lit("value").alias("metric"), "value")
    for at in range(2):
        IO.append_metrics(e.where(F.col("step") % 2 == at), path)
    return spark.read.parquet(path)


def byte_fallback_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """What pieces like <0x41> stand for, for as many numbers as there are orders below 300, and for other pieces."""
    n = table(spark, sf, "orders").select("o_orderkey").distinct().where("o_orderkey < 300").select(F.col("o_orderkey").cast("long").alias("id"))
    piece = F.when(F.col("id") < 256, F.concat(F.lit("<0x"), F.lpad(F.hex("id"), 2, "0"), F.lit(">"))).otherwise(F.concat(F.lit("w"), F.col("id").cast("string")))
    return n.withColumn("piece", piece).select("id", "piece", T.byte_fallback(F.col("piece")).alias("byte"))


def placeholder_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Each byte-level pre-token, or a placeholder where it's a run of blanks."""
    counts = C.pretoken_counts(table(spark, sf, "documents")).select(T.to_byte_level(F.col("pretoken")).alias("piece"))
    return counts.select("piece", T.placeholder(F.col("piece"), F.octet_length("piece")).alias("renamed"))


def surface_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Byte ids back to byte-level text, padding left out; a text that is the end marker is null, one that holds it isn't."""
    every = table(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, "<|endoftext|>").when(F.col("item_id") % 3 == 1, F.concat(F.lit("<|endoftext|>"), "text")).otherwise(F.col("text")).alias("text"))
    raw = F.encode("text", "UTF-8")
    ids = F.transform(F.sequence(F.lit(1), F.octet_length("text")), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int"))
    rows = every.select("item_id", F.concat(F.array(F.lit(0)), ids, F.array(F.lit(0), F.lit(0))).alias("ids"))
    return rows.select("item_id", F.md5(T.surface_text(F.col("ids"))).alias("digest"), F.length(T.surface_text(F.col("ids"))).cast("long").alias("n_chars"))


def identity_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    out = E.identity_surfaces(table(spark, sf, "part").select(F.col("p_partkey").alias("id")))
    return out.select("id", F.array_join("surface", ",").alias("surface"))


def vocab_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Whether nations equal themselves, and themselves with another id."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("piece"))
    moved = n.withColumn("id", F.when(F.col("id") == 3, F.lit(99)).otherwise(F.col("id")))
    return spark.createDataFrame([("same", W.same_vocab(n, n.orderBy("piece"))), ("moved", W.same_vocab(n, moved))], "name string, equal boolean")


def visit_average(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of several batches for each of 100 ids, averaged."""
    v = table(spark, sf, "embeddings").select((F.col("vec_id") % 100).alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return V.visit_average(v, v.select("id").distinct()).select("id", F.round(V.total(F.col("vec")), 5).alias("total"), F.size("vec").cast("long").alias("dim"))


def unknown_and_padding(spark: SparkSession, sf: str) -> DataFrame:
    """The shares of an unknown id (words of three characters) and of padding, by the conversations' roles."""
    ids = B.pad(F.transform(F.split("text", " "), lambda w: F.length(w)), 24, 0)
    out = M.token_ratios(table(spark, sf, "conversations").select("role", ids.alias("ids")), 3, 0, by="role")
    return out.select("role", F.round("unk_ratio", 9).alias("unk_ratio"), F.round("pad_ratio", 9).alias("pad_ratio"))


def sampled_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """A vocabulary induced from the seed scores of all documents, with special pieces at their ids."""
    scores = S.seed_scores(table(spark, sf, "documents").select(F.lit(0).alias("batch_id"), "text")).select("piece", "score")
    special = spark.createDataFrame([(0, "<s>"), (2, "</s>"), (400, "Ġd"), (5000, "<mask>")], "ref_id int, piece string")
    out = S.sampled_vocab(scores, special, 1391)
    return out.select(F.col("id").cast("long").alias("id"), "piece", "is_special", F.round("score", 6).alias("score"), F.col("byte_length").cast("long").alias("byte_length"), F.col("old_id").cast("long").alias("old_id"))


QUERIES = {
    f.__name__: f
    for f in (
        corpus_scan, corpus_head, registry_scan, language_lines, split_files, text_lines, prior_store, parameter_shards, metric_log, byte_fallback_pieces,
        placeholder_pieces, surface_texts, identity_surfaces, vocab_equality, visit_average, unknown_and_padding, sampled_vocab,
    )
}

_LIST = _TABLE.replace("'", "''")
SQL = {
    "corpus_scan": "SELECT lang, md5(text) AS digest, length(text) AS n_chars FROM documents WHERE lang IN ('fr', 'de')",
    "corpus_head": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 50",
    "registry_scan": "SELECT lang AS lang_code, count(*) AS n_pages FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY lang",
    "language_lines": "SELECT n_name AS lang, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::DOUBLE END AS weight FROM nation",
    "split_files": "SELECT kind, CASE WHEN c_custkey % 2 = 0 THEN 'train' ELSE 'validation' END AS part, c_custkey::BIGINT AS c_custkey, c_name FROM customer, (SELECT unnest(['csv', 'json']) AS kind)",
    "text_lines": "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) GROUP BY line",
    "prior_store": "SELECT 'substring' AS kind, p_partkey AS id, -p_size::DOUBLE AS logp FROM part UNION ALL SELECT 'token', p_partkey, p_size / 2.0::DOUBLE FROM part",
    "parameter_shards": "SELECT s_suppkey AS path, s_acctbal + CASE WHEN s_suppkey % 4 <> 2 THEN 2 ELSE 1 END AS value FROM supplier",
    "metric_log": "SELECT event_id AS step, event_type AS lang, 'value' AS metric, value FROM events",
    "byte_fallback_pieces": f"""WITH n AS (SELECT DISTINCT o_orderkey::BIGINT AS id FROM orders WHERE o_orderkey < 300)
SELECT id, CASE WHEN id < 256 THEN '<0x' || printf('%02X', id) || '>' ELSE 'w' || id END AS piece, CASE WHEN id < 255 THEN substr('{_LIST}', id + 1, 1) END AS byte FROM n""",
    "placeholder_pieces": f"""WITH m AS (SELECT {mapped_sql('pretoken')} AS piece FROM (SELECT DISTINCT pretoken FROM ({pretokens_sql()})))
SELECT piece, CASE WHEN length(regexp_replace(piece, '[^ĠĊĉ]', '', 'g')) > 1 THEN '<unused_whitespace__' || strlen(piece) || '>' ELSE piece END AS renamed FROM m""",
    "surface_texts": f"SELECT item_id, CASE WHEN item_id % 3 <> 0 THEN md5({mapped_sql('text')}) END AS digest, CASE WHEN item_id % 3 <> 0 THEN strlen(text) END AS n_chars FROM (SELECT item_id, CASE WHEN item_id % 3 = 1 THEN '<|endoftext|>' || text ELSE text END AS text FROM benchmark)",
    "identity_surfaces": "SELECT p_partkey AS id, p_partkey::VARCHAR AS surface FROM part",
    "vocab_equality": "SELECT * FROM (VALUES ('same', true), ('moved', false)) AS x(name, equal)",
    "visit_average": """WITH e AS (SELECT vec_id % 100 AS id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT id, pos, avg(x) AS x FROM e GROUP BY ALL)
SELECT id, round(sum(x), 5) AS total, count(*) AS dim FROM m GROUP BY id""",
    "unknown_and_padding": """WITH s AS (SELECT role, list_transform(string_split(text, ' '), lambda w: length(w))[1:24] AS x FROM conversations)
SELECT role, round(sum(len(list_filter(x, lambda i: i = 3))) / sum(24), 9) AS unk_ratio, round(sum(24 - len(x) + len(list_filter(x, lambda i: i = 0))) / sum(24), 9) AS pad_ratio FROM s GROUP BY role""",
    "sampled_vocab": _seed_sql("0") + f""", tot AS (SELECT sum(score) AS s, min(score) AS m FROM scores), b AS (SELECT unnest(['Ġ', 'Ċ', 'ĉ']) AS c),
best AS (SELECT piece, score FROM scores WHERE length(piece) > 1 AND length(regexp_replace(piece, '[^ĠĊĉ]', '', 'g')) <= 1 ORDER BY score DESC, piece LIMIT 1000),
blank AS (SELECT y.c || repeat(x.c, i) AS piece FROM b x, b y, (SELECT unnest(range(1, 16)) AS i)),
lst AS (SELECT 0 AS seg, i AS ord, substr('{_LIST}', i + 1, 1) AS piece, round(ln(m / s), 6) AS score FROM tot, (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT 1, row_number() OVER (ORDER BY piece), piece, 0.0 FROM blank
  UNION ALL SELECT 2, row_number() OVER (ORDER BY score DESC, piece), piece, round(ln(score / s), 6) FROM best, tot),
sp AS (SELECT * FROM (VALUES (0, '<s>'), (2, '</s>'), (400, 'Ġd'), (5000, '<mask>')) AS x(ref, piece)),
o AS (SELECT piece, score, row_number() OVER (ORDER BY seg, ord) - 1 AS r FROM lst WHERE piece NOT IN (SELECT piece FROM sp)), n AS (SELECT count(*) AS n FROM o),
fixed AS (SELECT piece, ref, least(ref, (SELECT n FROM n) + row_number() OVER (ORDER BY ref) - 1) AS id FROM sp),
free AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS r FROM (SELECT unnest(range((SELECT n FROM n) + 4)) AS i) WHERE i NOT IN (SELECT id FROM fixed))
SELECT free.i AS id, piece, false AS is_special, score, length(piece) AS byte_length, NULL::BIGINT AS old_id FROM o JOIN free USING (r)
UNION ALL SELECT id, piece, true, 0.0, length(piece), ref FROM fixed""",
}
