"""Queries over the text tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.functions import text as T
from glyphmill.operators import batching as B
from glyphmill.operators import counts as C
from glyphmill.operators import sampling as R
from glyphmill.operators import seeds as S
from glyphmill.operators import vocab as V
from glyphmill.operators.ordering import numbered
from glyphmill.session import materialise

#: The pre-tokenizer for RE2, which has no look-ahead: a mark is set before the last blank of a run that leads a word.
_CUT = r"unnest(string_split(regexp_replace(text, '(\s+)(\s\S)', '\1' || chr(1) || '\2', 'g'), chr(1)))"
_PIECES = r"'''s|''t|''re|''ve|''m|''ll|''d| ?[\p{L}\p{M}]+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+'"
_LETTERS = _PIECES.replace(r"[\p{L}\p{M}]", r"\p{L}")
_TABLE = "".join(c for _, c in sorted(T.byte_alphabet().items()))


def pretokens_sql(columns: str = "", pieces: str = _PIECES, source: str = "documents") -> str:
    cols = f"{columns}, " if columns else ""
    return f"SELECT {cols}unnest(regexp_extract_all(x, {pieces})) AS pretoken FROM (SELECT {cols}{_CUT} AS x FROM {source})"


def mapped_sql(column: str) -> str:
    """Byte-level form of a column in DuckDB."""
    table = _TABLE.replace("'", "''")
    h = f"hex(encode({column}))"
    return f"list_aggregate(list_transform(range(0, length({h}) // 2), lambda i: substr('{table}', 1 + ('0x' || substr({h}, 2 * i + 1, 2))::INT, 1)), 'string_agg', '')"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def pretoken_topk_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return C.top_k(C.pretoken_counts(docs(spark, sf), by=("lang",)), 100, by=("lang",)).select("lang", "pretoken", "n", F.col("rank").cast("long").alias("rank"))


def pretoken_letters(spark: SparkSession, sf: str) -> DataFrame:
    return C.pretoken_counts(docs(spark, sf), split=lambda c: T.pretokens(c, letters_only=True))


def default_pretokens(spark: SparkSession, sf: str) -> DataFrame:
    return C.pretoken_counts(docs(spark, sf), split=T.whitespace_pretokens)


def bytelevel_pretokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.pretoken_counts(docs(spark, sf)).withColumn("piece", T.to_byte_level(F.col("pretoken")))
    return rows.select("piece", "n", F.length("piece").cast("long").alias("n_chars"), F.octet_length("piece").cast("long").alias("n_octets"), T.blank_run(F.col("piece")).alias("blank_run"))


def bytelevel_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    same = T.from_byte_level(T.to_byte_level(F.col("text"))) == F.col("text")
    return docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(same, 1)).alias("n_same"), F.sum(F.length(T.to_byte_level(F.col("text")))).alias("n_bytes"))


def unescape_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = T.unescape(F.replace("html", F.lit("<"), F.lit("\\n\\_")))
    return pages.select("page_id", F.md5(out).alias("digest"), F.length(out).cast("long").alias("n_chars"))


def strip_nonempty(spark: SparkSession, sf: str) -> DataFrame:
    stripped = T.strip(F.concat(F.lit(" \n"), F.col("text"), F.lit("\t ")))
    return docs(spark, sf).select("doc_id", stripped.alias("s")).where(F.length("s") > 0).select("doc_id", F.length("s").cast("long").alias("n_chars"), F.md5("s").alias("digest"))


def crop_span(spark: SparkSession, sf: str) -> DataFrame:
    cut = T.crop(F.col("text"), 32)
    return docs(spark, sf).select("doc_id", F.md5(cut).alias("digest"), F.length(cut).cast("long").alias("n_chars"))


def dedupe_batch_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).select(F.floor(F.col("doc_id") / 128).alias("batch_id"), "text")
    kept = rows.dropDuplicates(["batch_id", "text"]).groupBy("batch_id").agg(F.count("*").alias("n_kept"))
    return rows.groupBy("batch_id").agg(F.count("*").alias("n")).join(kept, "batch_id")


def page_names(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", T.path_name(F.col("url")).alias("name"))


def _vocab(spark: SparkSession, sf: str, size: int = 200, counts: DataFrame | None = None) -> DataFrame:
    """(id, piece, is_special): the most frequent pre-tokens of 12 characters at most, in byte-level form, after two
    specials. A vocabulary has a stated size, so it's made once and kept as a local table."""
    counts = (counts or C.pretoken_counts(docs(spark, sf))).where("length(pretoken) <= 12")
    top = C.top_k(counts, size).select(T.to_byte_level(F.col("pretoken")).alias("piece")).collect()
    rows = [(0, "<s>", True), (1, "</s>", True)] + [(i + 2, r.piece, False) for i, r in enumerate(top)]
    return spark.createDataFrame(rows, "id int, piece string, is_special boolean")


_VOCAB_SQL = f"""p AS ({pretokens_sql()}), c AS (SELECT pretoken, count(*) AS n FROM p GROUP BY pretoken),
top AS (SELECT pretoken, n, row_number() OVER (ORDER BY n DESC, pretoken) AS r FROM c WHERE length(pretoken) <= 12),
vocab AS (SELECT 0 AS id, '<s>' AS piece, true AS is_special UNION ALL SELECT 1, '</s>', true
  UNION ALL SELECT r + 1, {mapped_sql('pretoken')}, false FROM top WHERE r <= 200)"""


def substring_prior(spark: SparkSession, sf: str) -> DataFrame:
    raw = materialise(C.pretoken_counts(docs(spark, sf)), "pretokens")
    counts = raw.select(T.to_byte_level(F.col("pretoken")).alias("pretoken"), "n")
    out = C.substring_prior(counts, _vocab(spark, sf, counts=raw))
    return out.select(F.col("id").cast("long").alias("id"), "piece", "n", F.round("logp", 6).alias("logp"))


def token_prior(spark: SparkSession, sf: str) -> DataFrame:
    counts = materialise(C.pretoken_counts(docs(spark, sf)), "pretokens")
    vocab = _vocab(spark, sf, counts=counts)
    ids = counts.select(T.to_byte_level(F.col("pretoken")).alias("piece"), "n").join(F.broadcast(vocab), "piece").select("id", "n")
    return C.token_prior(ids, vocab).select(F.col("id").cast("long").alias("id"), "n", F.round("logp", 6).alias("logp"))


def alphabet_missing(spark: SparkSession, sf: str) -> DataFrame:
    return V.missing_alphabet(_vocab(spark, sf))


def special_overlap(spark: SparkSession, sf: str) -> DataFrame:
    special = spark.createDataFrame([("Ġthe",), ("Ġde",), ("<s>",), ("<mask>",)], "piece string")
    return _vocab(spark, sf).select("piece").intersect(special)


def special_placement(spark: SparkSession, sf: str) -> DataFrame:
    pieces = _vocab(spark, sf).where("not is_special").select(F.col("id").alias("rank"), "piece")
    special = spark.createDataFrame([(0, "<s>"), (3, "<pad>"), (7, "Ġthe"), (900, "<mask>")], "ref_id int, piece string")
    return V.place_specials(pieces, special).select(F.col("id").cast("long").alias("id"), "piece", "is_special")


def vocab_overlap(spark: SparkSession, sf: str) -> DataFrame:
    top = lambda lang: C.top_k(C.pretoken_counts(docs(spark, sf).where(F.col("lang") == lang)), 300)
    number = (F.row_number().over(Window.orderBy(F.desc("n"), "pretoken")) - 1).cast("long")
    target, source = (top(x).select(number.alias("id"), F.col("pretoken").alias("piece")) for x in ("fr", "en"))
    return V.overlap(target, source)


def byte_vocab(spark: SparkSession, sf: str) -> DataFrame:
    words = C.top_k(C.pretoken_counts(docs(spark, sf), split=lambda c: F.split(c, r"\s+")).where("length(pretoken) > 1"), 150)
    number = (F.row_number().over(Window.orderBy(F.desc("n"), "pretoken")) + 1).cast("int")
    marked = words.select(number.alias("id"), F.when(number % 3 == 0, F.concat(F.lit("##"), F.col("pretoken"))).otherwise(F.col("pretoken")).alias("piece"))
    special = spark.createDataFrame([(0, "[CLS]"), (1, "[SEP]")], "id int, piece string")
    vocab = special.withColumn("is_special", F.lit(True)).unionByName(marked.withColumn("is_special", F.lit(False)).select("id", "piece", "is_special"))
    out = V.to_byte_vocab(vocab.withColumn("score", -F.col("id").cast("double")), continuation="##")
    return out.select(F.col("id").cast("long").alias("id"), "piece", "score", "is_special")


def seed_scores(spark: SparkSession, sf: str) -> DataFrame:
    return S.seed_scores(docs(spark, sf).select(F.floor(F.col("doc_id") / 256).cast("int").alias("batch_id"), "text"))


def seed_window(spark: SparkSession, sf: str) -> DataFrame:
    scores = S.seed_scores(docs(spark, sf).select((F.col("doc_id") % 4).cast("int").alias("batch_id"), "text"))
    return S.window_scores(scores, 3).select(F.col("window_id").cast("long").alias("window_id"), "piece", "score")


def seed_topk(spark: SparkSession, sf: str) -> DataFrame:
    scores = S.seed_scores(docs(spark, sf).select(F.lit(0).alias("batch_id"), "text")).select("piece", "score")
    return S.induce(scores, 1391).select("piece", F.round("logp", 6).alias("logp"))


def blank_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return S.blank_inventory(spark).select("piece", F.length("piece").cast("long").alias("n_chars"))


def _seed_sql(batch: str) -> str:
    return f"""WITH t AS (SELECT {batch} AS batch_id, doc_id, ' ' || text AS text FROM documents),
x AS (SELECT batch_id, doc_id, string_split(regexp_replace(text, '(\\s+)(\\s\\S)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS xs FROM t),
y AS (SELECT batch_id, flatten(list_transform(xs, lambda s: regexp_extract_all(s, {_LETTERS}))) AS ps FROM x),
z AS (SELECT batch_id, unnest(ps) AS p, unnest(range(len(ps))) AS pos_ FROM y),
c AS (SELECT batch_id, p, pos_ = 0 AS first, count(*) AS n FROM z GROUP BY ALL),
s AS (SELECT batch_id, p, n, first, list_transform(range(0, length(p)), lambda j: strlen(substr(p, 2, j))) AS o, {mapped_sql('p')} AS m FROM c),
f AS (SELECT batch_id, m, n, CASE WHEN first THEN list_concat([0], o) ELSE o END AS o FROM s),
g AS (SELECT batch_id, m, n, unnest(list_filter(o, lambda v, i: (i - 1) % 4 = 0)) AS start FROM f),
h AS (SELECT batch_id, m, n, start, unnest(range(1, least(15, length(m) - start) + 1)) AS k FROM g WHERE start < length(m)),
q AS (SELECT batch_id, substr(m, start::BIGINT + 1, k::BIGINT) AS piece, n FROM h),
scores AS (SELECT batch_id, piece, sum(n * strlen(piece))::BIGINT AS score FROM q GROUP BY ALL)"""


def lang_shares(spark: SparkSession, sf: str) -> DataFrame:
    sizes = docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n_pages"))
    return R.language_shares(sizes, 0.3).select("lang", "n_pages", F.round("raw_share", 9).alias("raw_share"), F.round("share", 9).alias("share"))


def lang_quota(spark: SparkSession, sf: str) -> DataFrame:
    sizes = docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n_pages"))
    return B.split_quota(sizes, 150, 0.01).select("lang", "n_pages", F.col("n").cast("long").alias("n"), F.col("n_valid").cast("long").alias("n_valid"), F.col("n_train").cast("long").alias("n_train"))


def train_valid_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).select("doc_id", "lang")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n_pages"))
    return B.split_rows(rows, B.split_quota(sizes, 150, 0.05)).select("doc_id", "lang", "part")


def packed_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return B.pack(docs(spark, sf).withColumn("text", T.strip(F.col("text"))), 2048).select("lang", "doc_id", "unit", "unit_chars")


def fixed_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.fixed_batches(docs(spark, sf).select("doc_id", "lang"), 8)
    return rows.select("doc_id", "lang", F.col("batch").cast("long").alias("batch"), F.col("pos").cast("long").alias("pos"))


def block_chunks(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("at", "w"))
    ids = turns.select(F.pmod("conv_id", F.lit(10)).alias("shard"), "conv_id", "turn", "at", F.length("w").cast("long").alias("id"))
    out = B.blocks(ids, 64, ["conv_id", "turn", "at"], by=("shard",))
    return out.select("shard", F.col("block").cast("long").alias("block"), F.array_join("ids", ",").alias("ids"))


def pad_truncate(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", ids.alias("ids"))
    joined = lambda c: F.array_join(c, ",")
    return rows.select("conv_id", "turn", joined(B.pad(F.col("ids"), 16, 0)).alias("padded"), F.size(B.pad_to_multiple(F.col("ids"), 8, 0)).cast("long").alias("n_multiple"), joined(F.slice(B.with_bos(F.col("ids"), -7), 1, 5)).alias("with_bos"))


def shift_labels(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.posexplode(B.next_token_pairs(ids)).alias("pos", "x"))
    return rows.select("item_id", F.col("pos").cast("long").alias("pos"), F.col("x.input").cast("long").alias("input"), F.col("x.label").cast("long").alias("label"))


def epoch_order(spark: SparkSession, sf: str) -> DataFrame:
    order = B.seeded_order(seed=3, epoch=1)
    rows = numbered(docs(spark, sf).select("doc_id", "lang"), "r", order, ["lang"])
    return rows.select("doc_id", "lang", (F.col("r") + 1).cast("long").alias("pos"), F.pmod("r", F.lit(4)).cast("long").alias("worker"))


def weighted_lang_choice(spark: SparkSession, sf: str) -> DataFrame:
    sizes = docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n_pages"))
    steps = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("step"))
    return R.choose_language(steps, R.language_shares(sizes, 0.3), 5)


def negatives(spark: SparkSession, sf: str) -> DataFrame:
    vocab = docs(spark, sf).select(F.col("doc_id").alias("id"))
    positive = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return R.negatives(vocab, positive, 120, 5, [0, 1, 2])


def head_texts(spark: SparkSession, sf: str) -> DataFrame:
    return B.head_texts(docs(spark, sf).select("doc_id", "lang"), 10)


def merge_order(spark: SparkSession, sf: str) -> DataFrame:
    words = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.posexplode(F.split("text", " ")).alias("at", "w"))
    merges = words.where(F.length("w") > 1).select((F.col("item_id") * 100000 + F.col("at")).alias("rank"), F.substring("w", 1, 1).alias("left"), F.substring("w", 2, 1).alias("right"))
    return V.distinct_merges(merges).select(F.col("rank").cast("long").alias("rank"), "left", "right")


def union_later_wins(spark: SparkSession, sf: str) -> DataFrame:
    first = docs(spark, sf).select("doc_id", F.col("n_chars").alias("value"))
    second = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", (F.col("quality") * 10 + F.col("toxic")).cast("long").alias("value"))
    return V.later_wins([first, second], "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        pretoken_topk_by_lang, pretoken_letters, default_pretokens, bytelevel_pretokens, bytelevel_roundtrip, unescape_text, strip_nonempty, crop_span,
        dedupe_batch_texts, page_names, substring_prior, token_prior, alphabet_missing, special_overlap, special_placement, vocab_overlap, byte_vocab,
        seed_scores, seed_window, seed_topk, blank_inventory, lang_shares, lang_quota, train_valid_split, packed_sequences, fixed_batches, block_chunks,
        pad_truncate, shift_labels, epoch_order, weighted_lang_choice, negatives, head_texts, merge_order, union_later_wins,
    )
}

_ORDER = "md5(doc_id::VARCHAR || ':3:1'), doc_id"
_SIZES = "sizes AS (SELECT lang, count(*) AS n_pages FROM documents GROUP BY lang)"
_SHARES = "a AS (SELECT lang, n_pages, pow(n_pages / sum(n_pages) OVER (), 0.3) AS raw FROM sizes)"
_U5 = "('0x' || substr(md5({} || ':5'), 1, 13))::BIGINT / 4503599627370496.0"

SQL = {
    "pretoken_topk_by_lang": f"WITH p AS ({pretokens_sql('lang')}), c AS (SELECT lang, pretoken, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, pretoken) AS rank FROM c) SELECT lang, pretoken, n, rank FROM r WHERE rank <= 100",
    "pretoken_letters": f"SELECT pretoken, count(*) AS n FROM ({pretokens_sql(pieces=_LETTERS)}) GROUP BY pretoken",
    "default_pretokens": r"SELECT pretoken, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\s*\S+|\s+')) AS pretoken FROM documents) GROUP BY pretoken",
    "bytelevel_pretokens": f"WITH c AS (SELECT pretoken, count(*) AS n FROM ({pretokens_sql()}) GROUP BY pretoken), m AS (SELECT {mapped_sql('pretoken')} AS piece, n FROM c) SELECT piece, n, length(piece) AS n_chars, strlen(piece) AS n_octets, length(regexp_replace(piece, '[^ĠĊĉ]', '', 'g')) > 1 AS blank_run FROM m",
    "bytelevel_roundtrip": "SELECT lang, count(*) AS n, count(*) AS n_same, sum(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY lang",
    "unescape_text": r"SELECT page_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT page_id, replace(replace(replace(replace(html, '<', '\n\_'), '\t', chr(9)), '\n', chr(10)), '\_', '\') AS t FROM pages)",
    "strip_nonempty": "SELECT doc_id, length(s) AS n_chars, md5(s) AS digest FROM (SELECT doc_id, trim(' ' || text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM documents) WHERE length(s) > 0",
    "crop_span": "SELECT doc_id, md5(substr(text, 1, 512)) AS digest, length(substr(text, 1, 512)) AS n_chars FROM documents",
    "dedupe_batch_texts": "SELECT doc_id // 128 AS batch_id, count(*) AS n, count(DISTINCT text) AS n_kept FROM documents GROUP BY 1",
    "page_names": r"SELECT page_id, replace(regexp_replace(regexp_replace(url, '^.*/([^/]+)$', '\1'), '\.[^./]*$', ''), '/', '_') AS name FROM pages",
    "substring_prior": f"""WITH {_VOCAB_SQL}, m AS (SELECT {mapped_sql('pretoken')} AS t, n FROM c),
s AS (SELECT t, n, unnest(range(1, length(t) + 1)) AS pos_ FROM m), e AS (SELECT n, substr(t, pos_, k) AS piece FROM (SELECT t, n, pos_, unnest(range(1, least(48, length(t) - pos_ + 1) + 1)) AS k FROM s)),
o AS (SELECT piece, sum(n) AS n FROM e GROUP BY piece), j AS (SELECT id, v.piece, is_special, coalesce(n, 0)::BIGINT AS n FROM vocab v LEFT JOIN o USING (piece))
SELECT id, piece, n, round(CASE WHEN is_special THEN 0.0 ELSE ln((1 + n) / sum(1 + n) OVER ()) END, 6) AS logp FROM j""",
    "token_prior": f"""WITH {_VOCAB_SQL}, m AS (SELECT {mapped_sql('pretoken')} AS piece, n FROM c), j AS (SELECT id, is_special, coalesce(n, 0)::BIGINT AS n FROM vocab LEFT JOIN m USING (piece))
SELECT id, n, round(CASE WHEN is_special THEN 0.0 ELSE ln((1 + n) / sum(1 + n) OVER ()) END, 6) AS logp FROM j""",
    "alphabet_missing": f"WITH {_VOCAB_SQL} SELECT unnest(string_split('{_TABLE.replace(chr(39), chr(39) * 2)}', '')) AS piece EXCEPT SELECT piece FROM vocab",
    "special_overlap": f"WITH {_VOCAB_SQL} SELECT DISTINCT piece FROM vocab WHERE piece IN ('Ġthe', 'Ġde', '<s>', '<mask>')",
    "special_placement": f"""WITH {_VOCAB_SQL}, sp AS (SELECT * FROM (VALUES (0, '<s>'), (3, '<pad>'), (7, 'Ġthe'), (900, '<mask>')) AS x(ref, piece)),
o AS (SELECT piece, row_number() OVER (ORDER BY id) - 1 AS r FROM vocab WHERE NOT is_special AND piece NOT IN (SELECT piece FROM sp)),
n AS (SELECT count(*) AS n FROM o), f AS (SELECT piece, least(ref, (SELECT n FROM n) + row_number() OVER (ORDER BY ref) - 1) AS id FROM sp),
free AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS r FROM (SELECT unnest(range((SELECT n FROM n) + 4)) AS i) WHERE i NOT IN (SELECT id FROM f))
SELECT free.i AS id, piece, false AS is_special FROM o JOIN free USING (r) UNION ALL SELECT id, piece, true FROM f""",
    "vocab_overlap": f"""WITH p AS ({pretokens_sql('lang')}), c AS (SELECT lang, pretoken, count(*) AS n FROM p GROUP BY ALL),
r AS (SELECT lang, pretoken, row_number() OVER (PARTITION BY lang ORDER BY n DESC, pretoken) - 1 AS id FROM c)
SELECT t.id, t.pretoken AS piece, s.id AS source_id FROM r t LEFT JOIN r s ON s.lang = 'en' AND s.pretoken = t.pretoken AND s.id < 300 WHERE t.lang = 'fr' AND t.id < 300""",
    "byte_vocab": f"""WITH c AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE length(w) > 1 GROUP BY w),
t AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) + 1 AS id FROM c QUALIFY id <= 151),
m AS (SELECT id, {mapped_sql("CASE WHEN id % 3 = 0 THEN w ELSE ' ' || w END")} AS piece FROM t),
v AS (SELECT id, piece, -id::DOUBLE AS score, false AS is_special FROM m UNION ALL SELECT * FROM (VALUES (0, '[CLS]', 0.0::DOUBLE, true), (1, '[SEP]', -1.0::DOUBLE, true))),
x AS (SELECT unnest(string_split('{_TABLE.replace(chr(39), chr(39) * 2)}', '')) AS piece EXCEPT SELECT piece FROM v)
SELECT * FROM v UNION ALL SELECT 151 + row_number() OVER (ORDER BY piece), piece, -100000.0::DOUBLE, false FROM x""",
    "seed_scores": _seed_sql("(doc_id // 256)::INT") + " SELECT * FROM scores",
    "seed_window": _seed_sql("(doc_id % 4)::INT") + ", w AS (SELECT unnest(range(batch_id, batch_id + 3)) AS window_id, piece, score FROM scores) SELECT window_id, piece, sum(score)::BIGINT AS score FROM w WHERE window_id BETWEEN 2 AND (SELECT max(batch_id) FROM scores) GROUP BY ALL",
    "seed_topk": _seed_sql("0") + f""", tot AS (SELECT sum(score) AS s, min(score) AS m FROM scores),
best AS (SELECT piece, score FROM scores WHERE length(piece) > 1 AND length(regexp_replace(piece, '[^ĠĊĉ]', '', 'g')) <= 1 ORDER BY score DESC, piece LIMIT 1000),
b AS (SELECT unnest(['Ġ', 'Ċ', 'ĉ']) AS c)
SELECT unnest(string_split('{_TABLE.replace(chr(39), chr(39) * 2)}', '')) AS piece, round(ln(m / s), 6) AS logp FROM tot
UNION ALL SELECT y.c || repeat(x.c, i), 0.0 FROM b x, b y, (SELECT unnest(range(1, 16)) AS i)
UNION ALL SELECT piece, round(ln(score / s), 6) FROM best, tot""",
    "blank_inventory": "WITH b AS (SELECT unnest(['Ġ', 'Ċ', 'ĉ']) AS c), r AS (SELECT y.c || repeat(x.c, i) AS piece FROM b x, b y, (SELECT unnest(range(1, 16)) AS i)) SELECT piece, length(piece) AS n_chars FROM r",
    "lang_shares": f"WITH {_SIZES}, {_SHARES} SELECT lang, n_pages, round(raw, 9) AS raw_share, round(raw / sum(raw) OVER (), 9) AS share FROM a",
    "lang_quota": f"WITH {_SIZES}, q AS (SELECT lang, n_pages, ceil(least(n_pages::DOUBLE, 151.5)) AS n FROM sizes), v AS (SELECT *, ceil(n / 1.01 * 0.01) AS nv FROM q) SELECT lang, n_pages, n::BIGINT AS n, nv::BIGINT AS n_valid, (n - nv)::BIGINT AS n_train FROM v",
    "train_valid_split": f"WITH {_SIZES}, q AS (SELECT lang, ceil(least(n_pages::DOUBLE, 157.5)) AS n FROM sizes), v AS (SELECT lang, n, ceil(n / 1.05 * 0.05) AS nv FROM q), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) SELECT doc_id, lang, CASE WHEN r <= nv THEN 'valid' ELSE 'train' END AS part FROM r JOIN v USING (lang) WHERE r <= n",
    "packed_sequences": """WITH RECURSIVE d AS (SELECT lang, doc_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':0:0'), doc_id) AS r FROM documents WHERE length(trim(text)) > 0),
w AS (SELECT lang, doc_id, r, 0::BIGINT AS unit, (n + 4)::BIGINT AS acc FROM d WHERE r = 1
  UNION ALL SELECT d.lang, d.doc_id, d.r, CASE WHEN w.acc >= 2048 THEN w.unit + 1 ELSE w.unit END, CASE WHEN w.acc >= 2048 THEN 0 ELSE w.acc END + d.n + 4 FROM w JOIN d ON d.lang = w.lang AND d.r = w.r + 1),
u AS (SELECT lang, unit, max(acc) - 4 AS unit_chars FROM w GROUP BY ALL HAVING max(acc) >= 2048)
SELECT lang, doc_id, unit, unit_chars FROM w JOIN u USING (lang, unit)""",
    "fixed_batches": "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, r // 8 AS batch, r % 8 AS pos FROM r WHERE r // 8 < n // 8",
    "block_chunks": """WITH s AS (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations), w AS (SELECT conv_id % 10 AS shard, conv_id, turn, unnest(range(len(ws))) AS pos_, unnest(ws) AS w FROM s),
r AS (SELECT shard, length(w) AS id, row_number() OVER (PARTITION BY shard ORDER BY conv_id, turn, pos_) - 1 AS r FROM w)
SELECT shard, r // 64 AS block, string_agg(id::VARCHAR, ',' ORDER BY r) AS ids FROM r GROUP BY ALL HAVING count(*) = 64""",
    "pad_truncate": """WITH s AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS x FROM conversations)
SELECT conv_id, turn, array_to_string(list_concat(x[1:16], list_transform(range(0, greatest(16 - len(x), 0)), lambda i: 0)), ',') AS padded,
  ((len(x) + 7) // 8 * 8)::BIGINT AS n_multiple, array_to_string(list_concat([-7], x[1:len(x) - 1])[1:5], ',') AS with_bos FROM s""",
    "shift_labels": "WITH s AS (SELECT item_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS x FROM benchmark) SELECT item_id, unnest(range(len(x) - 1)) AS pos, unnest(x[1:len(x) - 1]) AS input, unnest(x[2:]) AS label FROM s",
    "epoch_order": f"WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS pos FROM documents) SELECT doc_id, lang, pos, (pos - 1) % 4 AS worker FROM r",
    "weighted_lang_choice": f"""WITH {_SIZES}, {_SHARES}, s AS (SELECT lang, sum(raw / t) OVER (ORDER BY lang) AS hi, sum(raw / t) OVER (ORDER BY lang) - raw / t AS lo, row_number() OVER (ORDER BY lang DESC) AS last FROM a, (SELECT sum(raw) AS t FROM a)),
u AS (SELECT event_id AS step, {_U5.format("event_id::VARCHAR")} AS u FROM events) SELECT step, lang FROM u JOIN s ON u >= lo AND (u < hi OR last = 1)""",
    "negatives": "WITH p AS (SELECT DISTINCT doc_id AS id FROM labels WHERE toxic = 1 AND doc_id NOT IN (0, 1, 2)), n AS (SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT id FROM p) AND doc_id NOT IN (0, 1, 2) ORDER BY md5(doc_id::VARCHAR || ':5'), doc_id LIMIT (SELECT greatest(0, 120 - count(*)) FROM p)) SELECT id, true AS positive FROM p UNION ALL SELECT id, false FROM n",
    "head_texts": "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 10",
    "merge_order": """WITH s AS (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark), w AS (SELECT item_id * 100000 + unnest(range(len(ws))) AS r, unnest(ws) AS w FROM s),
f AS (SELECT substr(w, 1, 1) AS "left", substr(w, 2, 1) AS "right", min(r) AS r FROM w WHERE length(w) > 1 GROUP BY ALL) SELECT row_number() OVER (ORDER BY r) - 1 AS rank, "left", "right" FROM f""",
    "union_later_wins": "SELECT doc_id, coalesce(v, n_chars)::BIGINT AS value FROM documents FULL JOIN (SELECT doc_id, quality * 10 + toxic AS v FROM labels) USING (doc_id)",
}
