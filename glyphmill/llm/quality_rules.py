"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Two multinomials over hashed word n-grams stand against each other, one of texts that are trusted (labelled 1), one of
the whole raw corpus. A document's ratio is the mean over its n-grams, so its length doesn't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.linededup import may_hold
from glyphmill.llm.nativetext import WORD, words
from glyphmill.session import materialise

SYMBOL = r"[#*$%&|<>]"
#: Hash buckets of n-grams, the broadcast table's rows.
BUCKETS = 1 << 16
#: A document is kept if its mean log ratio is at least this (natural logarithm).
LEAST_RATIO = -0.13
#: Ratios are added up as whole multiples of this, so sums don't depend on their order.
_STEP = 2.0**-32
LEAST_WORDS = 50


def _zip3(words: str) -> Column:
    n = F.size(words)
    return F.arrays_zip(F.col(words).alias("a"), F.slice(words, F.lit(2), n).alias("b"), F.slice(words, F.lit(3), n).alias("c"))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed (and _w, the words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = lambda c: F.size(c).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    step = docs.withColumn("_w", words(text)).withColumn("_l", lines)
    step = step.withColumn("n_words", size("_w")).withColumn("_z", F.when(F.col("n_words") > 2, F.slice(_zip3("_w"), F.lit(1), F.size("_w") - 2)))
    step = step.withColumn("_k", F.transform("_z", lambda x: F.xxhash64(x["a"], x["b"], x["c"]))).drop("_z")
    some = F.col("_k").isNotNull() & (F.size(F.array_distinct("_k")) < F.size("_k"))
    step = step.withColumn("_s", F.when(some, F.sort_array(F.transform("_k", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    before = F.concat(F.array(F.lit(None).cast("struct<k:bigint,i:int>")), F.col("_s"))
    around = F.arrays_zip(F.col("_s").alias("x"), before.alias("p"), F.slice("_s", F.lit(2), F.size("_s")).alias("q"))
    found = F.filter(around, lambda r: r["x"].isNotNull() & (r["x"]["k"].eqNullSafe(r["p"]["k"]) | r["x"]["k"].eqNullSafe(r["q"]["k"])))
    step = step.withColumn("_at", F.sort_array(F.transform(found, lambda r: r["x"]["i"]))).drop("_s", "_k")
    gaps = F.arrays_zip(F.col("_at").alias("x"), F.slice("_at", F.lit(2), F.size("_at")).alias("q"))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, r: acc + F.coalesce(F.least(r["q"] - r["x"], F.lit(3)), F.lit(3)))
    return (
        step.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOL)).cast("long"))
        .withColumn("n_dup_lines", size("_l") - size(F.array_distinct("_l")))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("_l", "_at")
        .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def _pairs(words: Column) -> Column:
    """Each word with the next one, null after the last."""
    return F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"))


def _buckets(x: Column) -> list[Column]:
    """Buckets of the one-word and of the two-word n-gram; null for a word without a next one."""
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")
    return [bucket(x["a"]), F.when(x["b"].isNotNull(), bucket(x["a"], x["b"]))]


def _counts(texts: DataFrame, text_col: str) -> DataFrame:
    pairs = texts.select(words(F.col(text_col)).alias("w")).select(F.explode(_pairs(F.col("w"))).alias("x"))
    return pairs.select(F.explode(F.array(*_buckets(F.col("x")))).alias("bucket")).where("bucket is not null").groupBy("bucket").count()


def ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(bucket, r): the log ratio of trusted to raw probability of each bucket, in steps; the trusted multinomial has a
    Dirichlet prior of BUCKETS n-grams spread like the raw one, so that a few trusted texts don't condemn what they lack.

    Trusted are all documents labelled 1; the raw counts are over all documents. Without trusted words all ratios are 0. A bit
    table spares most other texts the shuffle that joins documents and labels.
    """
    key = lambda c: F.xxhash64(F.col(c).cast("string")).alias("_key")
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), key(id_col)).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), key(id_col))
    # ids are distinct; a semi-join would be moved below the bit table, and a broadcast would grow with the labels
    trusted = may_hold(texts, "_key", good).join(good.select("_id").hint("merge"), "_id")
    both = _counts(trusted, "_text").select("bucket", F.col("count").alias("t"), F.lit(0).cast("long").alias("o"))
    both = both.unionByName(_counts(docs, text_col).select("bucket", F.lit(0).cast("long").alias("t"), F.col("count").alias("o")))
    both = materialise(both.groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), "ngram-buckets")
    total = both.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("tt"), F.coalesce(F.sum("o"), F.lit(0)).alias("oo"))
    raw = F.try_divide("o", "oo")
    ratio = F.log((F.col("t") + BUCKETS * raw) / (F.col("tt") + BUCKETS)) - F.log(raw)
    return both.crossJoin(F.broadcast(total)).select("bucket", F.when(F.col("tt") > 0, F.round(ratio / _STEP)).otherwise(0).cast("long").alias("r"))


def judge(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_RATIO) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept): a row for each document.

    A null or empty text has no words and fails the base rules; its ratio is 0. Rows that repeat id and text get equal
    results; a null id is a value. Other columns are ignored, whatever their names; texts are read as a whole, and no
    text leaves its task.
    """
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pairs = F.when(F.size("_w") > 0, _pairs(F.col("_w")))
    # hashed before the words are exploded: beside a generator the whole text would be hashed again for each of its words
    own = with_statistics(source.withColumn("text_hash", F.xxhash64("text"))).select("doc_id", "text_hash", *stats, F.posexplode_outer(pairs).alias("i", "x"))
    one, two = _buckets(F.col("x"))
    own = own.withColumns({"one": one, "two": two}).drop("x")
    for name in ("one", "two"):
        own = own.join(F.broadcast(table.select(F.col("bucket").alias(name), F.col("r").alias(f"r_{name}"))), name, "left").drop(name)
    scored = own.groupBy("doc_id", "text_hash").agg(
        F.count(F.when(F.coalesce("i", F.lit(0)) == 0, 1)).cast("int").alias("rows"),
        F.sum(F.coalesce("r_one", F.lit(0)) + F.coalesce("r_two", F.lit(0))).alias("total"),
        (F.count("r_one") + F.count("r_two")).alias("n"),
        *[F.any_value(c).alias(c) for c in stats],
    )
    ratio = F.coalesce(F.try_divide(F.col("total") * _STEP, F.col("n")), F.lit(0.0))
    kept = ~F.col("base_failed") & (F.col("ratio") >= least)
    return scored.withColumn("ratio", ratio).select("doc_id", *stats, "ratio", kept.alias("kept"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_c")).drop("_c")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's digest, with the ratio as a further column."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, ratios(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
