"""Queries that encode with a vocabulary: best, n-best and longest-match segmentations, fitted and trained scores.

All run over the distinct pre-tokens of all documents. Scores are whole multiples of 1/1024, so that sums are exact in any
order and ties are ties.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.functions import text as T
from glyphmill.operators import counts as C
from glyphmill.operators import encode as E
from glyphmill.operators import fitting
from glyphmill.operators import suffixes as X
from glyphmill.operators import vocab as W
from glyphmill.plans.text_queries import _TABLE, mapped_sql, pretokens_sql
from glyphmill.session import materialise

#: Pieces of the vocabulary beside the bytes, and their length at most.
PIECES, LONGEST = 400, 6
#: Pieces of a trained vocabulary.
TRAINED = 8000


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    found = C.pretoken_counts(spark.read.parquet(f"{sf}/documents.parquet"))
    return materialise(found.select(T.to_byte_level(F.col("pretoken")).alias("pretoken"), "n"), "byte-pretokens")


def _scores(counts: DataFrame) -> dict[str, float]:
    """Scores of the most frequent short substrings and of all byte characters: a table of a stated size."""
    top = C.substrings(counts, LONGEST).orderBy(F.desc("n"), "piece").limit(PIECES).collect()
    total = sum(r.n for r in top)
    return {c: -20.0 for c in T.byte_alphabet().values()} | {r.piece: round(math.log(r.n / total) * 1024) / 1024 for r in top}


def viterbi_encode(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf)
    return E.encode(counts, _scores(counts)).select("pretoken", "n", F.array_join("pieces", " ").alias("pieces"))


def greedy_encode(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf)
    return E.longest_matches(counts, set(_scores(counts))).select("pretoken", "n", F.array_join("pieces", " ").alias("pieces"))


def _merges(counts: DataFrame) -> DataFrame:
    """Merges that build the pieces of ``_scores``: a table of a stated size."""
    pieces = C.substrings(counts, LONGEST).orderBy(F.desc("n"), "piece").limit(PIECES).select("piece")
    none = counts.sparkSession.createDataFrame([], "rank long, left string, right string")
    return W.repaired_merges(pieces, none)


def repaired_merges(spark: SparkSession, sf: str) -> DataFrame:
    return _merges(_counts(spark, sf))


def bpe_encode(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf)
    return E.merge_encoded(counts, _merges(counts)).select("pretoken", "n", F.array_join("pieces", " ").alias("pieces"))


def nbest(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf)
    return E.n_best(counts.select("pretoken"), _scores(counts), 4).select("pretoken", "rank", F.array_join("pieces", " ").alias("pieces"))


def nbest_rivals(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the four best segmentations of each pre-token differ from its longest match."""
    counts = _counts(spark, sf)
    scores = _scores(counts)
    wanted = E.longest_matches(counts.select("pretoken"), set(scores)).withColumnRenamed("pieces", "wanted")
    return E.rivals(E.n_best(wanted, scores, 4)).groupBy("pretoken").agg(F.count("*").alias("n_rivals"))


def encoded_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    """Surface ids, 5 at most, of the 2,000 most frequent pre-tokens as pieces of another vocabulary."""
    counts = _counts(spark, sf)
    scores = _scores(counts)
    number = F.row_number().over(Window.orderBy(F.desc("n"), "pretoken"))  # of 2,000 rows
    top = C.top_k(counts, 2000).select(number.alias("id"), F.col("pretoken").alias("piece"), F.lit(False).alias("is_special"))
    out = E.encoded_surfaces(top, scores, {p: i for i, p in enumerate(sorted(scores))}, 5, fill=-1)
    return out.select(F.col("id").cast("long").alias("id"), F.array_join("surface", ",").alias("surface"), "truncated")


def segmentation_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """The share of pre-tokens, by count, that the best segmentation cuts like the longest match does; blank pre-tokens
    have no wanted pieces and don't count."""
    counts = _counts(spark, sf)
    scores = _scores(counts)
    both = E.longest_matches(E.encode(counts, scores).withColumnRenamed("pieces", "found"), set(scores))
    wanted = F.filter("pieces", lambda p: F.length(F.translate(p, "ĠĊĉ", "")) > 0)
    return C.segmentation_accuracy(both.withColumn("wanted", wanted), F.col("pieces") == F.col("found"))


def fitted_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Unigram scores fitted so that the longest match beats its rivals among the four best of the start scores, over all
    distinct pre-tokens of all documents, weighted by count; gap is the proven share by which the objective may be above
    the optimum."""
    counts = _counts(spark, sf)
    scores = _scores(counts)
    mean = counts.agg(F.avg("n")).first()[0] or 1.0
    wanted = E.longest_matches(counts.withColumn("weight", F.col("n") / F.lit(mean)), set(scores)).withColumnRenamed("pieces", "wanted")
    names = sorted(scores)
    rows = materialise(fitting.differences(E.rivals(E.n_best(wanted, scores, 4)), {p: i for i, p in enumerate(names)}), "differences")
    start = np.array([scores[p] for p in names])
    fit = fitting.fit_scores(rows, start)
    gap = float((fit.objective - fit.bound) / fit.objective) if fit.objective else 0.0
    return spark.createDataFrame([(p, float(s), float(f), gap) for p, s, f in zip(names, start, fit.scores, strict=True)], "piece string, start double, fitted double, gap double")


def repeated_substrings(spark: SparkSession, sf: str) -> DataFrame:
    """The substrings of 2 to 16 characters that go on in different ways, with how often they occur."""
    return X.repeated_substrings(_counts(spark, sf))


def trained_unigram(spark: SparkSession, sf: str) -> DataFrame:
    """A unigram vocabulary of 8,000 pieces (fewer, if the texts have fewer) trained on the pre-tokens of all documents, from
    the 16,000 repeated substrings that cover the most."""
    counts = _counts(spark, sf)
    top = X.seed_pieces(counts, 2 * TRAINED).collect()
    total = sum(r.n * len(r.piece) for r in top)
    vocab = E.train_unigram(counts, {r.piece: math.log(r.n * len(r.piece) / total) for r in top}, TRAINED)
    return spark.createDataFrame(sorted(vocab.items()), "piece string, logp double")


QUERIES = {f.__name__: f for f in (repeated_substrings, repaired_merges, bpe_encode, viterbi_encode, greedy_encode, nbest, nbest_rivals, encoded_surfaces, segmentation_accuracy, fitted_scores, trained_unigram)}

_LIST = _TABLE.replace("'", "''")
_WITH = f"""WITH RECURSIVE c AS (SELECT {mapped_sql("pretoken")} AS t, n FROM (SELECT pretoken, count(*) AS n FROM ({pretokens_sql()}) GROUP BY pretoken)),
cut AS (SELECT n, substr(t, i, k) AS piece FROM (SELECT t, n, i, unnest(range(1, least({LONGEST}, length(t) - i + 1) + 1)) AS k FROM (SELECT t, n, unnest(range(1, length(t) + 1)) AS i FROM c))),
top AS (SELECT piece, sum(n) AS n FROM cut GROUP BY piece ORDER BY n DESC, piece LIMIT {PIECES}),
vocab AS (SELECT piece, round(ln(n / sum(n) OVER ()) * 1024) / 1024 AS s FROM top UNION ALL SELECT x, -20.0 FROM (SELECT unnest(string_split('{_LIST}', '')) AS x) WHERE x NOT IN (SELECT piece FROM top)),
held AS (SELECT map(list(piece), list(s)) AS mp FROM vocab)"""
_KNOWN = "list_filter(range(1, len(v) + 1), lambda k: mp[substr(t, i, k)] IS NOT NULL)"
_BEST = f"""best AS (SELECT t, length(t) AS i, [{{'s': 0.0::DOUBLE, 'm': 0::BIGINT}}] AS v, ['']::VARCHAR[] AS w FROM c
UNION ALL SELECT t, i - 1, list_concat([{{'s': x.s, 'm': x.m}}], v)[1:{LONGEST}], list_concat([substr(t, i, x.k) || ' ' || w[x.k]], w)[1:{LONGEST}]
FROM (SELECT t, i, v, w, list_max(list_transform({_KNOWN}, lambda k: {{'s': v[k].s + mp[substr(t, i, k)], 'm': v[k].m - 1, 'k': k}})) AS x FROM best, held WHERE i > 0))"""
_GREEDY = f"""greedy AS (SELECT t, 1 AS i, '' AS g FROM c UNION ALL SELECT t, i + k, g || substr(t, i, k) || ' '
FROM (SELECT t, i, g, coalesce(list_max(list_filter(range(1, {LONGEST} + 1), lambda k: i + k <= length(t) + 1 AND mp[substr(t, i, k)] IS NOT NULL)), 1) AS k FROM greedy, held WHERE i <= length(t)))"""
_NBEST = f"""nb AS (SELECT t, length(t) AS i, [[{{'s': 0.0::DOUBLE, 'm': 0::BIGINT, 'p': []::VARCHAR[]}}]] AS v FROM c
UNION ALL SELECT t, i - 1, list_concat([list_sort(flatten(list_transform({_KNOWN}, lambda k: list_transform(v[k], lambda x: {{'s': x.s - mp[substr(t, i, k)], 'm': x.m + 1, 'p': list_concat([substr(t, i, k)], x.p)}}))))[1:4]], v)[1:{LONGEST}]
FROM nb, held WHERE i > 0), each AS (SELECT t, unnest(v[1]) AS x, unnest(range(len(v[1]))) AS rank FROM nb WHERE i = 0)"""
_MERGES = """ends AS (SELECT piece[1:n] AS p, min(piece) AS of FROM (SELECT piece, unnest(range(2, length(piece) + 1)) AS n FROM top) GROUP BY ALL),
merges AS (SELECT row_number() OVER (ORDER BY of, length(p)) - 1 AS rank, p[1:length(p) - 1] AS l, p[length(p):] AS r FROM ends)"""
SQL = {
    "repeated_substrings": f"""WITH c AS (SELECT {mapped_sql("pretoken")} AS t, n FROM (SELECT pretoken, count(*) AS n FROM ({pretokens_sql()}) GROUP BY pretoken)),
cut AS (SELECT n, substr(t, i, k) AS piece, substr(t, i + k, 1) AS after FROM (SELECT t, n, i, unnest(range(1, least(16, length(t) - i + 1) + 1)) AS k FROM (SELECT t, n, unnest(range(1, length(t) + 1)) AS i FROM c)))
SELECT piece, sum(n)::BIGINT AS n FROM cut WHERE length(piece) > 1 GROUP BY piece HAVING min(after) < max(after)""",
    "repaired_merges": f'{_WITH}, {_MERGES} SELECT rank, l AS "left", r AS "right" FROM merges',
    "bpe_encode": f"""{_WITH}, {_MERGES}, ranks AS (SELECT map(list(l || ' ' || r), list(rank)) AS mr FROM merges),
bpe AS (SELECT t, string_split(t, '') AS v FROM c UNION ALL SELECT t, list_concat(v[1:x.i - 1], [v[x.i] || v[x.i + 1]], v[x.i + 2:])
FROM (SELECT t, v, list_min(list_filter(list_transform(range(1, len(v)), lambda i: {{'r': mr[v[i] || ' ' || v[i + 1]], 'i': i}}), lambda y: y.r IS NOT NULL)) AS x FROM bpe, ranks) WHERE x IS NOT NULL),
done AS (SELECT t, arg_min(v, len(v)) AS v FROM bpe GROUP BY t) SELECT t AS pretoken, n, array_to_string(v, ' ') AS pieces FROM done JOIN c USING (t)""",
    "viterbi_encode": f"{_WITH}, {_BEST} SELECT t AS pretoken, n, trim(w[1]) AS pieces FROM best JOIN c USING (t) WHERE i = 0",
    "greedy_encode": f"{_WITH}, {_GREEDY} SELECT t AS pretoken, n, trim(g) AS pieces FROM greedy JOIN c USING (t) WHERE i > length(t)",
    "nbest": f"{_WITH}, {_NBEST} SELECT t AS pretoken, rank, array_to_string(x.p, ' ') AS pieces FROM each",
    "nbest_rivals": f"{_WITH}, {_NBEST}, {_GREEDY} SELECT t AS pretoken, count(*) AS n_rivals FROM each JOIN greedy USING (t) WHERE greedy.i > length(t) AND trim(g) <> array_to_string(x.p, ' ') GROUP BY t",
    "encoded_surfaces": f"""{_WITH}, {_BEST}, named AS (SELECT map(list(piece), list(i)) AS ids FROM (SELECT piece, row_number() OVER (ORDER BY piece) - 1 AS i FROM vocab)),
ranked AS (SELECT t, row_number() OVER (ORDER BY n DESC, t) AS id FROM c QUALIFY id <= 2000), x AS (SELECT id, list_transform(string_split(trim(w[1]), ' '), lambda p: ids[p]) AS x FROM ranked JOIN best USING (t), named WHERE i = 0)
SELECT id, array_to_string(list_concat(x[1:5], list_transform(range(len(x), 5), lambda j: -1)), ',') AS surface, len(x) > 5 AS truncated FROM x""",
    "segmentation_accuracy": f"""{_WITH}, {_BEST}, {_GREEDY} SELECT sum(n) FILTER (WHERE w[1] = g) / sum(n) AS accuracy
FROM c JOIN best USING (t) JOIN greedy USING (t) WHERE best.i = 0 AND greedy.i > length(t) AND translate(t, 'ĠĊĉ', '') <> ''""",
}
