from collections import defaultdict
from pathlib import Path

from glyphmill.llm.tokencounts import RANKS, _encoder, answers, encoded_length, length_histogram, op5_token_counts, quantile_lengths, suffix_sums

SF = "/root/testdata/sf0.001"


def lengths(rows):
    enc = _encoder(Path(RANKS).read_bytes())
    out = defaultdict(list)
    for source, text in rows:
        n = len(enc.encode_ordinary(text or ""))
        out["source", source].append(n)
        out["all", None].append(n)
    return out


def test_query_matches_brute_force(spark):
    want = lengths([(r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    sums = op5_token_counts(spark, SF).cache()
    got = sums.collect()
    assert len(got) == sum(len(set(v)) for v in want.values())
    for r in got:
        v = want[r.scope, r.source]
        n = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (v.count(n), sum(x >= n for x in v), sum(x for x in v if x >= n))
        assert (r.tokens_total, r.truncated_total) == (sum(v), sum(min(x, n) for x in v)) and abs(r["quantile"] - sum(x <= n for x in v) / len(v)) < 1e-12
    limits = [0, 1, 100, 333, 10**6]
    for r in answers(sums, limits).collect():
        v = want[r.scope, r.source]
        assert (r.docs_over, r.truncated_total) == (sum(x > r.context_limit for x in v), sum(min(x, r.context_limit) for x in v))
    for r in quantile_lengths(sums, [0.5, 0.9, 1.0]).collect():
        v = sorted(want[r.scope, r.source])
        assert r.n_tokens == next(x for x in v if sum(y <= x for y in v) / len(v) >= r.q)


def test_edges(spark):
    rows = [(None, "a b"), (None, None), ("s", ""), ("s", "<|endoftext|> x"), ("s", "word " * 50000), ("s", "word " * 50000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "source string, text string, n_tokens int, scope string")
    want = lengths(rows)
    got = {(r.scope, r.source, r.n_tokens): r.n_docs for r in suffix_sums(length_histogram(df)).collect()}
    assert got == {(*k, n): v.count(n) for k, v in want.items() for n in v}
    assert suffix_sums(length_histogram(df.limit(0))).count() == 0


def test_long_blanks_are_encoded_like_any_text(spark):
    encoder = _encoder(Path(RANKS).read_bytes())
    for run in (" " * 9000, "\t" * 9000, "\n" * 9000, " \n" * 4000, "\u2003" * 3000, "\xa0 " * 2000):
        for text in (run, f"ab{run}", f"{run}ab", f"ab{run}cd {run}!", f"a{run}\x1c{run}1"):
            assert encoded_length(encoder, text) == len(encoder.encode_ordinary(text))
    rows = [("s", c * 1_000_000) for c in " \t\n"]
    got = length_histogram(spark.createDataFrame(rows, "source string, text string")).collect()
    assert sum(r.n_docs for r in got) == 3 and all(r.n_tokens > 0 for r in got)
