import math

import duckdb
import pytest

import __spark_entry__
from glyphmill.plans import corpus_queries, draw_queries, encode_queries, more_queries, source_queries, stream_queries, table_queries, text_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = text_queries.QUERIES | table_queries.QUERIES | more_queries.QUERIES | source_queries.QUERIES | encode_queries.QUERIES | corpus_queries.QUERIES | draw_queries.QUERIES | stream_queries.QUERIES
SQL = text_queries.SQL | table_queries.SQL | more_queries.SQL | source_queries.SQL | encode_queries.SQL | corpus_queries.SQL | draw_queries.SQL | stream_queries.SQL


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name not in SQL:
        assert got
        return
    result = con.execute(SQL[name])
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == columns
    assert got == sorted((tuple(plain(r[at[c]]) for c in columns) for r in result.fetchall()), key=repr)


def test_entry_registers_everything(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["lang", "pretoken", "n", "rank"]
