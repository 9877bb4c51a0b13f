"""The registered queries on the smallest tables, against their SQL where there is some."""

import duckdb
import pytest

import __spark_entry__ as E
from shardwright.llm import oracle, queries

TABLES = "documents embeddings pages labels".split()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf0001, name):
    df = E.queries()[name](spark, sf0001)
    rows = df.collect()
    assert rows
    if name in oracle.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf0001}/{t}.parquet')")
        cur = con.execute(oracle.SQL[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(key, ([r[c] for c in cols] for r in rows))) == sorted(map(key, cur.fetchall()))
