"""Every registered query against its DuckDB restatement (sf0.001), plus the entry."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as E
from shardwright.plans.queries import QUERIES

TABLES = ["documents", "conversations"]


def _norm(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck(sf0001):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf0001, t + '.parquet')}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, sf0001, name):
    df = E.queries()[name](spark, sf0001)
    rows = df.collect()
    sql = E.oracle_sql()[name]
    cur = duck.execute(sql)
    orows = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


def test_entry_runs(spark):
    out = E.entry(spark)
    rows = out.collect()
    assert rows and set(out.columns) >= {"split", "n_shards", "num_tokens", "dtype"}
