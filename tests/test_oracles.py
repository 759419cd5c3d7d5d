"""Every registered graph query against its SQL in a second engine, over the smallest test tables."""

import os

import pytest

from stratagraph import index_queries, queries, rule_queries, source_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations labels".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    return round(value, 6) if isinstance(value, float) else value


def rows(names, data):
    order = [names.index(n) for n in sorted(names)]
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def engine():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(RUN) == set(SQL)


REGISTRIES = (queries, source_queries, index_queries, rule_queries)
RUN = {k: f for r in REGISTRIES for k, f in r.queries().items()}
SQL = {k: f for r in REGISTRIES for k, f in r.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, engine, name):
    df = RUN[name](spark, FOLDER)
    found = engine.execute(SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in found.description], found.fetchall())
