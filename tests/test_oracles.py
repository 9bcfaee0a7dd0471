"""Every query with SQL, on the smallest tables, against DuckDB."""

import math

import duckdb
import pytest

from palisade.jobs import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(tidy(r[c]) for c in sorted(columns)) for r in got.collect()), key=str)
    order = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted((tuple(tidy(r[k]) for k in order) for r in want.fetchall()), key=str)
