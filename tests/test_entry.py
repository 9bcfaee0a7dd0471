import __spark_entry__ as entry


def test_every_query_is_callable_and_oracles_have_queries():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) >= 60 and all(map(callable, queries.values()))


def test_entry(spark):
    out = entry.entry(spark)
    assert "alert_key" in out.columns and out.count() >= 0
