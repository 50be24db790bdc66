import __spark_entry__ as entry


def test_every_query_has_a_callable_and_oracles_name_queries():
    q = entry.queries()
    assert len(q) > 90 and all(map(callable, q.values()))
    assert set(entry.oracle_sql()) <= set(q)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
