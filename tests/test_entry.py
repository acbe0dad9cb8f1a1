"""The driver contract."""

import __spark_entry__ as entry


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 40


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["query_id", "route", "answer", "sources"]
    assert {r.route for r in out.collect()} >= {"answer"}
