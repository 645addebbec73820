import __spark_entry__ as entry


def test_contract(spark):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 20
    assert entry.entry(spark).limit(1).count() == 1
