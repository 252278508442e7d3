import __spark_entry__ as E


def test_entry_returns_profile(spark):
    rows = E.entry(spark).collect()
    assert rows and "name" in rows[0].asDict()


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
