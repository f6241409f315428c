import __spark_entry__ as entry


def test_flagship_and_names(spark):
    found = entry.entry(spark)
    assert found.count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
