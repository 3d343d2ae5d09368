import __spark_entry__ as entry


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert 0 <= row.recall_at_1 <= row.recall_at_5 <= row.recall_at_20 <= 1 and row.hit_at_10 == row.recall_at_10


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
