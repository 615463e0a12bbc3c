"""The driver's contract."""

import __spark_entry__ as entry


def test_entry_has_rows_and_columns(spark):
    df = entry.entry(spark)
    assert df.columns == ["face", "i", "j", "n", "mean_value", "weight"]
    assert df.count() > 0


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
