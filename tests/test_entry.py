def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 50


def test_flagship(spark):
    import os

    import pytest

    import __spark_entry__ as e

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    assert e.entry(spark).columns == ["doc_id", "pos", "lit", "name"]
