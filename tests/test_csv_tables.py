"""CSV counts and raw fields over whole tables, against their SQL."""

import pytest


@pytest.mark.parametrize("name", ["csv_row_count_pages", "csv_token_row_count_pages", "csv_raw_documents"])
def test_csv_over_tables(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from bytesift.plans import registry

    d = "/root/testdata/sf0.001"
    got = registry.queries()[name](spark, d)
    db = duckdb.connect()
    for table in ("pages", "documents"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet'")
    cursor = db.execute(registry.oracle_sql()[name])
    assert [c[0] for c in cursor.description] == got.columns
    want = cursor.fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["csv_file_rows", "csv_file_fields", "csv_field_sizes", "filter_every_third", "find_truncated", "stream_find", "lut_all_bytes", "match_totals", "match_totals_wide", "generated_csv", "cost_model_plane", "cost_model_quadratic", "lag_correlation"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from bytesift.plans import registry

    d = "/root/testdata/sf0.001"
    got = registry.queries()[name](spark, d)
    db = duckdb.connect()
    for table in ("pages", "documents", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet'")
    cursor = db.execute(registry.oracle_sql()[name])
    order = [[c[0] for c in cursor.description].index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=str)


def test_sweep(spark, tmp_path):
    import json

    from bytesift.plans import sweep

    lines = list(sweep.scans(spark, str(tmp_path), 0.002, (1, 4), (0.1,)))
    assert [x["targets"] for x in lines] == [1, 4] and all(x["matches"] > 0 and x["gb_per_s"] > 0 for x in lines)
    (tmp_path / "out.json").write_text("\n".join(map(json.dumps, lines)))
    assert sweep.tabulate(spark, str(tmp_path / "out.json")).columns == ["density", "1", "4"]
    assert [x["columns"] for x in sweep.csv(spark, str(tmp_path), 0.001, (3,), (0.2,))] == [3]
