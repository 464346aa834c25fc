import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query_and_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["p1_grid", "p4_found", "predict_dieback", "min_cloud_ladder", "rasterize_labels", "class_metrics"])
def test_queries_agree_with_sql(spark, name):
    import os

    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("test data not here")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    sql = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr(tuple(r)) for r in sql.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want


def test_the_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0
