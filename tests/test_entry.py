import __spark_entry__ as entry
from rillet import catalog


def test_entry_runs_on_smoke_data(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["o_orderstatus", "l_returnflag", "sum_qty", "max_price", "n_lines"]


def test_every_query_has_an_oracle_or_is_listed():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 60
    assert set(catalog.QUERIES) - set(sql) == set()


def test_queries_run_on_smoke_data(spark):
    for key in ("P3_filter", "J4_outer_join", "A7_pivot", "R1_split_records", "J8_fuzzy_match", "M4_ledger"):
        assert entry.queries()[key](spark, "/root/testdata/sf0.001").count() >= 0
