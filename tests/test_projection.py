import pytest
from pyspark.sql import functions as F

from rillet import operators as op
from rillet.common import StepError
from tests.conftest import rows
from tests.fixtures import NUMBERS, NUMBERS_ROWS, frame


@pytest.fixture()
def numbers(spark):
    return frame(spark, NUMBERS, NUMBERS_ROWS)


def test_select_keeps_listed_order_and_strips_blanks(numbers):
    out = op.select_columns(numbers, " column3 , column1")
    assert out.columns == ["column3", "column1"]


def test_select_missing_column_is_error(numbers):
    with pytest.raises(StepError):
        op.select_columns(numbers, "column1, nope")
    with pytest.raises(StepError):
        op.select_columns(numbers, "column1,,column2")


def test_drop_refuses_unknown_column(numbers):
    assert op.drop_columns(numbers, "column2").columns == ["column1", "column3"]
    with pytest.raises(StepError):
        op.drop_columns(numbers, "column9")


def test_filter_uses_sql_null_rules(numbers):
    assert sorted(r[0] for r in op.filter_rows(numbers, "column1 > 100").collect()) == [101, 150, 150, 250]
    # a null verdict drops the row unless null_as says otherwise
    assert op.filter_rows(numbers, "column1 != 100").count() == 5
    assert op.filter_rows(numbers, "column1 != 100", null_as=True).count() == 6


def test_remove_nulls_any_listed_column(numbers):
    out = op.remove_nulls(numbers, "column1, column3")
    assert out.count() == 5
    assert out.where(F.col("column1").isNull() | F.col("column3").isNull()).count() == 0


def test_deduplicate_keeps_first_by_order_and_null_keys_equal(spark):
    df = spark.createDataFrame([(None, 3, "c"), (None, 1, "a"), ("k", 2, "b"), ("k", 1, "z"), ("k", 1, "y")],
                               "k string, o int, v string")
    out = rows(op.deduplicate(df, "k", order_by="o"))
    assert out == [("k", 1, "y"), (None, 1, "a")]
    again = op.deduplicate(op.deduplicate(df, "k", order_by="o"), "k", order_by="o")
    assert rows(again) == out


def test_deduplicate_matches_pandas_on_full_rows(numbers):
    # pandas drop_duplicates on all columns: one of the two equal rows goes
    out = op.deduplicate(numbers, "column1, column2, column3")
    assert out.count() == len(NUMBERS_ROWS) - 1


def test_derive_columns(numbers):
    out = op.derive_columns(numbers, {"twice": "column1 * 2", "tag": F.lit("t")})
    assert ("twice" in out.columns) and ("tag" in out.columns)
    assert sorted(r.twice for r in out.collect() if r.twice is not None)[0] == 198


def test_execute_sql_bare_df_name_and_side_tables(spark, numbers):
    out = op.execute_sql(numbers, "SELECT column2, count(*) AS n FROM df WHERE column1 > 100 GROUP BY column2")
    got = {r.column2: r.n for r in out.collect()}
    assert got == {"a": 2, "d": 1, None: 1}
    side = spark.createDataFrame([("a", "alpha")], "column2 string, name string")
    joined = op.execute_sql(numbers, "SELECT d.column1, s.name FROM {df} d JOIN {s} s USING (column2)", s=side)
    assert sorted(r.column1 for r in joined.collect()) == [99, 150, 150]
