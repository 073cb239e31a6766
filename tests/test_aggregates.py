import pandas as pd
import pytest

from rillet import operators as op
from rillet.common import StepError
from tests.conftest import rows
from tests.fixtures import MEASURES, MEASURES_ROWS, frame


@pytest.fixture()
def measures(spark):
    return frame(spark, MEASURES, MEASURES_ROWS)


def test_null_keys_dropped_and_empty_sum_is_zero(measures):
    out = dict((r[0], r[1]) for r in op.aggregate(measures, "key1", "col1", "sum").collect())
    assert out == {"a": 4.0, "b": 0.0, "c": 2.0}


@pytest.mark.parametrize("func,pfunc", [("sum", "sum"), ("mean", "mean"), ("count", "count"),
                                         ("min", "min"), ("max", "max")])
def test_matches_pandas_groupby(measures, func, pfunc):
    pdf = pd.DataFrame(MEASURES_ROWS, columns=MEASURES.names)
    want = pdf.groupby(["key1", "key2"])["col1"].agg(pfunc).reset_index()
    got = op.aggregate(measures, "key1, key2", "col1", func).toPandas()
    m = want.merge(got, on=["key1", "key2"], suffixes=("_p", "_s"))
    assert len(m) == len(want) == len(got)
    assert all((pd.isna(a) and pd.isna(b)) or a == b for a, b in zip(m.col1_p, m.col1_s))


def test_aggregate_key_as_value_is_error(measures):
    with pytest.raises(StepError):
        op.aggregate(measures, "key1", "key1", "count")


def test_aggregate_multiple_same_column_twice(measures):
    out = op.aggregate_multiple(measures, "key1", '[{"column": "col1", "func": "sum", "output_column": "s"},'
                                                  ' {"column": "col1", "func": "max", "output_column": "m"}]')
    assert out.columns == ["key1", "s", "m"]
    assert ("a", 4.0, 3.0) in rows(out)


def test_pivot_absent_cell_is_null(measures):
    out = rows(op.pivot(measures, "key1", "key2", "col1", "count"))
    assert ("c", None, None) not in out  # key2 null row dropped entirely
    assert ("a", 2, 0) in out and ("b", None, 0) in out


def test_pivot_given_values_fix_columns(measures):
    out = op.pivot(measures, "key1", "key2", "col1", "sum", pivot_values=["x", "y", "q"])
    assert out.columns == ["key1", "x", "y", "q"]
