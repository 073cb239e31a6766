import pytest

from rillet import operators as op
from rillet.common import StepError


@pytest.fixture()
def checked(spark):
    return spark.createDataFrame([(1, "a", 1), (2, "a", None), (None, None, 3), (4, None, 4)],
                                 "column1 long, column2 string, c3 int")


def test_report_counts_every_rule(checked):
    rep = {(r.rule, r.column): r.violations for r in op.quality_report(
        checked, {"no_nulls": ["column1", "c3"], "unique": ["column2", "column1"]}).collect()}
    assert rep == {("no_nulls", "column1"): 1, ("no_nulls", "c3"): 1,
                   ("unique", "column2"): 2, ("unique", "column1"): 0}


def test_check_raises_with_all_failures_or_passes(checked):
    with pytest.raises(StepError, match="column1.*c3|c3.*column1"):
        op.data_quality_check(checked, '{"no_nulls": ["column1", "c3"]}')
    assert op.data_quality_check(checked, {"unique": ["column1"]}) is checked
    with pytest.raises(StepError):
        op.quality_report(checked, {"positive": ["column1"]})
