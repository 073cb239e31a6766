import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rillet import operators as op
from rillet.common import StepError


@pytest.fixture()
def skewed(spark):
    rnd = random.Random(7)
    data = []
    for i in range(3000):
        k = "hot" if i % 3 == 0 else (None if i % 97 == 0 else f"k{rnd.randrange(40)}")
        data.append((k, rnd.randrange(50), float(rnd.randrange(100)), i % 5))
    data += [("hot", 1, 1.0, 1)] * 30  # fully equal rows inside the hot group
    return spark.createDataFrame(data, "k string, o int, v double, w int")


def _reference(df, keys, order, value=None):
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    out = df.withColumn("rn", F.row_number().over(w).cast("bigint"))
    if value:
        out = out.withColumn("rs", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out


def _multiset(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_distributed_numbering_equals_window_with_hot_key(skewed):
    got = op.row_numbers(skewed, "k", ["o"], output="rn", value="v", sum_output="rs",
                         method="distributed", num_partitions=7)
    want = _reference(skewed, ["k"], ["o", "v", "w"], value="v")
    cols = ["k", "o", "v", "w", "rn", "rs"]
    assert _multiset(got, cols) == _multiset(want, cols)


def test_hot_group_is_spread_over_partitions(skewed):
    got = op.row_numbers(skewed, "k", ["o"], output="rn", method="distributed", num_partitions=6,
                         partition_column="part")
    # the range shuffle cuts the hot group (a third of the rows) across partitions
    per_part = got.where("k = 'hot'").groupBy("part").count().collect()
    hot = got.where("k = 'hot'").count()
    assert len(per_part) >= 2
    assert max(r["count"] for r in per_part) <= 0.75 * hot


def test_global_numbering_is_dense(skewed):
    got = op.row_numbers(skewed, None, ["o", "v"], output="rn", num_partitions=5)
    vals = sorted(r.rn for r in got.select("rn").collect())
    assert vals == list(range(1, skewed.count() + 1))


def test_auto_uses_window_when_bounded(skewed):
    a = op.row_numbers(skewed, "k", ["o"], output="rn")
    b = op.row_numbers(skewed, "k", ["o"], output="rn", method="distributed")
    cols = ["k", "o", "v", "w", "rn"]
    assert _multiset(a, cols) == _multiset(b, cols)


def test_window_function_rank_is_average_rank(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "p long")
    out = sorted((r.p, r.rank_result) for r in op.window_function(df, "rank", "p").collect()
                 if r.p is not None)
    assert out == [(1, 2.0), (1, 2.0), (1, 2.0), (2, 1.0)]
    assert op.window_function(df, "rank", "p").where("p is null").first().rank_result is None


def test_window_function_row_number_and_cumsum(spark):
    df = spark.createDataFrame([(3, 1), (3, 2), (3, 3), (5, 1), (None, 1)], "p long, t int")
    rn = {(r.p, r.t): r.row_number_result for r in op.window_function(df, "row_number", "p", order_by="t").collect()}
    assert rn[(3, 3)] == 3 and rn[(5, 1)] == 1 and rn[(None, 1)] is None
    cs = {(r.p, r.t): r.cs for r in op.window_function(df, "cumsum", "p", "cs", order_by="t").collect()}
    assert cs[(3, 3)] == 9 and cs[(5, 1)] == 5
    with pytest.raises(StepError):
        op.window_function(df, "row_number", "p")


@pytest.mark.parametrize("bound", [20, 50, 200])
def test_auto_splits_hot_keys_from_bounded_ones(skewed, bound):
    # bound 20 makes the null-key group (31 rows) hot as well
    got = op.row_numbers(skewed, "k", ["o"], output="rn", value="v", sum_output="rs", max_group_rows=bound)
    want = _reference(skewed, ["k"], ["o", "v", "w"], value="v")
    cols = ["k", "o", "v", "w", "rn", "rs"]
    assert _multiset(got, cols) == _multiset(want, cols)


def test_distributed_numbering_with_nan_keys_and_null_values(spark):
    from pyspark.sql import functions as F

    from rillet import operators as op

    df = spark.range(4000).select(F.lit(float("nan")).alias("k"), F.col("id"),
                                  F.when(F.col("id").between(100, 110), F.col("id")).alias("v"))
    got = op.row_numbers(df, "k", "id", value="v", sum_output="s", method="distributed", num_partitions=4)
    want = op.row_numbers(df, "k", "id", value="v", sum_output="s", method="window")
    cols = ["id", "row_number", "s"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(map(tuple, want.select(*cols).collect()), key=str)


def test_rank_of_hot_keys_orders_tie_groups_and_leaves_rows_in_place(spark):
    nan = float("nan")
    data = [(i % 3 if i % 10 else None, [0.0, -0.0, 2.5, nan, None, 7.0][i % 6], i) for i in range(600)]
    df = spark.createDataFrame(data, "k int, o double, i int")
    for ties in ("average", "min"):
        got = op.ordered_rank(df, "k", "o", output="r", ties=ties, max_group_rows=100)
        want = op.ordered_rank(df, "k", "o", output="r", ties=ties, method="window")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    got = op.ordered_rank(df, "k", "o", output="r", method="distributed")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Repartition" not in plan and got.count() == 600
