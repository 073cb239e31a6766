import os

import pytest
from pyspark.sql import functions as F

from rillet import operators as op
from rillet.operators.routing import write_routes
from rillet.session import scratch_path
from tests.fixtures import ROUTED, ROUTED_ROWS, frame


@pytest.fixture()
def routed(spark):
    return frame(spark, ROUTED, ROUTED_ROWS)


def _ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_route_on_attribute_outputs_and_rest_partition_input(routed):
    res = op.route_on_attribute(routed, "value", '{"value1": "one.csv", "value2": "two.csv"}')
    outs = res.outputs(["one.csv", "two.csv"])
    assert _ids(outs["one.csv"]) == [1, 6] and _ids(outs["two.csv"]) == [2]
    assert _ids(res.rest) == [3, 4, 5, 7]  # null continues
    assert sorted(_ids(res.routed) + _ids(res.rest)) == list(range(1, 8))


def test_route_numeric_column_compares_as_text(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "id long, n int")
    assert _ids(op.route_on_attribute(df, "n", {"2": "two"}).routed) == [1]


def test_conditional_split_first_match_and_null_verdict(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None), (4, 500)], "id long, v int")
    res = op.conditional_split(df, [{"condition": "v > 10", "output": "a"}, {"condition": "v > 100", "output": "b"}])
    assert _ids(res.outputs(["a"])["a"]) == [2, 4]
    assert _ids(res.rest) == [1, 3]


def test_branching_null_goes_false_and_nothing_continues(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id long, v int")
    res = op.branching(df, "v > 10")
    o = res.outputs(["true", "false"])
    assert _ids(o["true"]) == [2] and _ids(o["false"]) == [1, 3] and res.rest.count() == 0


def test_dynamic_split_names_and_null_rows(routed):
    res = op.dynamic_split(routed, "value", "p_")
    names = sorted(r.route for r in res.routed.select("route").distinct().collect())
    assert names == ["p_a_b", "p_c_d", "p_other", "p_value1", "p_value2"]
    assert res.routed.count() == 6 and res.rest.count() == 0


def test_split_records_exact_chunks(spark):
    df = spark.range(0, 2500).withColumn("g", F.col("id") % 7)
    res = op.split_records(df, 1000, order_by=["id"])
    sizes = {r.chunk: r["count"] for r in res.routed.groupBy("chunk").count().collect()}
    assert sizes == {1: 1000, 2: 1000, 3: 500}
    assert res.routed.where("chunk = 3").agg(F.min("id")).first()[0] == 2000
    assert res.rest.count() == 2500  # no condition: the whole table continues


def test_split_records_condition_rest(spark):
    df = spark.range(0, 100).withColumn("v", F.when(F.col("id") == 5, None).otherwise(F.col("id")))
    res = op.split_records(df, 30, condition="v >= 50", order_by=["id"])
    assert res.routed.count() == 50 and res.rest.count() == 50  # null verdict continues
    all_match = op.split_records(df, 30, condition="id >= 0", order_by=["id"])
    assert all_match.rest.count() == 100


def test_split_records_names_outputs(spark):
    res = op.split_records(spark.range(0, 25), 10, order_by=["id"], output_prefix="part_")
    assert sorted(res.outputs()) == ["part_1", "part_2", "part_3"]


def test_write_routes_one_directory_per_route(spark, routed):
    res = op.route_on_attribute(routed, "value", {"value1": "one", "value2": "two"})
    path = scratch_path(spark, "routes")
    write_routes(res.routed, path, fmt="csv")
    dirs = sorted(d for d in os.listdir(path.replace("file:", "")) if d.startswith("route="))
    assert dirs == ["route=one", "route=two"]


def test_outputs_listing_is_bounded(routed):
    from rillet.common import StepError

    res = op.dynamic_split(routed, "value", "p_")
    assert len(res.outputs()) == 5 and res.rest.columns == routed.columns
    with pytest.raises(StepError):
        res.outputs(max_outputs=3)


def test_write_routes_spreads_a_dominant_route(spark):
    df = spark.range(0, 4000).withColumn("v", F.when(F.col("id") < 3600, "hot").otherwise("cold"))
    res = op.route_on_attribute(df, "v", {"hot": "hot", "cold": "cold"})
    path = scratch_path(spark, "routes-skew").replace("file:", "")
    write_routes(res.routed, path, fmt="parquet")
    hot_files = [f for f in os.listdir(os.path.join(path, "route=hot")) if f.endswith(".parquet")]
    assert len(hot_files) >= 2  # the dominant route is written by several tasks
    assert spark.read.parquet(path).count() == 4000
