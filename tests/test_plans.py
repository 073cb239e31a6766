import pytest
from pyspark.sql import functions as F

from rillet import operators as op
from rillet.plans import chain, physical_plan

D = "/root/testdata/sf0.001"


@pytest.fixture()
def li(spark):
    return spark.read.parquet(f"{D}/lineitem.parquet")


def test_filter_and_projection_reach_the_scan(li):
    step = chain(lambda d: op.filter_rows(d, "l_quantity > 25"),
                 lambda d: op.select_columns(d, "l_orderkey, l_quantity"))
    plan = physical_plan(step(li))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,25.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_dedupe_limits_before_the_shuffle(li):
    plan = physical_plan(op.deduplicate(li, "l_partkey, l_suppkey", ["l_orderkey"]), "simple")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_no_single_partition_exchange(spark, li):
    c = spark.read.parquet(f"{D}/customer.parquet")
    for df in (op.normalize_data(c, "c_acctbal", "z_score"),
               op.window_function(c, "rank", "c_nationkey")):
        main = physical_plan(df, "simple").split("Subquery")[0]
        assert "SinglePartition" not in main


def test_column_steps_stay_in_the_jvm(spark):
    c = spark.read.parquet(f"{D}/customer.parquet")
    p = spark.read.parquet(f"{D}/part.parquet")
    plans = [op.replace_values(c, "c_mktsegment", "BUILDING", "B"),
             op.replace_text(c, "c_name", r"(\d+)", r"\1"),
             op.data_masking(c, "c_name", "hash"), op.data_masking(c, "c_name", "mask"),
             op.normalize_data(c, "c_acctbal", "min_max"),
             op.fuzzy_match(p, "p_name", p, "p_name", "m", threshold=80)]
    for df in plans:
        text = physical_plan(df, "simple")
        assert "EvalPython" not in text and "PythonUDF" not in text


def test_null_safe_join_is_a_hash_join(spark):
    o = spark.read.parquet(f"{D}/orders.parquet")
    c = spark.read.parquet(f"{D}/customer.parquet").withColumnRenamed("c_custkey", "o_custkey")
    # a broadcastable side stays null-safe (no probe job)
    small = physical_plan(op.join(o, c, "o_custkey"), "simple")
    assert "BroadcastHashJoin" in small and "isnull" in small
    # a side too large to broadcast, without null keys: the plain equi-join gives the same rows
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = physical_plan(op.join(o, c, "o_custkey", probe=True), "simple")
        assert "isnull(o_custkey" in physical_plan(op.join(o, c, "o_custkey"), "simple")  # lazy without the look
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plain and "isnull(o_custkey" not in plain
    # null keys on both sides: null-safe keys, still a hash join
    cn = c.withColumn("o_custkey", F.expr("nullif(o_custkey, 5)"))
    on = o.withColumn("o_custkey", F.expr("nullif(o_custkey, 5)"))
    text = physical_plan(op.join(on, cn, "o_custkey"), "simple")
    assert "HashJoin" in text and "isnull" in text


def test_filter_after_join_and_enrich_reaches_the_scan(spark):
    o = spark.read.parquet(f"{D}/orders.parquet")
    c = spark.read.parquet(f"{D}/customer.parquet").withColumnRenamed("c_custkey", "o_custkey")
    step = chain(lambda d: op.join(d, c, "o_custkey", "left"),
                 lambda d: op.replace_values(d, "o_orderpriority", "5-LOW", "low"),
                 lambda d: op.filter_rows(d, "o_orderstatus = 'F' AND c_acctbal > 0"),
                 lambda d: op.select_columns(d, "o_orderkey, c_name"))
    plan = physical_plan(step(o))
    assert "EqualTo(o_orderstatus,F)" in plan           # pushed through the join to the orders scan
    assert "GreaterThan(c_acctbal,0.0)" in plan          # and to the customer scan
    assert "o_orderpriority" not in plan.split("ReadSchema")[1].split("\n")[0]  # pruned column
