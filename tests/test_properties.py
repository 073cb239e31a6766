"""Properties from the test strategy: additive unions, length-preserving masks, ranges, balances."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from rillet import operators as op
from rillet.operators import usage
from rillet.catalog import runlog

D = "/root/testdata/sf0.001"


def test_union_row_count_is_additive(spark):
    c = spark.read.parquet(f"{D}/customer.parquet")
    s = spark.read.parquet(f"{D}/supplier.parquet")
    assert op.union_by_name(c, s, c).count() == 2 * c.count() + s.count()


def test_mask_keeps_length_and_hash_is_ten_hex(spark):
    c = spark.read.parquet(f"{D}/customer.parquet")
    m = op.data_masking(c, "c_name", "mask").select(F.length("c_name").alias("n"))
    assert [r.n for r in m.collect()] == [r.n for r in c.select(F.length("c_name").alias("n")).collect()]
    h = op.data_masking(c, "c_name", "hash")
    assert h.where(~F.col("c_name").rlike("^[0-9a-f]{10}$")).count() == 0


def test_min_max_in_unit_interval(spark):
    c = spark.read.parquet(f"{D}/customer.parquet")
    lo, hi = op.normalize_data(c, "c_acctbal", "min_max").agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    assert lo == 0.0 and hi == 1.0


def test_balance_is_sum_of_ledger_and_last_running_balance(spark):
    t = runlog(spark, D)
    led = usage.ledger(t["logs"], t["workflows"], t["transactions"])
    bal = {r.user_id: r.balance for r in usage.balances(led).collect()}
    run = usage.running_balance(led, method="distributed")
    last = run.groupBy("user_id").agg(F.max_by("balance_after", "seq").alias("b"))
    assert {r.user_id: r.b for r in last.collect()} == bal


def test_routers_and_splits_keep_every_row(spark):
    q = entry.queries()
    for key, table in (("R2_route_on_attribute", "orders"), ("R5_conditional_split", "events"),
                       ("R1_split_records", "orders"), ("R3_branching", "events")):
        assert q[key](spark, D).count() == spark.read.parquet(f"{D}/{table}.parquet").count()
