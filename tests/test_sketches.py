import pytest
from pyspark.sql import functions as F

from rillet.common import StepError
from rillet.operators import sketches as sk
from rillet.session import scratch_path


def test_days_merged_are_within_the_stated_errors(spark):
    rows = spark.range(120_000).select(
        (F.col("id") % 6).alias("day"), (F.col("id") % 2).alias("kind"), (F.xxhash64("id") % 30_000).alias("user"),
        F.pow(F.rand(3), 3).alias("value"))
    path = scratch_path(spark, "sketches")
    for day in range(6):  # each day's rows are read once
        one = sk.sketch_table(rows.where(F.col("day") == day), "day, kind", {"users": "user"}, {"value": "value"})
        one.write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    assert table.count() == 12 - 6  # a day has rows of one kind
    rows = rows.cache()
    for by in ("kind", None):
        probabilities = [0.05, 0.5, 0.95]
        got = sk.read_sketches(sk.merge_sketches(table, by), probabilities).collect()
        for r in got:
            mine = rows.where(F.col("kind") == r["kind"]) if by else rows
            n, users = mine.agg(F.count(F.lit(1)), F.count_distinct("user")).first()
            assert r["n"] == n and abs(r["users_distinct"] - users) <= sk.DISTINCT_ERROR * users
            for p, value in zip(probabilities, r["value_quantiles"], strict=True):
                assert abs(mine.where(F.col("value") <= value).count() / n - p) <= sk.QUANTILE_ERROR + 1 / n
    rows.unpersist()


def test_nulls_and_empty_groups(spark):
    rows = spark.createDataFrame([("a", None, None), ("a", None, 2.0), ("b", None, None), (None, "x", 1.0)], "k string, u string, v double")
    table = sk.sketch_table(rows, "k", {"u": "u"}, {"v": "v"})
    got = {r["k"]: (r["n"], r["u_distinct"], r["v_quantiles"]) for r in sk.read_sketches(table, [0.5]).collect()}
    assert got == {"a": (2, 0, [2.0]), "b": (1, 0, [None]), None: (1, 1, [1.0])}
    assert sk.read_sketches(sk.merge_sketches(table), [0.5]).collect()[0]["v_quantiles"][0] in (1.0, 2.0)
    assert sk.sketch_table(rows.limit(0), "k", {"u": "u"}).count() == 0
    with pytest.raises(StepError):
        sk.sketch_table(rows, "k")
