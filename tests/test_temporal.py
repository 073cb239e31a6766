import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rillet import operators as op
from rillet.operators.temporal import Frame, asof_join, interval_join, last_before, moving_frames
from rillet.plans import physical_plan


@pytest.fixture(scope="module")
def events(spark):
    """A key with most of the rows, null keys and values, ties, helper names as columns."""
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(300), rng.choice([None, 1, 2, 3, 40]), i, "x")
            for i in range(900)]
    return spark.createDataFrame(rows, "k string, t int, v int, __off_n int, __at string").repartition(5)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


FRAMES = {"s": Frame("sum", "v", 3, 2), "m": Frame("max", "v", 5, 0), "n": Frame("count", "v", 0, 4), "f": Frame("first", "v", 2, 2),
          "back": Frame("lag", "v", 7, 0), "ahead": Frame("lead", "v", 0, 6)}


def test_frames_over_blocks_equal_the_window(events):
    want = rows(moving_frames(events, "k", ["t"], FRAMES, method="window"))
    for options in ({"method": "blocks", "block_rows": 20}, {"method": "blocks", "block_rows": 1}, {"max_group_rows": 200, "block_rows": 50}):
        assert rows(moving_frames(events, "k", ["t"], FRAMES, **options)) == want
    assert moving_frames(events.limit(0), "k", ["t"], FRAMES, method="blocks").count() == 0


def test_last_value_is_carried_across_parts(events):
    w = Window.partitionBy("k").orderBy("t", "__at", "__off_n", "v").rowsBetween(Window.unboundedPreceding, 0)
    want = rows(events.withColumn("last", F.last("v", ignorenulls=True).over(w)))
    order = ["t", "__at", "__off_n"]
    for options in ({"method": "window"}, {"method": "distributed", "num_partitions": 40}, {"max_group_rows": 200, "num_partitions": 9}):
        assert rows(last_before(events, "k", order, "v", "last", **options)) == want
    one = events.where("k = 'a'").withColumn("v", F.when(F.col("t") < 3, F.col("v")))
    w = Window.orderBy("t", "__at", "__off_n", "v").rowsBetween(Window.unboundedPreceding, 0)
    want = rows(one.withColumn("last", F.last("v", ignorenulls=True).over(w)))
    assert rows(last_before(one, None, order, "v", "last", num_partitions=30)) == want


def test_asof_join_by_brute_force(spark):
    rng = random.Random(8)
    day = dt.datetime(2024, 1, 1)
    times = [None, *[day + dt.timedelta(seconds=rng.randrange(400)) for _ in range(60)]]
    left = [(rng.choice(["h", "h", "h", "a", None]), rng.choice(times), i) for i in range(400)]
    right = [(rng.choice(["h", "h", "h", "a", "b", None]), rng.choice(times), i, f"p{i}") for i in range(150)]
    a = spark.createDataFrame(left, "k string, t2 timestamp, id int")
    b = spark.createDataFrame(right, "k string, time timestamp, id int, price string")
    want = []
    for k, t, i in left:
        found = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        best = max(found, key=lambda r: (r[1], r[2], r[3])) if found else (None,) * 4
        want.append((k, t, i, best[1], best[2], best[3]))
    for options in ({}, {"method": "distributed", "num_partitions": 25}, {"max_group_rows": 50, "num_partitions": 7}):
        got = asof_join(a, b, "k", "t2", "time", **options)
        assert got.columns == ["k", "t2", "id", "time", "id_y", "price"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert asof_join(a, b, "k", "t2", "time", "price", how="inner").count() == sum(w[3] is not None for w in want)
    assert asof_join(a, b.limit(0), "k", "t2", "time").where("price IS NULL").count() == 400


def test_interval_join_by_brute_force(spark):
    rng = random.Random(9)

    def interval():
        at = rng.choice([-5, 0, rng.randrange(1000)])
        return at, at + rng.choice([-1, 0, 1, 3, 10, 10, 50, 2000])

    left = [(i, rng.choice(["x", "y", None]), *interval()) for i in range(200)] + [(900, "x", None, 5), (901, "x", 5, None)]
    right = [(i, rng.choice(["x", "y", None]), *interval()) for i in range(200)]
    a = spark.createDataFrame(left, "id int, k string, lo int, hi int")
    b = spark.createDataFrame(right, "id int, k string, lo int, hi int")

    def overlap(p, q):
        return None not in (*p[2:], *q[2:]) and p[2] <= p[3] and q[2] <= q[3] and p[2] <= q[3] and q[2] <= p[3]

    joined = interval_join(a, b, ("lo", "hi"), ("lo", "hi"))
    assert joined.columns == ["id", "k", "lo", "hi", "id_y", "k_y", "lo_y", "hi_y"]
    assert sorted((r.id, r.id_y) for r in joined.collect()) == sorted((p[0], q[0]) for p in left for q in right if overlap(p, q))
    keyed = interval_join(a, b, ("lo", "hi"), ("lo", "hi"), "k")
    assert sorted((r.id, r.id_y) for r in keyed.collect()) == sorted(
        (p[0], q[0]) for p in left for q in right if overlap(p, q) and p[1] is not None and p[1] == q[1])
    plan = physical_plan(joined, "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert interval_join(a.limit(0), b, ("lo", "hi"), ("lo", "hi")).count() == 0


def test_numbers_and_sums_allow_columns_named_as_their_helpers(events):
    df = events.withColumnsRenamed({"v": "__off_s", "t": "__first"}).where("k IS NOT NULL")
    plain = op.row_numbers(df, "k", ["__first"], value="__off_s", method="window")
    assert rows(op.row_numbers(df, "k", ["__first"], value="__off_s", method="distributed", num_partitions=11)) == rows(plain)


def test_dynamic_split_keeps_columns_named_as_its_helpers(spark):
    df = spark.createDataFrame([("a/b", 1, 2), ("a_b", 3, 4), ("c", 5, 6)], "k string, __value int, __own int")
    out = op.dynamic_split(df, "k").routed
    assert out.columns == ["k", "__value", "__own", "route"]
    assert {(r["__value"], r["__own"]) for r in out.collect()} == {(1, 2), (3, 4), (5, 6)}
    assert len({r["route"] for r in out.collect()}) == 3


def test_interval_join_puts_intervals_on_their_own_level_only(spark):
    """Only starts are copied to other levels: short intervals do not meet each other again in the buckets of long ones."""
    a = spark.createDataFrame([(i, 10 * i, 10 * i + (4_000 if i % 50 == 0 else 15)) for i in range(300)], "x int, lo long, hi long")
    b = spark.createDataFrame([(i, 10 * i, 10 * i + (2_000 if i % 70 == 0 else 10)) for i in range(300)], "y int, lo2 long, hi2 long")
    got = interval_join(a, b, ("lo", "hi"), ("lo2", "hi2"))
    want = sorted((x.x, y.y) for x in a.collect() for y in b.collect() if x.lo <= y.hi2 and y.lo2 <= x.hi)
    assert sorted((r.x, r.y) for r in got.collect()) == want
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = interval_join(a, b, ("lo", "hi"), ("lo2", "hi2"))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert plan.count("Join Inner") == 2 and "greatest" not in plan
