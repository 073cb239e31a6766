import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rillet.common import StepError
from rillet.operators import usage
from rillet.session import scratch_path
from rillet.streaming import file_arrival_stream, run_available
from rillet.streaming.accounts import quota_stream, running_balance_stream
from rillet.streaming.windows import closed, event_windows, late_rows

DAY = dt.datetime(2024, 1, 1)


def delivered(spark, parts, step, schema):
    """Runs ``step`` over a folder that gets one part after the other, each in a run of its own; the last result."""
    folder, sink, checkpoint = (scratch_path(spark, x) for x in ("arriving", "given", "check"))
    for part in parts:
        part.write.mode("append").parquet(folder)
        run_available(step(file_arrival_stream(spark, folder, schema)), sink, checkpoint)
    return spark.read.parquet(sink), spark.read.parquet(folder)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def visits(spark):
    rng = random.Random(1)
    # times without a zone
    data = [(i, DAY + dt.timedelta(seconds=rng.randrange(i * 60, i * 60 + 900)), rng.choice(["a", "b", None]), rng.randrange(9))
            for i in range(400)]
    return spark.createDataFrame([*data, (999, None, "a", 1)], "id int, ts timestamp_ntz, k string, v int")


def test_tumbling_windows_over_several_runs_and_late_rows(spark, visits):
    late = (F.col("id") % 20 == 3) & (F.col("id") < 100)
    part = F.when(late, 2).otherwise(F.when(F.col("id") < 130, 0).when(F.col("id") < 260, 1).otherwise(2))
    parts = [visits.where(part == i) for i in range(3)]
    aggs = {"n": F.count(F.lit(1)), "total": F.sum("v")}

    def step(df):
        return event_windows(df, "ts", aggs, "k", size="10 minutes", delay="20 minutes")

    given, arrived = delivered(spark, parts, step, visits.schema)
    assert arrived.count() == 401
    in_time = visits.where(~late)
    want = closed(event_windows(in_time, "ts", aggs, "k", size="10 minutes"), visits, "ts", "20 minutes")
    assert rows(given) == rows(want) and given.count() > 50
    told = late_rows(given, arrived, "ts", "n", "k", size="10 minutes", delay="20 minutes")
    assert told.agg(F.sum("late")).first()[0] == visits.where(late).count() == 5
    with pytest.raises(StepError):
        event_windows(file_arrival_stream(spark, "/root/testdata/sf0.001", visits.schema), "ts", aggs, size="1 hour")


def test_sessions_over_several_runs(spark, visits):
    aggs = {"n": F.count(F.lit(1))}
    parts = [visits.where(F.col("id").between(a, b)) for a, b in ((0, 99), (100, 250), (251, 999))]

    def step(df):
        return event_windows(df, "ts", aggs, "k", gap="3 minutes", delay="40 minutes")

    given, _ = delivered(spark, parts, step, visits.schema)
    want = closed(event_windows(visits, "ts", aggs, "k", gap="3 minutes"), visits, "ts", "40 minutes")
    assert rows(given) == rows(want) and given.count() > 30


def test_quota_and_balance_across_restarts(spark):
    rng = random.Random(2)
    users = spark.createDataFrame([("u1", False), ("u2", True), ("u3", None)], "id string, is_subscribed boolean")
    data = []
    for i in range(600):
        at = DAY + dt.timedelta(minutes=i * 10)
        data.append((rng.choice(["u1", "u1", "u2", "u3", "u4"]), at.date(), at, f"r{i:04}", rng.choice([0, 5, 60, 400, 1001, None]),
                     rng.random() < 0.8, "more"))
    schema = "user_id string, day date, timestamp timestamp, id string, rows_requested long, succeeds boolean, note string"
    requests = spark.createDataFrame(data, schema)
    cut = [DAY + dt.timedelta(hours=h) for h in (0, 30, 31, 1000)]
    parts = [requests.where((F.col("timestamp") >= a) & (F.col("timestamp") < b)) for a, b in zip(cut, cut[1:])]
    want = rows(usage.quota_check(requests, users))
    for delay in (None, "2 hours"):
        given, _ = delivered(spark, parts, lambda df, d=delay: quota_stream(df, users, 1000, d), requests.schema)
        assert rows(given) == want

    ledger = requests.select("user_id", "id", "timestamp", (F.col("rows_requested") * Decimal("-0.000001")).cast("decimal(18,6)").alias("amount"))
    parts = [ledger.where((F.col("timestamp") >= a) & (F.col("timestamp") < b)) for a, b in zip(cut, cut[1:])]
    given, _ = delivered(spark, parts, running_balance_stream, ledger.schema)
    want = usage.running_balance(ledger.withColumn(
        "amount", F.coalesce("amount", F.lit(0).cast("decimal(18,6)"))))
    assert rows(given.select("user_id", "id", "seq", "balance_after")) == rows(want.select("user_id", "id", "seq", "balance_after"))


def test_state_of_many_users_is_met_in_buckets(spark):
    """Python is called for buckets of users, not for each of them; large ids beside nulls stay whole."""
    big = 2 ** 53 + 1
    data = [(big + i % 300 if i % 7 else None, DAY.date() if i % 5 else None, DAY + dt.timedelta(seconds=i), big + i,
             big if i % 3 == 0 else i % 500 if i % 11 else None, True) for i in range(900)]
    schema = "user_id long, day date, timestamp timestamp, id long, rows_requested long, succeeds boolean"
    requests = spark.createDataFrame(data, schema)
    users = spark.createDataFrame([(big + 3, True)], "id long, is_subscribed boolean")
    cut = [DAY + dt.timedelta(seconds=s) for s in (0, 200, 900)]
    parts = [requests.where((F.col("timestamp") >= a) & (F.col("timestamp") < b)) for a, b in zip(cut, cut[1:])]
    given, _ = delivered(spark, parts, lambda df: quota_stream(df, users, 1000, "2 days", buckets=4), requests.schema)
    assert rows(given) == rows(usage.quota_check(requests, users))

    ledger = requests.select("user_id", "id", "timestamp", F.lit(Decimal("1.5")).cast("decimal(18,6)").alias("amount"), "rows_requested")
    folder, sink, check = (scratch_path(spark, x) for x in ("arriving", "given", "check"))
    ledger.write.parquet(folder)
    run_available(running_balance_stream(file_arrival_stream(spark, folder, ledger.schema), buckets=4), sink, check)
    given = spark.read.parquet(sink)
    want = usage.running_balance(ledger)
    assert rows(given) == rows(want) and given.count() == 900
    states = spark.read.format("statestore").load(check)
    assert states.count() == 5  # four buckets and the null user
