import datetime as dt
import random
from decimal import Decimal

import pytest

from rillet.operators import quota, usage


@pytest.fixture()
def runlog(spark):
    users = spark.createDataFrame([("u1", "a@x", False, Decimal("5")), ("u2", "b@x", True, Decimal("1")),
                                   ("u3", "c@x", False, Decimal("0"))],
                                  "id string, email string, is_subscribed boolean, balance decimal(18,6)")
    workflows = spark.createDataFrame([("w1", "u1", "one", "Completed"), ("w2", "u2", "two", "Failed")],
                                      "id string, user_id string, name string, status string")
    t = dt.datetime
    logs = spark.createDataFrame([
        ("l1", "w1", t(2024, 1, 1, 23, 59, 59), "Success", 600, Decimal("0")),
        ("l2", "w1", t(2024, 1, 2, 0, 0, 0), "Success", 400, Decimal("0")),
        ("l3", "w1", t(2024, 1, 1, 10, 0, 0), "Success", 400, Decimal("0")),
        ("l4", "w1", t(2024, 1, 1, 11, 0, 0), "Failed", 999, Decimal("0")),
        ("l5", "w2", t(2024, 1, 1, 11, 0, 0), "Success", 2500, Decimal("0.025")),
        ("l6", "w2", t(2024, 1, 1, 11, 0, 0), "Success", 0, Decimal("0"))],
        "id string, workflow_id string, timestamp timestamp, status string, rows_processed long, cost decimal(18,6)")
    tx = spark.createDataFrame([("t1", "u2", t(2024, 1, 1, 9, 0, 0), Decimal("10"), "deposit", "in")],
                               "id string, user_id string, timestamp timestamp, amount decimal(18,6), "
                               "type string, description string")
    return users, workflows, logs, tx


def test_daily_usage_splits_at_midnight_and_skips_failures(runlog):
    users, wf, logs, _ = runlog
    got = {(r.user_id, str(r.day)): r.rows_used for r in usage.daily_usage(logs, wf).collect()}
    assert got == {("u1", "2024-01-01"): 1000, ("u1", "2024-01-02"): 400, ("u2", "2024-01-01"): 2500}


REQUEST = "user_id string, day date, timestamp timestamp, id string, rows_requested long, succeeds boolean"


def requested(spark, rows):
    return spark.createDataFrame([(u, dt.date(2024, 1, d), dt.datetime(2024, 1, d, 0, 0, t), i, n, ok)
                                  for u, d, t, i, n, ok in rows], REQUEST)


def test_quota_counts_what_was_used_before(spark, runlog):
    req = requested(spark, [
        ("u1", 2, 1, "a", 600, True), ("u1", 2, 2, "b", 401, True),  # refused: it uses nothing
        ("u1", 2, 3, "c", 400, True), ("u1", 2, 4, "d", 1, True), ("u1", 3, 0, "e", 1000, True),
        ("u2", 1, 1, "f", 10**6, True), ("u2", 1, 2, "g", 10**6, True),  # subscribed
        ("u3", 1, 1, "h", 900, False), ("u3", 1, 2, "i", 1000, True), ("u3", 1, 3, "j", 0, True),  # failed runs use nothing
        ("u9", 1, 1, "k", 1001, True), (None, 1, 1, "l", None, None)])
    for parts in (1, 3, 40):
        got = {r.id: (r.rows_used, r.allowed) for r in usage.quota_check(req, runlog[0], num_partitions=parts).collect()}
        assert got == {"a": (0, True), "b": (600, False), "c": (600, True), "d": (1000, False), "e": (0, True),
                       "f": (0, True), "g": (10**6, True), "h": (0, True), "i": (0, True), "j": (1000, True),
                       "k": (0, False), "l": (0, True)}
    assert usage.quota_check(req.limit(0), runlog[0]).count() == 0


def test_quota_of_a_hot_user_is_spread_over_tasks(spark, runlog):
    rng = random.Random(5)
    rows = [(rng.choice(["u1", "u1", "u1", "u2", "u3"]), 1, rng.randrange(60), f"r{i:05}", rng.choice([0, 1, 3, 30, 300, 999, 1001]),
             rng.random() < 0.8) for i in range(6000)]
    used, want, free = {}, {}, {"u2"}
    for u, _, _, i, n, ok in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        before = used.get(u, 0)
        allowed = u in free or before + n <= 1000
        want[i] = (before, allowed)
        used[u] = before + (n if allowed and ok else 0)
    got = usage.quota_check(requested(spark, rows), runlog[0], num_partitions=24)
    assert {r.id: (r.rows_used, r.allowed) for r in got.collect()} == want


def test_usage_maps_compose():
    rng = random.Random(6)
    for _ in range(200):
        limit = rng.choice([0, 1, 20, 1000, None])
        runs = [(rng.choice([0, 1, 2, 7, 19, 21, 400]), rng.random() < 0.8) for _ in range(rng.randrange(30))]
        pieces = [(0, 0)]
        for n, ok in runs:
            pieces = quota.then(pieces, n, ok, limit)
        for start in range(0, (limit or 50) + 1, 1 if (limit or 50) < 100 else 37):
            used = start
            for n, ok in runs:
                used = quota.verdict(used, n, ok, limit)[1]
            assert quota.apply_pieces(pieces, start) == used


def test_run_cost_rule(spark):
    df = spark.createDataFrame([(2500, True), (2500, False), (1, True), (0, True)], "rows long, sub boolean")
    got = [r.c for r in df.select(usage.run_cost("rows", "sub").alias("c")).collect()]
    assert got == [Decimal("0.025000"), Decimal("0"), Decimal("0.000010"), Decimal("0")]


def test_ledger_balance_and_running_balance(runlog):
    users, wf, logs, tx = runlog
    led = usage.ledger(logs, wf, tx)
    assert led.count() == 2  # one charge (cost > 0) and one deposit
    bal = {r.user_id: r.balance for r in usage.balances(led).collect()}
    assert bal == {"u2": Decimal("9.975")}
    run = usage.running_balance(led, method="distributed").orderBy("seq").collect()
    assert [r.balance_after for r in run] == [Decimal("10"), Decimal("9.975")]
    hist = usage.run_history(logs, "w1").collect()
    assert [r.id for r in hist] == ["l2", "l1", "l4", "l3"]
    assert usage.workflow_listing(wf, "u1").count() == 1
