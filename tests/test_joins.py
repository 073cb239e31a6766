import pytest
from pyspark.sql import functions as F

from rillet import operators as op
from rillet.common import StepError
from tests.conftest import rows


@pytest.fixture()
def left(spark):
    return spark.createDataFrame([("a", 1, "l1"), (None, 2, "l2"), ("b", 3, "l3")], "k string, n int, v string")


@pytest.fixture()
def right(spark):
    return spark.createDataFrame([("a", "r1"), (None, "r2"), ("c", "r3")], "k string, v string")


def test_inner_null_keys_match_and_suffixes(left, right):
    out = op.join(left, right, "k", "inner")
    assert out.columns == ["k", "n", "v_x", "v_y"]
    assert rows(out) == [("a", 1, "l1", "r1"), (None, 2, "l2", "r2")]


def test_left_right_outer(left, right):
    assert len(rows(op.join(left, right, "k", "left"))) == 3
    r = rows(op.join(left, right, "k", "right"))
    assert ("c", None, None, "r3") in r
    o = rows(op.join(left, right, "k", "outer"))
    assert {x[0] for x in o} == {"a", "b", "c", None} and len(o) == 4


def test_not_null_safe_option(left, right):
    assert op.join(left, right, "k", "inner", null_safe=False).count() == 1


def test_key_type_mismatch_is_error(spark, left):
    other = spark.createDataFrame([(1, "x")], "k int, w string")
    with pytest.raises(StepError):
        op.join(left, other, "k")


def test_enrich_brings_only_listed_columns(spark, left):
    look = spark.createDataFrame([("a", "x", "y")], "k string, want string, skip string")
    out = op.enrich_data(left, look, "k", "want")
    assert out.columns == ["k", "n", "v", "want"]
    assert out.count() == 3


def test_cross_join_bounded(spark, left, right):
    out = op.cross_join(left, right)
    assert out.count() == 9 and "v_x" in out.columns
    with pytest.raises(StepError):
        op.cross_join(left, right, max_right_rows=2)


def test_merge_records(spark, left, right):
    third = spark.createDataFrame([("a", 9.5)], "k string, score double")
    merged = op.merge_records([left, right, third], "merge", "k")
    assert merged.columns == ["k", "n", "v_x", "v_y", "score"]
    assert merged.count() == 4
    cat = op.merge_records([left, right], "concat")
    assert cat.count() == 6 and cat.where(F.col("n").isNull()).count() == 3
    with pytest.raises(StepError):
        op.merge_records([left], "zip")


def test_keyed_lookup_default_and_provider(spark, left):
    out = rows(op.keyed_lookup(left, "k", "c1"))
    assert ("a", 1, "l1", "c1_a") in out and (None, 2, "l2", None) in out
    calls = []

    def provider(keys):
        calls.append(keys.count())
        return keys.withColumn("c1", F.upper("k"))
    out2 = rows(op.keyed_lookup(left, "k", ["c1"], provider=provider))
    assert ("b", 3, "l3", "B") in out2 and calls == [2]


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_plain_equality_when_one_side_has_no_null_keys(spark, how):
    import rillet.operators.joins as J

    big = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4)], "k string, n int")
    small = spark.createDataFrame([("a", "x"), ("c", "y")], "k string, w string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # take the probed (shuffle) path
    try:
        got = rows(op.join(big, small, "k", how, probe=True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    orig = J._has_null_key
    try:
        J._has_null_key = lambda df, keys: True  # force the null-safe plan
        want = rows(op.join(big, small, "k", how, probe=True))
    finally:
        J._has_null_key = orig
    assert got == want


def test_batched_provider_asks_in_batches_and_tries_again(spark, tmp_path):
    seen = str(tmp_path)

    def fetch(keys):
        import os

        mark = os.path.join(seen, f"{min(keys)}")
        assert len(keys) <= 7
        if not os.path.exists(mark):  # the first call for these keys fails
            open(mark, "w").close()
            raise OSError("busy")
        return {k: {"name": f"n{k}", "size": k} for k in keys if k % 2}

    df = spark.createDataFrame([(k % 40, i) for i, k in enumerate(range(200))] + [(None, 999)], "`k.y` bigint, size int")
    got = op.keyed_lookup(df, "k.y", "name, size", op.batched_provider(fetch, {"name": "string", "size": "bigint"}, 7, pause=0.01))
    assert got.columns == ["k.y", "name", "size"] and got.count() == 201
    assert {(r["k.y"], r.name, r.size) for r in got.collect()} == {
        *[(k, f"n{k}" if k % 2 else None, k if k % 2 else None) for k in range(40)], (None, None, None)}

    def broken(keys):
        raise OSError("gone")

    with pytest.raises(Exception, match="gone"):
        op.keyed_lookup(df, "k.y", "name", op.batched_provider(broken, {"name": "string"}, attempts=2, pause=0.01)).collect()
