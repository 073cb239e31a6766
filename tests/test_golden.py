"""Golden tests: the pandas call that defines each reference step, on the same fixture.

Intended differences (SQL null rules, per-row fuzzy semantics, key order) are kept out of
these fixtures or listed next to the assertion.
"""

import json
import math

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from rillet import operators as op
from rillet.plans import physical_plan


def _pdf(df):
    return df.toPandas()


def test_pivot_matches_pivot_table(spark):
    data = [("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", 2.0), ("b", "y", 5.0), ("b", "z", 7.0)]
    pdf = pd.DataFrame(data, columns=["i", "c", "v"])
    want = pd.pivot_table(pdf, index=["i"], columns=["c"], values=["v"], aggfunc="mean")
    want.columns = [c for _, c in want.columns]
    got = _pdf(op.pivot(spark.createDataFrame(pdf), "i", "c", "v", "mean")).set_index("i").sort_index()
    for col in want.columns:
        for i in want.index:
            a, b = want.loc[i, col], got.loc[i, col]
            assert (pd.isna(a) and pd.isna(b)) or math.isclose(a, b)


def test_window_rank_and_cumsum_match_pandas(spark):
    pdf = pd.DataFrame({"k": [3, 3, 1, 3, 1, 2], "t": [1, 2, 3, 4, 5, 6]})
    want_rank = pdf.groupby("k")["k"].rank()
    want_rn = pdf.groupby("k").cumcount() + 1
    want_cs = pdf.groupby("k")["k"].cumsum()
    df = spark.createDataFrame(pdf)
    rank = _pdf(op.window_function(df, "rank", "k")).set_index("t").sort_index()["rank_result"]
    rn = _pdf(op.window_function(df, "row_number", "k", order_by="t")).set_index("t").sort_index()
    cs = _pdf(op.window_function(df, "cumsum", "k", order_by="t")).set_index("t").sort_index()
    assert list(rank) == list(want_rank)
    assert list(rn["row_number_result"]) == list(want_rn)
    assert list(cs["cumsum_result"]) == list(want_cs)


def test_dedupe_matches_drop_duplicates_in_input_order(spark):
    pdf = pd.DataFrame({"k": ["a", "b", "a", None, None, "b"], "pos": range(6), "v": [1, 2, 3, 4, 5, 6]})
    want = pdf.drop_duplicates(subset=["k"]).sort_values("pos")
    got = _pdf(op.deduplicate(spark.createDataFrame(pdf), "k", order_by="pos")).sort_values("pos")
    assert list(got["pos"]) == list(want["pos"])


def test_json_flatten_matches_json_normalize(spark):
    docs = [{"a": 1, "b": {"c": "x", "d": {"e": 2.5}}}, {"a": 2, "b": {"c": "y"}}, {"f": [1, 2]}]
    pdf = pd.DataFrame({"id": [1, 2, 3], "j": [json.dumps(d) for d in docs]})
    want = pd.json_normalize([json.loads(x) for x in pdf["j"]])
    want.columns = [f"j_{c}" for c in want.columns]
    got = _pdf(op.json_flatten(spark.createDataFrame(pdf), "j")).sort_values("id").reset_index(drop=True)
    assert sorted(got.columns) == sorted(["id"] + list(want.columns))
    for col in want.columns:
        for a, b in zip(want[col], got[col]):
            if isinstance(a, list):
                assert list(b) == a
            else:
                assert (pd.isna(a) and (b is None or pd.isna(b))) or a == b


def test_remove_nulls_matches_dropna(spark):
    pdf = pd.DataFrame({"a": [1.0, None, 3.0, float("nan")], "b": ["x", "y", None, "z"]})
    want = pdf.dropna(subset=["a", "b"])
    got = _pdf(op.remove_nulls(spark.createDataFrame(pdf), "a, b"))
    assert len(got) == len(want) == 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["v1", "v2", "x", None]), st.integers(-5, 5)), max_size=40))
def test_routing_partitions_the_input(spark, data):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(data)], "id long, a string, b long")
    total = sorted(r.id for r in df.collect())
    res = op.conditional_split(df, [{"condition": "b > 0", "output": "pos"}, {"condition": "a = 'v1'", "output": "v1"}])
    got = sorted(r.id for r in res.routed.collect()) + sorted(r.id for r in res.rest.collect())
    assert sorted(got) == total
    res2 = op.route_on_attribute(df, "a", {"v1": "one", "v2": "two"})
    assert sorted([r.id for r in res2.routed.collect()] + [r.id for r in res2.rest.collect()]) == total


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 3)), max_size=30))
def test_dedupe_is_idempotent(spark, data):
    df = spark.createDataFrame(data, "k string, v long")
    once = op.deduplicate(df, "k", order_by="v")
    twice = op.deduplicate(once, "k", order_by="v")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    assert once.count() == len({k for k, _ in data})


def test_split_records_plan_has_no_single_partition(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    text = physical_plan(op.split_records(df, 100, order_by=["o_orderkey"]).routed, "simple")
    assert "SinglePartition" not in text


def test_ordered_rank_matches_pandas_rank(spark):
    pdf = pd.DataFrame({"k": ["a", "a", "a", "b", "b", "a", None, "b"], "o": [3, 1, 3, 2, 2, 5, 1, None],
                        "id": range(8)})
    df = spark.createDataFrame(pdf)
    for ties, pandas_method in (("average", "average"), ("min", "min")):
        want = pdf.groupby("k")["o"].rank(method=pandas_method)
        for how, bound in (("window", None), ("distributed", None), ("auto", 2)):
            extra = {"max_group_rows": bound} if bound else {}
            got = _pdf(op.ordered_rank(df, "k", "o", output="r", ties=ties, method=how, **extra))
            got = got.set_index("id").sort_index()["r"]
            assert [None if pd.isna(x) else x for x in got] == [None if pd.isna(x) else x for x in want]


def test_pivot_std_var_nunique_match_pandas(spark):
    data = [("a", "x", 1.0), ("a", "x", 3.0), ("a", "x", 3.0), ("a", "y", 2.0), ("b", "y", 5.0), ("b", "y", 7.0)]
    pdf = pd.DataFrame(data, columns=["i", "c", "v"])
    df = spark.createDataFrame(pdf)
    for func in ("std", "var", "nunique"):
        want = pd.pivot_table(pdf, index="i", columns="c", values="v", aggfunc=func)
        got = _pdf(op.pivot(df, "i", "c", "v", func)).set_index("i").sort_index()
        for col in want.columns:
            for i in want.index:
                a, b = want.loc[i, col], got.loc[i, col]
                assert (pd.isna(a) and pd.isna(b)) or math.isclose(a, b)


def test_apply_groups_salted_matches_groupby_with_hot_key(spark):
    from rillet import functions as uf

    pdf = pd.DataFrame({"k": ["hot"] * 300 + [f"k{i % 7}" for i in range(100)], "v": range(400)})
    want = pdf.groupby("k")["v"].agg(["size", "sum"]).reset_index()

    def partial(part):
        g = part.groupby("k")["v"]
        return pd.DataFrame({"n": g.size(), "s": g.sum()}).reset_index()

    from pyspark.sql import functions as F
    got = uf.apply_groups_salted(spark.createDataFrame(pdf), ["k"], partial, "k string, n long, s long",
                                 [F.sum("n").alias("size"), F.sum("s").alias("sum")]).toPandas()
    m = want.merge(got, on="k", suffixes=("_p", "_s"))
    assert len(m) == len(want) == len(got)
    assert (m.size_p == m.size_s).all() and (m.sum_p == m.sum_s).all()
