import random

import pytest

from rillet import operators as op
from rillet.operators import fuzzy


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def brute(sources, refs, t):
    out = {}
    for s in set(x for x in sources if x):
        best = None
        for r in set(refs):
            d, m = lev(s, r), max(len(s), len(r))
            if 100 * (m - d) >= t * m and (best is None or (d, r) < best):
                best = (d, r)
        out[s] = best[1] if best else None
    return out


def words(rnd, n, alphabet="abcde", lo=0, hi=9):
    return [("".join(rnd.choice(alphabet) for _ in range(rnd.randint(lo, hi)))) for _ in range(n)]


@pytest.mark.parametrize("t", [95, 80, 70, 60, 50, 34, 10])
def test_threshold_mode_equals_brute_force(spark, t):
    rnd = random.Random(t)
    src, ref = words(rnd, 120), words(rnd, 80)
    df = spark.createDataFrame([(s,) for s in src] + [(None,)], "name string")
    rf = spark.createDataFrame([(r,) for r in ref], "ref string")
    got = {r.name: r.best for r in op.fuzzy_match(df, "name", rf, "ref", "best", threshold=t).collect()}
    want = brute(src, ref, t)
    for s in set(src):
        if s == "":
            assert got[s] == ""
        else:
            assert got[s] == want[s], (s, got[s], want[s])
    assert got[None] is None


@pytest.mark.parametrize(("alphabet", "hi"), [("abcde", 9), ("ab", 40), ("aé漢b", 7)])
def test_nearest_mode_equals_brute_force(spark, alphabet, hi):
    rnd = random.Random(hi)
    src, ref = words(rnd, 60, alphabet, 1, hi), words(rnd, 40, alphabet, 0, hi)
    df = spark.createDataFrame([(s, 1, 2) for s in src] + [(None, 1, 2), ("", 1, 2)], "`na.me` string, r int, d int")
    rf = spark.createDataFrame([(r, "x") for r in ref] + [(None, "x")], "ref string, s string")
    out = op.fuzzy_match(df, "na.me", rf, "ref", "best", on_miss="nearest")
    assert out.columns == ["na.me", "r", "d", "best"]
    got = {r["na.me"]: r.best for r in out.collect()}
    for s in src:
        assert got[s] == min(set(ref), key=lambda r: (lev(s, r), r))
    assert got[None] is None and got[""] == ""
    assert {r.best for r in op.fuzzy_match(df.where("`na.me` <> ''"), "na.me", rf.limit(0), "ref", "best",
                                           on_miss="nearest").collect()} == {None}


def test_nearest_mode_forms_few_pairs(spark):
    """Sources near to their references: the rounds stop early and the bands leave most pairs out."""
    rnd = random.Random(11)
    ref = sorted(set(words(rnd, 2000, "abcdefghij", 8, 30)))
    src = sorted({r[:4] + rnd.choice("xyz") + r[5:] for r in ref[:1000]})
    report = []
    found = fuzzy.nearest_matches(spark.createDataFrame([(x,) for x in src], "x string"),
                                  spark.createDataFrame([(x,) for x in ref], "x string"), report)
    assert {r.d for r in found.collect()} == {1} and found.count() == len(src)
    assert [r["distance"] for r in report] == [1] and report[0]["sources"] == len(src)
    assert report[0]["pairs"] < 0.01 * len(src) * len(ref)


def test_similarity_column_and_non_ascii(spark):
    df = spark.createDataFrame([("café",), ("cafe",)], "name string")
    rf = spark.createDataFrame([("cafe",), ("xyz",)], "ref string")
    out = {r.name: (r.best, r.sim) for r in op.fuzzy_match(df, "name", rf, "ref", "best", threshold=70,
                                                           similarity_column="sim").collect()}
    assert out["cafe"] == ("cafe", 100.0) and out["café"] == ("cafe", 75.0)


@pytest.mark.parametrize("t", [85, 60])
def test_threshold_mode_non_ascii_equals_brute_force(spark, t):
    rnd = random.Random(100 + t)
    src, ref = words(rnd, 80, alphabet="aé漢b", lo=1, hi=7), words(rnd, 60, alphabet="aé漢b", lo=1, hi=7)
    df = spark.createDataFrame([(s,) for s in src], "name string")
    rf = spark.createDataFrame([(r,) for r in ref], "ref string")
    got = {r.name: r.best for r in op.fuzzy_match(df, "name", rf, "ref", "best", threshold=t).collect()}
    want = brute(src, ref, t)
    assert all(got[s] == want[s] for s in set(src))
