import hashlib
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillet import operators as op
from rillet.operators.columns import python_replacement
from tests.fixtures import JSON_ROWS, JSON_ROWS_ROWS, frame


def test_replace_values_casts_to_column_type(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "n long, s string")
    out = op.replace_values(df, "n", "2", "20")
    assert sorted((r.n or -1) for r in out.collect()) == [-1, 1, 20]
    assert op.replace_values(df, "n", "x", "20").where("n = 20").count() == 0
    assert op.replace_values(df, "n", None, "0").where("n = 0").count() == 1
    assert op.replace_values(df, "s", "a", "") .where("s = ''").count() == 1


def test_python_replacement_translation():
    assert python_replacement(r"<\1>") == "<$1>"
    assert python_replacement(r"\g<name>-\g<2>") == "${name}-$2"
    assert python_replacement("cost $5") == "cost \\$5"


def test_replace_text_group_reference_and_null(spark):
    df = spark.createDataFrame([("ab12cd345",), (None,)], "t string")
    out = [r.t for r in op.replace_text(df, "t", r"(\d+)", r"[\1]").collect()]
    assert "ab[12]cd[345]" in out and None in out
    want = pd.Series(["ab12cd345"]).str.replace(r"(\d+)", r"[\1]", regex=True)[0]
    assert want in out


def test_normalize_min_max_range_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (5.0, 5.0)], "a double, c double")
    out = op.normalize_data(df, "a, c", "min_max").collect()
    assert sorted(r.a for r in out) == [0.0, 0.5, 1.0]
    assert all(r.c is None for r in out)


def test_normalize_z_score_sample_sd_matches_pandas(spark):
    vals = [2.0, 4.0, 4.0, 5.0, 9.0]
    df = spark.createDataFrame([(v,) for v in vals], "a double")
    got = sorted(r.a for r in op.normalize_data(df, "a", "z_score").collect())
    s = pd.Series(vals)
    want = sorted(((s - s.mean()) / s.std()).tolist())
    assert all(math.isclose(x, y, rel_tol=1e-12) for x, y in zip(got, want))


def test_masking_hash_and_mask(spark):
    df = spark.createDataFrame([("alice", 42), (None, 7)], "name string, n long")
    out = op.data_masking(df, "name, n", "hash").collect()
    assert out[0].name == hashlib.sha256(b"alice").hexdigest()[:10]
    assert out[0].n == hashlib.sha256(b"42").hexdigest()[:10]
    assert out[1].name is None
    masked = op.data_masking(df, "name", "mask").collect()
    assert masked[0].name == "*****" and masked[1].name is None


def test_json_flatten_nested_array_missing(spark):
    df = frame(spark, JSON_ROWS, JSON_ROWS_ROWS)
    out = op.json_flatten(df, "payload", prefix="p")
    assert out.columns == ["id", "p_a", "p_b.c", "p_b.d"]
    got = {r.id: (r["p_a"], r["p_b.c"], r["p_b.d"]) for r in out.collect()}
    assert got[1] == (1, "x", [1, 2]) and got[2] == (2, None, None) and got[4] == (None, None, None)
    assert op.json_flatten(df, "payload").columns[1] == "payload_a"


def test_json_flatten_malformed_fails_unless_permissive(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": ')], "id long, j string")
    with pytest.raises(Exception):
        op.json_flatten(df, "j", schema="a bigint").collect()
    out = op.json_flatten(df, "j", schema="a bigint", mode="PERMISSIVE")
    assert sorted((r.j_a is None) for r in out.collect()) == [False, True]
    assert F is not None
