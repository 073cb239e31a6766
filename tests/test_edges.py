"""Every step on an empty and on a one-row table (FIXTURES: empty and one-row versions)."""

import pytest

from rillet import operators as op

SCHEMA = "k string, n long, v double, j string"
ROW = [("a", 1, 2.5, '{"x": 1}')]


@pytest.fixture(params=["empty", "one"])
def tiny(request, spark):
    return spark.createDataFrame([] if request.param == "empty" else ROW, SCHEMA), request.param


STEPS = {
    "select": lambda d: op.select_columns(d, "n, k"),
    "drop": lambda d: op.drop_columns(d, "v"),
    "filter": lambda d: op.filter_rows(d, "n > 0"),
    "nulls": lambda d: op.remove_nulls(d, "k"),
    "dedupe": lambda d: op.deduplicate(d, "k", "n"),
    "derive": lambda d: op.derive_columns(d, {"w": "v * 2"}),
    "join": lambda d: op.join(d, d.select("k", "v"), "k", "outer"),
    "cross": lambda d: op.cross_join(d, d.select("n")),
    "aggregate": lambda d: op.aggregate(d, "k", "v", "sum"),
    "multi": lambda d: op.aggregate_multiple(d, "k", [{"column": "v", "func": "mean", "output_column": "m"}]),
    "pivot": lambda d: op.pivot(d, "k", "n", "v", "sum", pivot_values=[1, 2]),
    "rank": lambda d: op.window_function(d, "rank", "k"),
    "rownum": lambda d: op.window_function(d, "row_number", "k", order_by="n"),
    "distributed": lambda d: op.row_numbers(d, "k", ["n"], method="distributed"),
    "global": lambda d: op.row_numbers(d, None, ["n"]),
    "union": lambda d: op.union_by_name(d, d.select("k")),
    "split": lambda d: op.split_records(d, 10, order_by=["n"]).routed,
    "route": lambda d: op.route_on_attribute(d, "k", {"a": "A"}).tagged,
    "dynamic": lambda d: op.dynamic_split(d, "k").routed,
    "replace": lambda d: op.replace_values(d, "k", "a", "b"),
    "regex": lambda d: op.replace_text(d, "k", "a", "b"),
    "minmax": lambda d: op.normalize_data(d, "v", "min_max"),
    "zscore": lambda d: op.normalize_data(d, "v", "z_score"),
    "mask": lambda d: op.data_masking(d, "k", "mask"),
    "json": lambda d: op.json_flatten(d, "j", schema="x bigint"),
    "fuzzy": lambda d: op.fuzzy_match(d, "k", d, "k", "m", threshold=80),
    "sql": lambda d: op.execute_sql(d, "SELECT count(*) AS c FROM {df}"),
    "quality": lambda d: op.quality_report(d, {"unique": ["k"], "no_nulls": ["n"]}),
    "lookup": lambda d: op.keyed_lookup(d, "k", "c"),
}


@pytest.mark.parametrize("name", sorted(STEPS))
def test_step_on_tiny_tables(tiny, name):
    df, kind = tiny
    out = STEPS[name](df).collect()
    if kind == "empty" and name not in ("sql", "quality", "union"):
        assert out == []
    if kind == "one" and name in ("select", "drop", "filter", "dedupe", "rank", "rownum", "distributed",
                                  "global", "split", "minmax", "fuzzy", "json"):
        assert len(out) == 1
