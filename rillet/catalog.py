"""Registered queries: one per operator of the inventory, with its DuckDB oracle.

Each query takes ``(spark, sf_dir)``, reads the given parquet tables whole
and returns a DataFrame.  ``ORACLE`` holds the equivalent SQL over views of
the same tables.  The test data has no nulls, so null keys are derived with
``nullif`` on both sides alike.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillet import functions as uf
from rillet import operators as op
from rillet.common import StepError
from rillet.operators import sketches, usage
from rillet.operators.quality import repeated_values
from rillet.operators.routing import write_routes
from rillet.plans import chain
from rillet.session import materialize, scratch_path
from rillet.sources import files
from rillet.streaming import (event_windows, file_arrival_stream, late_rows, quota_stream, run_available,
                              running_balance_stream, stream_filter)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(d, f"{name}.parquet"))


def query(key: str, sql: str | None):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


LI_REST = "l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

# ---------------------------------------------------------------- flagship


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """filter -> null-safe join -> multi-aggregate: revenue by order status and return flag."""
    li = op.filter_rows(_t(spark, d, "lineitem"), "l_quantity > 25")
    orders = _t(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    joined = op.join(li, orders, "l_orderkey", "inner")
    return op.aggregate_multiple(joined, "o_orderstatus, l_returnflag", [
        {"column": "l_quantity", "func": "sum", "output_column": "sum_qty"},
        {"column": "l_extendedprice", "func": "max", "output_column": "max_price"},
        {"column": "l_orderkey", "func": "count", "output_column": "n_lines"},
    ])


query("X0_flagship", """
SELECT o_orderstatus, l_returnflag, sum(l_quantity) AS sum_qty, max(l_extendedprice) AS max_price,
       count(l_orderkey) AS n_lines
FROM lineitem JOIN orders ON l_orderkey IS NOT DISTINCT FROM o_orderkey
WHERE l_quantity > 25 GROUP BY ALL""")(flagship)

# ---------------------------------------------------------------- projection / filter


@query("P1_select_columns", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def p1(spark, d):
    return op.select_columns(_t(spark, d, "lineitem"), "l_orderkey, l_partkey, l_quantity")


@query("P2_drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def p2(spark, d):
    return op.drop_columns(_t(spark, d, "orders"), ["o_totalprice", "o_orderpriority"])


@query("P3_filter", "SELECT * FROM lineitem WHERE l_quantity > 25")
def p3(spark, d):
    return op.filter_rows(_t(spark, d, "lineitem"), "l_quantity > 25")


@query("P4_remove_nulls", """
SELECT * FROM (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice
               FROM orders) WHERE o_orderstatus IS NOT NULL""")
def p4(spark, d):
    o = _t(spark, d, "orders").selectExpr("o_orderkey", "o_custkey",
                                          "nullif(o_orderstatus, 'P') AS o_orderstatus", "o_totalprice")
    return op.remove_nulls(o, "o_orderstatus")


@query("P5_deduplicate", f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey
    ORDER BY l_orderkey NULLS FIRST, l_linenumber NULLS FIRST, {', '.join(c + ' NULLS FIRST' for c in LI_REST.split(', '))}) AS rn
  FROM lineitem) WHERE rn = 1""")
def p5(spark, d):
    return op.deduplicate(_t(spark, d, "lineitem"), "l_partkey, l_suppkey", ["l_orderkey", "l_linenumber"])


@query("P6_derive_columns", """
SELECT *, l_extendedprice * (1 - l_discount) AS net, l_quantity >= 25 AS bulk FROM lineitem""")
def p6(spark, d):
    return op.derive_columns(_t(spark, d, "lineitem"), {
        "net": "l_extendedprice * (1 - l_discount)", "bulk": "l_quantity >= 25"})

# ---------------------------------------------------------------- joins


def _orders_f(spark, d):
    return _t(spark, d, "orders").selectExpr(
        "o_orderkey", "nullif(o_custkey, 5) AS custkey", "o_totalprice")


def _cust_b(spark, d):
    return _t(spark, d, "customer").selectExpr(  # moved by 40, so that both sides have keys of their own
        "nullif(c_custkey + 40, 45) AS custkey", "c_name", "c_acctbal")


_OF = "(SELECT o_orderkey, nullif(o_custkey, 5) AS custkey, o_totalprice FROM orders)"
_CB = "(SELECT nullif(c_custkey + 40, 45) AS custkey, c_name, c_acctbal FROM customer)"


@query("J1_inner_join", """
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
       c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment
FROM (SELECT * REPLACE (nullif(o_custkey, 5) AS o_custkey) FROM orders) o
JOIN (SELECT nullif(c_custkey, 5) AS o_custkey, * EXCLUDE (c_custkey) FROM customer) c
  ON o.o_custkey IS NOT DISTINCT FROM c.o_custkey""")
def j1(spark, d):
    o = _t(spark, d, "orders").withColumn("o_custkey", F.expr("nullif(o_custkey, 5)"))
    c = _t(spark, d, "customer").withColumn("c_custkey", F.expr("nullif(c_custkey, 5)")) \
        .withColumnRenamed("c_custkey", "o_custkey")
    return op.join(o, c, "o_custkey", "inner")


@query("J2_left_join", f"""
SELECT o.o_orderkey, o.custkey, o.o_totalprice, c.c_name, c.c_acctbal
FROM {_OF} o LEFT JOIN {_CB} c ON o.custkey IS NOT DISTINCT FROM c.custkey""")
def j2(spark, d):
    return op.join(_orders_f(spark, d), _cust_b(spark, d), "custkey", "left")


@query("J3_right_join", f"""
SELECT o.o_orderkey, c.custkey, o.o_totalprice, c.c_name, c.c_acctbal
FROM {_OF} o RIGHT JOIN {_CB} c ON o.custkey IS NOT DISTINCT FROM c.custkey""")
def j3(spark, d):
    return op.join(_orders_f(spark, d), _cust_b(spark, d), "custkey", "right")


@query("J4_outer_join", f"""
SELECT o.o_orderkey, coalesce(o.custkey, c.custkey) AS custkey, o.o_totalprice, c.c_name, c.c_acctbal
FROM {_OF} o FULL OUTER JOIN {_CB} c ON o.custkey IS NOT DISTINCT FROM c.custkey""")
def j4(spark, d):
    return op.join(_orders_f(spark, d), _cust_b(spark, d), "custkey", "outer")


@query("J5_enrich_data", """
SELECT l.*, p.p_name, p.p_brand FROM lineitem l
LEFT JOIN part p ON l.l_partkey IS NOT DISTINCT FROM p.p_partkey""")
def j5(spark, d):
    part = _t(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey")
    return op.enrich_data(_t(spark, d, "lineitem"), part, "l_partkey", "p_name, p_brand")


@query("J6_cross_join", "SELECT c.*, r.* FROM customer c CROSS JOIN region r")
def j6(spark, d):
    return op.cross_join(_t(spark, d, "customer"), _t(spark, d, "region"))


@query("J7_merge_records", """
WITH c AS (SELECT c_custkey + 40 AS custkey, c_name FROM customer),
     f AS (SELECT o_custkey AS custkey, count(*) AS n, round(sum(o_totalprice), 6) AS total
           FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
     o AS (SELECT o_custkey AS custkey, count(*) AS n, round(sum(o_totalprice), 6) AS total
           FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey),
     cf AS (SELECT coalesce(c.custkey, f.custkey) AS custkey, c.c_name, f.n, f.total
            FROM c FULL JOIN f ON c.custkey IS NOT DISTINCT FROM f.custkey)
SELECT coalesce(cf.custkey, o.custkey) AS custkey, cf.c_name, cf.n AS n_x, cf.total AS total_x,
       o.n AS n_y, o.total AS total_y
FROM cf FULL JOIN o ON cf.custkey IS NOT DISTINCT FROM o.custkey""")
def j7(spark, d):
    # three tables with one row per key (customers, and per-customer summaries of finished and
    # other orders): the n-way outer merge aligns them without multiplying rows
    c = _t(spark, d, "customer").selectExpr("c_custkey + 40 AS custkey", "c_name")
    o = _t(spark, d, "orders")

    def summary(condition):
        return (o.where(condition).groupBy(F.col("o_custkey").alias("custkey"))
                .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 6).alias("total")))
    return op.merge_records([c, summary("o_orderstatus = 'F'"), summary("o_orderstatus <> 'F'")], "merge", "custkey")


_FUZZY_REF = "translate(p_name, 'aeiou', 'eioua')"


@query("J8_fuzzy_match", f"""
WITH s AS (SELECT DISTINCT p_name AS src FROM part),
     r AS (SELECT DISTINCT {_FUZZY_REF} AS ref FROM part),
     pairs AS (SELECT src, ref, levenshtein(src, ref) AS d, greatest(length(src), length(ref)) AS m FROM s, r),
     ok AS (SELECT * FROM pairs WHERE 100 * (m - d) >= 70 * m),
     best AS (SELECT src, arg_min(ref, (d, ref)) AS ref FROM ok GROUP BY src)
SELECT p.*, CASE WHEN p.p_name = '' THEN '' ELSE best.ref END AS p_name_match
FROM part p LEFT JOIN best ON p.p_name = best.src""")
def j8(spark, d):
    part = _t(spark, d, "part")
    ref = part.select(F.expr(_FUZZY_REF).alias("name"))
    return op.fuzzy_match(part, "p_name", ref, "name", "p_name_match", threshold=70)


@query("J8b_fuzzy_nearest", f"""
WITH s AS (SELECT DISTINCT p_name AS src FROM part),
     r AS (SELECT DISTINCT {_FUZZY_REF} AS ref FROM part),
     best AS (SELECT src, arg_min(ref, (levenshtein(src, ref), ref)) AS ref, min(levenshtein(src, ref)) AS d FROM s, r GROUP BY src)
SELECT p_partkey, p_name, CASE WHEN p_name = '' THEN '' ELSE ref END AS nearest,
  100.0 * (1 - d / greatest(length(p_name), length(ref))) AS similarity FROM part LEFT JOIN best ON p_name = src""")
def j8b(spark, d):
    part = _t(spark, d, "part")
    ref = part.select(F.expr(_FUZZY_REF).alias("name"))
    return op.fuzzy_match(part.select("p_partkey", "p_name"), "p_name", ref, "name", "nearest", on_miss="nearest",
                          similarity_column="similarity")


@query("J9_keyed_lookup", """
SELECT *, 'segment_' || CAST(user_id AS VARCHAR) AS segment, 'tier_' || CAST(user_id AS VARCHAR) AS tier
FROM events""")
def j9(spark, d):
    return op.keyed_lookup(_t(spark, d, "events"), "user_id", "segment, tier")

@query("J9b_keyed_lookup_service", """
SELECT event_id, user_id, value, 'user ' || user_id || ' of group ' || user_id % 7 AS label,
  CASE WHEN user_id % 10 <> 3 THEN user_id * 11 END AS code FROM events""")
def j9b(spark, d):
    # a service asked for 50 distinct keys at a time; it knows nothing of every tenth user's code
    def fetch(keys):
        return {k: {"label": f"user {k} of group {k % 7}", **({"code": k * 11} if k % 10 != 3 else {})} for k in keys}
    ev = _t(spark, d, "events").select("event_id", "user_id", "value")
    return op.keyed_lookup(ev, "user_id", "label, code", op.batched_provider(fetch, {"label": "string", "code": "bigint"}, 50))


@query("J10_asof_join", """
WITH prices AS (SELECT user_id, ts AS seen_at, max(value) AS seen_value FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT e.event_id, e.user_id, e.ts, p.seen_at, p.seen_value
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') e
ASOF LEFT JOIN prices p ON e.user_id = p.user_id AND e.ts >= p.seen_at""")
def j10(spark, d):
    ev = _t(spark, d, "events")
    views = ev.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("seen_at")).agg(
        F.max("value").alias("seen_value"))
    buys = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return op.asof_join(buys, views, "user_id", "ts", "seen_at", max_group_rows=1000)


@query("J11_interval_join", """
WITH spans AS (SELECT event_id, event_type, user_id, ts AS lo, ts + to_seconds(CAST(floor(value * 20) AS BIGINT)) AS hi FROM events)
SELECT a.event_id, a.user_id, b.event_id AS error_id, b.user_id AS error_user
FROM spans a JOIN spans b ON a.lo <= b.hi AND b.lo <= a.hi AND a.event_type = 'purchase' AND b.event_type = 'error'""")
def j11(spark, d):
    spans = _t(spark, d, "events").selectExpr(
        "event_id", "event_type", "user_id", "ts AS lo", "ts + make_dt_interval(0, 0, 0, floor(value * 20)) AS hi")
    buys = spans.where("event_type = 'purchase'").select("event_id", "user_id", "lo", "hi")
    errors = spans.where("event_type = 'error'").selectExpr(
        "event_id AS error_id", "user_id AS error_user", "lo AS error_lo", "hi AS error_hi")
    joined = op.interval_join(buys, errors, ("lo", "hi"), ("error_lo", "error_hi"))
    return joined.select("event_id", "user_id", "error_id", "error_user")

# ---------------------------------------------------------------- aggregation


@query("A1_aggregate_sum", """
SELECT l_returnflag, l_linestatus, coalesce(sum(l_quantity), 0) AS l_quantity
FROM (SELECT nullif(l_returnflag, 'R') AS l_returnflag, l_linestatus, l_quantity FROM lineitem)
WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL""")
def a1(spark, d):
    li = _t(spark, d, "lineitem").withColumn("l_returnflag", F.expr("nullif(l_returnflag, 'R')"))
    return op.aggregate(li, "l_returnflag, l_linestatus", "l_quantity", "sum")


@query("A2_aggregate_mean", """
SELECT l_returnflag, round(avg(l_extendedprice), 6) AS l_extendedprice FROM lineitem GROUP BY ALL""")
def a2(spark, d):
    out = op.aggregate(_t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "mean")
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@query("A3_aggregate_count", """
SELECT o_orderpriority, count(o_custkey) AS o_custkey
FROM (SELECT o_orderpriority, nullif(o_custkey, 5) AS o_custkey FROM orders) GROUP BY ALL""")
def a3(spark, d):
    o = _t(spark, d, "orders").withColumn("o_custkey", F.expr("nullif(o_custkey, 5)"))
    return op.aggregate(o, "o_orderpriority", "o_custkey", "count")


@query("A4_aggregate_min", "SELECT l_linestatus, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL")
def a4(spark, d):
    return op.aggregate(_t(spark, d, "lineitem"), "l_linestatus", "l_shipdate", "min")


@query("A5_aggregate_max", "SELECT o_orderstatus, max(o_totalprice) AS o_totalprice FROM orders GROUP BY ALL")
def a5(spark, d):
    return op.aggregate(_t(spark, d, "orders"), "o_orderstatus", "o_totalprice", "max")


@query("A6_aggregate_multiple", """
SELECT l_returnflag, sum(l_quantity) AS sum_qty, max(l_quantity) AS max_qty,
       round(avg(l_discount), 6) AS avg_disc, count(l_orderkey) AS n_lines,
       min(l_extendedprice) AS min_price, max(l_tax) AS max_tax
FROM lineitem GROUP BY ALL""")
def a6(spark, d):
    out = op.aggregate_multiple(_t(spark, d, "lineitem"), "l_returnflag", [
        {"column": "l_quantity", "func": "sum", "output_column": "sum_qty"},
        {"column": "l_quantity", "func": "max", "output_column": "max_qty"},
        {"column": "l_discount", "func": "mean", "output_column": "avg_disc"},
        {"column": "l_orderkey", "func": "count", "output_column": "n_lines"},
        {"column": "l_extendedprice", "func": "min", "output_column": "min_price"},
        {"column": "l_tax", "func": "max", "output_column": "max_tax"},
    ])
    return out.withColumn("avg_disc", F.round("avg_disc", 6))


_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("A7_pivot", "SELECT o_orderstatus, " + ", ".join(
    f"nullif(count(CASE WHEN o_orderpriority = '{p}' THEN o_orderkey END), 0) AS \"{p}\"" for p in _PRIOS)
    + " FROM orders GROUP BY o_orderstatus")
def a7(spark, d):
    return op.pivot(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_orderkey", "count",
                    pivot_values=_PRIOS)


@query("A7c_pivot_std", "SELECT o_orderstatus, " + ", ".join(
    f"round(stddev_samp(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice END), 6) AS \"{p}\"" for p in _PRIOS)
    + " FROM orders GROUP BY o_orderstatus")
def a7c(spark, d):
    out = op.pivot(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", "std",
                   pivot_values=_PRIOS)
    return out.select("o_orderstatus", *[F.round(F.col(f"`{p}`"), 6).alias(p) for p in _PRIOS])


@query("A7b_pivot_two_keys_mean", """
SELECT l_linestatus,
  round(avg(CASE WHEN l_returnflag || '_' || CAST(l_quantity >= 25 AS VARCHAR) = 'A_true' THEN l_discount END), 6) AS "A_true",
  round(avg(CASE WHEN l_returnflag || '_' || CAST(l_quantity >= 25 AS VARCHAR) = 'A_false' THEN l_discount END), 6) AS "A_false",
  round(avg(CASE WHEN l_returnflag || '_' || CAST(l_quantity >= 25 AS VARCHAR) = 'N_true' THEN l_discount END), 6) AS "N_true",
  round(avg(CASE WHEN l_returnflag || '_' || CAST(l_quantity >= 25 AS VARCHAR) = 'N_false' THEN l_discount END), 6) AS "N_false",
  round(avg(CASE WHEN l_returnflag || '_' || CAST(l_quantity >= 25 AS VARCHAR) = 'R_true' THEN l_discount END), 6) AS "R_true",
  round(avg(CASE WHEN l_returnflag || '_' || CAST(l_quantity >= 25 AS VARCHAR) = 'R_false' THEN l_discount END), 6) AS "R_false"
FROM lineitem GROUP BY l_linestatus""")
def a7b(spark, d):
    li = _t(spark, d, "lineitem").withColumn("big", F.expr("l_quantity >= 25"))
    vals = [f"{f}_{b}" for f in "ANR" for b in ("true", "false")]
    out = op.pivot(li, "l_linestatus", "l_returnflag, big", "l_discount", "mean", pivot_values=vals)
    return out.select("l_linestatus", *[F.round(F.col(v), 6).alias(v) for v in vals])

# ---------------------------------------------------------------- windows


@query("W1_rank", """
SELECT *, (count(*) OVER (PARTITION BY user_id) + 1) / 2.0 AS rank_result FROM events""")
def w1(spark, d):
    return op.window_function(_t(spark, d, "events"), "rank", "user_id")


@query("W1b_rank_by_order", """
SELECT *, (rank() OVER w + rank() OVER w + count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS qty_rank
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)""")
def w1b(spark, d):
    return op.window_function(_t(spark, d, "lineitem"), "rank", "l_returnflag", "qty_rank",
                              order_by=["l_quantity"])


@query("W2_row_number", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_number_result FROM events""")
def w2(spark, d):
    return op.window_function(_t(spark, d, "events"), "row_number", "user_id", order_by=["ts", "event_id"])


@query("W2b_row_number_distributed", """
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS FIRST, l_partkey NULLS FIRST,
  l_suppkey NULLS FIRST, """ + ", ".join(c + " NULLS FIRST" for c in LI_REST.split(", ")) + """) AS rn
FROM lineitem""")
def w2b(spark, d):
    return op.row_numbers(_t(spark, d, "lineitem"), "l_orderkey", ["l_linenumber"], output="rn",
                          method="distributed")


@query("W2c_row_number_hot_key_split", """
SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate NULLS FIRST, l_orderkey NULLS FIRST,
  l_linenumber NULLS FIRST, l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST,
  l_extendedprice NULLS FIRST, l_discount NULLS FIRST, l_tax NULLS FIRST, l_linestatus NULLS FIRST) AS rn
FROM lineitem""")
def w2c(spark, d):
    # groups above 20,000 rows (hot keys) are numbered distributed, the others with a plain window
    return op.row_numbers(_t(spark, d, "lineitem"), "l_returnflag", ["l_shipdate", "l_orderkey", "l_linenumber"],
                          output="rn", max_group_rows=20_000)


@query("W3_cumsum", """
SELECT *, user_id * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cumsum_result FROM events""")
def w3(spark, d):
    return op.window_function(_t(spark, d, "events"), "cumsum", "user_id", order_by=["ts", "event_id"])


@query("W3b_running_sum_distributed", """
SELECT event_id, user_id, ts, value,
  row_number() OVER w AS seq, round(sum(value) OVER w, 6) AS running_value
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def w3b(spark, d):
    ev = _t(spark, d, "events").select("event_id", "user_id", "ts", "value")
    out = op.row_numbers(ev, "user_id", ["ts", "event_id"], output="seq", value="value",
                         sum_output="running_value", method="distributed")
    return out.withColumn("running_value", F.round("running_value", 6))



@query("W3c_running_sum_nulls", """
SELECT event_id, event_type, ts, v, row_number() OVER w AS seq, round(sum(v) OVER w, 6) AS running_value
FROM (SELECT event_id, event_type, ts, CASE WHEN event_id % 7 < 5 THEN NULL ELSE value END AS v FROM events)
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def w3c(spark, d):
    ev = _t(spark, d, "events").selectExpr("event_id", "event_type", "ts",
                                           "CASE WHEN event_id % 7 < 5 THEN NULL ELSE value END AS v")
    out = op.row_numbers(ev, "event_type", ["ts", "event_id"], output="seq", value="v",
                         sum_output="running_value", method="distributed", num_partitions=16)
    return out.withColumn("running_value", F.round("running_value", 6))


@query("S1b_csv_hard_cells", """
SELECT doc_id, text, '"' || source || '", ' || lang AS quoted, '  ' || lang || ' ' AS padded,
  substr(text, 1, 40) || chr(10) || '"x"' AS lines FROM documents""")
def s1b(spark, d):
    docs = _t(spark, d, "documents").select(
        "doc_id", "text", F.concat(F.lit('"'), "source", F.lit('", '), "lang").alias("quoted"),
        F.concat(F.lit("  "), "lang", F.lit(" ")).alias("padded"),
        F.concat(F.substring("text", 1, 40), F.lit('\n"x"')).alias("lines"))
    path = scratch_path(spark, "csv-cells")
    files.save(docs, path, "csv")
    return files.read_csv(spark, path, schema=docs.schema, split=True)


@query("S2b_json_lines_and_arrays", """
SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT c_custkey + 1000000, c_mktsegment FROM customer""")
def s2b(spark, d):
    # JSON lines (orders) and array documents over several lines (customers), each told by its files
    path = scratch_path(spark, "json-kinds")
    _t(spark, d, "orders").select("o_orderkey", "o_orderstatus").write.json(path)
    c = _t(spark, d, "customer").selectExpr("c_custkey + 1000000 AS o_orderkey", "c_mktsegment AS o_orderstatus")
    rows = c.select(F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("value"),
                    F.pmod(F.xxhash64("o_orderkey"), F.lit(8)).alias("doc"))
    docs = rows.groupBy("doc").agg(F.concat(F.lit("[\n"), F.concat_ws(",\n", F.collect_list("value")),
                                            F.lit("\n]")).alias("value"))
    docs.repartition(8, "doc").select("doc", "value").write.partitionBy("doc").mode("append").text(path + "-arrays")
    arrays = files.read_json(spark, path + "-arrays", split=True).select("o_orderkey", "o_orderstatus")
    return files.read_json(spark, path).select("o_orderkey", "o_orderstatus").unionByName(arrays)


@query("C7b_dotted_names", """
SELECT event_type, "p_a.k" AS "p_a.k", count(*) AS n FROM (
  SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS "p_a.k" FROM events) GROUP BY ALL""")
def c7b(spark, d):
    ev = _t(spark, d, "events").select("event_type", "event_id",
                                       F.concat(F.lit('{"a": '), "props", F.lit("}")).alias("props"))
    flat = op.json_flatten(ev, "props", "p", schema="a STRUCT<k: BIGINT>")
    flat = op.remove_nulls(op.select_columns(flat, ["event_id", "event_type", "p_a.k"]), ["p_a.k"])
    flat = op.deduplicate(flat, ["event_id", "p_a.k"], "event_id")
    return op.aggregate_multiple(flat, ["event_type", "p_a.k"], [
        {"column": "event_id", "func": "count", "output_column": "n"}])


@query("Q1c_sql_literals", r"""
SELECT o_orderkey, 'rows from df' AS note, regexp_matches(o_orderpriority, '[0-9]{1}') AS numbered
FROM orders, (SELECT 1 AS one)""")
def q1c(spark, d):
    return op.execute_sql(_t(spark, d, "orders"), """
        SELECT df.o_orderkey, 'rows from df' AS note, df.o_orderpriority RLIKE '[0-9]{1}' AS numbered
        FROM df, (SELECT 1 AS one) x""")


@query("A7d_pivot_colliding_names", """
SELECT o_orderstatus, sum(CASE WHEN a = 'x_y' AND b = 'z' THEN v END)::BIGINT AS x_y_z_2,
  sum(CASE WHEN a = 'x' AND b = 'y_z' THEN v END)::BIGINT AS x_y_z FROM (
  SELECT o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'x_y' ELSE 'x' END AS a,
    CASE WHEN o_orderkey % 2 = 0 THEN 'z' ELSE 'y_z' END AS b, o_custkey AS v FROM orders) GROUP BY ALL""")
def a7d(spark, d):
    o = _t(spark, d, "orders").selectExpr(
        "o_orderstatus", "CASE WHEN o_orderkey % 2 = 0 THEN 'x_y' ELSE 'x' END AS a",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'z' ELSE 'y_z' END AS b", "o_custkey AS v")
    return op.pivot(o, "o_orderstatus", ["a", "b"], "v", "sum")

# ---------------------------------------------------------------- set operations


@query("U1_union_by_name", """
SELECT c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment FROM customer
UNION ALL BY NAME
SELECT s_suppkey AS key, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal FROM supplier""")
def u1(spark, d):
    c = _t(spark, d, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_nationkey AS nationkey",
                                            "c_acctbal AS acctbal", "c_mktsegment")
    s = _t(spark, d, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_nationkey AS nationkey",
                                            "s_acctbal AS acctbal")
    return op.merge_records([c, s], "concat")

# ---------------------------------------------------------------- routing


@query("R1_split_records", """
SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS chunk FROM orders""")
def r1(spark, d):
    return op.split_records(_t(spark, d, "orders"), 1000, order_by=["o_orderkey"]).routed


@query("R1b_split_records_condition", """
SELECT *, (row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1) // 500 + 1 AS chunk
FROM lineitem WHERE l_returnflag = 'R'""")
def r1b(spark, d):
    return op.split_records(_t(spark, d, "lineitem"), 500, condition="l_returnflag = 'R'",
                            order_by=["l_shipdate", "l_orderkey", "l_linenumber"]).routed


@query("R2_route_on_attribute", """
SELECT *, CASE o_orderstatus WHEN 'F' THEN 'finished.csv' WHEN 'O' THEN 'open.csv' END AS route FROM orders""")
def r2(spark, d):
    return op.route_on_attribute(_t(spark, d, "orders"), "o_orderstatus",
                                 {"F": "finished.csv", "O": "open.csv"}).tagged


@query("R2b_route_documents_by_language", """
SELECT doc_id, lang, text, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' END AS route
FROM documents""")
def r2b(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "text")
    return op.route_on_attribute(docs, "lang", {"en": "english", "fr": "french"}).tagged


@query("R3_branching", """
SELECT * EXCLUDE (v), CASE WHEN coalesce(v > 100, false) THEN 'true' ELSE 'false' END AS route
FROM (SELECT *, nullif(value, 185.22) AS v FROM events)""")
def r3(spark, d):
    ev = _t(spark, d, "events")
    return op.branching(ev, "nullif(value, 185.22) > 100").routed


@query("R4_dynamic_split", """
SELECT *, 'prio_' || replace(o_orderstatus || '/' || o_orderpriority, '/', '_') AS route FROM orders""")
def r4(spark, d):
    o = _t(spark, d, "orders")
    keyed = o.withColumn("__k", F.expr("o_orderstatus || '/' || o_orderpriority"))
    return op.dynamic_split(keyed, "__k", "prio_").routed.drop("__k")


@query("R5_conditional_split", """
SELECT *, CASE WHEN coalesce(value > 100, false) THEN 'high.csv'
               WHEN coalesce(event_type = 'error', false) THEN 'errors.csv' END AS route FROM events""")
def r5(spark, d):
    return op.conditional_split(_t(spark, d, "events"), [
        {"condition": "value > 100", "output": "high.csv"},
        {"condition": "event_type = 'error'", "output": "errors.csv"}]).tagged


def _written(spark, res, rest, fmt):
    """The outputs that ``write_routes`` wrote, read back, and the rows that continue."""
    path = scratch_path(spark, "routes")
    write_routes(res.routed, path, fmt)
    schema = res.routed.schema
    back = files.read_csv(spark, path, schema=schema) if fmt == "csv" else spark.read.schema(schema).load(path, fmt)
    return back.unionByName(rest, allowMissingColumns=True)


@query("R1c_split_written", """
SELECT *, CASE WHEN n IS NOT NULL THEN 'part_' || n END AS route FROM (
  SELECT * EXCLUDE (rn), CASE WHEN rn IS NOT NULL THEN (rn - 1) // 4000 + 1 END AS n FROM (
    SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders WHERE coalesce(o_orderstatus <> 'P', false)
    UNION ALL SELECT *, NULL FROM orders WHERE o_orderstatus = 'P'))""")
def r1c(spark, d):
    res = op.split_records(_t(spark, d, "orders"), 4000, "o_orderstatus <> 'P'", ["o_orderkey"], chunk="n",
                           output_prefix="part_")
    return _written(spark, res, res.rest, "parquet")


@query("R2c_route_written", """
SELECT *, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' END AS route FROM documents""")
def r2c(spark, d):
    res = op.route_on_attribute(_t(spark, d, "documents"), "lang", {"en": "english", "fr": "french"})
    return _written(spark, res, res.rest, "csv")


@query("R3b_branching_written", """
SELECT *, CASE WHEN coalesce(value > 100, false) THEN 'true' ELSE 'false' END AS route FROM events""")
def r3b(spark, d):
    res = op.branching(_t(spark, d, "events"), "value > 100")
    return _written(spark, res, res.rest, "csv")


@query("R4b_dynamic_split_written", """
SELECT *, 'prio_' || o_orderpriority AS route FROM orders""")
def r4b(spark, d):
    res = op.dynamic_split(_t(spark, d, "orders"), "o_orderpriority", "prio_")
    return _written(spark, res, res.rest, "parquet")


@query("R5b_conditional_split_written", """
SELECT *, CASE WHEN coalesce(value > 100, false) THEN 'high.csv'
               WHEN coalesce(event_type = 'error', false) THEN 'errors.csv' END AS route FROM events""")
def r5b(spark, d):
    res = op.conditional_split(_t(spark, d, "events"), [
        {"condition": "value > 100", "output": "high.csv"},
        {"condition": "event_type = 'error'", "output": "errors.csv"}])
    return _written(spark, res, res.rest, "csv")

# ---------------------------------------------------------------- column steps


@query("C1_replace_values", """
SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END AS o_orderstatus)
FROM orders""")
def c1(spark, d):
    return op.replace_values(_t(spark, d, "orders"), "o_orderstatus", "P", "pending")


@query("C1b_replace_values_numeric", """
SELECT * REPLACE (CASE WHEN p_size = 7 THEN 70 ELSE p_size END AS p_size) FROM part""")
def c1b(spark, d):
    return op.replace_values(_t(spark, d, "part"), "p_size", "7", "70")


@query("C2_replace_text", r"""
SELECT * REPLACE (regexp_replace(c_name, '#0+(\d+)', ' n\1', 'g') AS c_name) FROM customer""")
def c2(spark, d):
    return op.replace_text(_t(spark, d, "customer"), "c_name", r"#0+(\d+)", r" n\1")


@query("C2b_replace_text_documents", r"""
SELECT doc_id, lang, regexp_replace(text, '\d', '#', 'g') AS text FROM documents""")
def c2b(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "text")
    return op.replace_text(docs, "text", r"\d", "#")


@query("C3_min_max", """
SELECT * REPLACE (round((c_acctbal - (SELECT min(c_acctbal) FROM customer))
   / nullif((SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 0), 6) AS c_acctbal) FROM customer""")
def c3(spark, d):
    out = op.normalize_data(_t(spark, d, "customer"), "c_acctbal", "min_max")
    return out.withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("C4_z_score", """
SELECT * REPLACE (round((c_acctbal - (SELECT avg(c_acctbal) FROM customer))
   / nullif((SELECT stddev_samp(c_acctbal) FROM customer), 0), 6) AS c_acctbal,
   round((s_acct - (SELECT avg(c_nationkey) FROM customer))
   / nullif((SELECT stddev_samp(c_nationkey) FROM customer), 0), 6) AS s_acct)
FROM (SELECT *, CAST(c_nationkey AS DOUBLE) AS s_acct FROM customer)""")
def c4(spark, d):
    c = _t(spark, d, "customer").withColumn("s_acct", F.col("c_nationkey").cast("double"))
    out = op.normalize_data(c, "c_acctbal, s_acct", "z_score")
    return out.withColumns({"c_acctbal": F.round("c_acctbal", 6), "s_acct": F.round("s_acct", 6)})


@query("C5_hash", """
SELECT * REPLACE (substr(sha256(c_name), 1, 10) AS c_name,
                  substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 10) AS c_custkey) FROM customer""")
def c5(spark, d):
    return op.data_masking(_t(spark, d, "customer"), "c_name, c_custkey", "hash")


@query("C6_mask", """
SELECT * REPLACE (repeat('*', length(c_name)) AS c_name, repeat('*', length(c_mktsegment)) AS c_mktsegment)
FROM customer""")
def c6(spark, d):
    return op.data_masking(_t(spark, d, "customer"), "c_name, c_mktsegment", "mask")


@query("C7_json_flatten", """
SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k
FROM events""")
def c7(spark, d):
    return op.json_flatten(_t(spark, d, "events"), "props")

# ---------------------------------------------------------------- quality


@query("D1_quality_report", """
WITH o AS (SELECT nullif(o_orderstatus, 'P') AS s, o_custkey, o_orderkey FROM orders)
SELECT 'no_nulls' AS rule, 'o_orderstatus' AS "column", CAST(count(*) - count(s) AS BIGINT) AS violations FROM o
UNION ALL SELECT 'no_nulls', 'o_custkey', CAST(count(*) - count(o_custkey) AS BIGINT) FROM o
UNION ALL SELECT 'unique', 'o_orderkey', CAST(count(*) - count(DISTINCT o_orderkey) AS BIGINT) FROM o
UNION ALL SELECT 'unique', 'o_orderstatus',
  CAST(count(*) - count(DISTINCT s) - CASE WHEN count(*) > count(s) THEN 1 ELSE 0 END AS BIGINT) FROM o""")
def d1(spark, d):
    o = _t(spark, d, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    return op.quality_report(o, {"no_nulls": ["o_orderstatus", "o_custkey"],
                                 "unique": ["o_orderkey", "o_orderstatus"]})


@query("D3_quality_gate", """
WITH o AS (SELECT nullif(o_orderstatus, 'P') AS s, o_custkey, o_orderkey FROM orders),
v AS (SELECT count(*) - count(s) AS nulls, count(*) - count(DISTINCT o_custkey) AS repeats FROM o)
SELECT 'keys' AS gate, true AS passed, CAST((SELECT count(*) FROM o) AS VARCHAR) AS told
UNION ALL SELECT 'status', nulls = 0, 'data_quality_check failed: no_nulls on o_orderstatus: ' || nulls || ' rows' FROM v
UNION ALL SELECT 'customer', repeats = 0, 'data_quality_check failed: unique on o_custkey: ' || repeats || ' rows' FROM v""")
def d3(spark, d):
    # a gate lets the table through whole, or fails the run with what it found
    o = _t(spark, d, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    gates = {"keys": {"no_nulls": ["o_orderkey"], "unique": ["o_orderkey"]}, "status": {"no_nulls": ["o_orderstatus"]},
             "customer": {"no_nulls": ["o_orderkey"], "unique": ["o_custkey"]}}
    told = []
    for name, rules in gates.items():
        try:
            told.append((name, True, str(op.data_quality_check(o, rules).count())))
        except StepError as error:
            told.append((name, False, str(error)))
    return spark.createDataFrame(told, "gate string, passed boolean, told string")


@query("D2_repeated_values", """
SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def d2(spark, d):
    return repeated_values(_t(spark, d, "orders"), "o_custkey")

# ---------------------------------------------------------------- SQL step


def _sql(spark, d, table, text):
    return op.execute_sql(_t(spark, d, table), text)


@query("Q1_execute_sql", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n
FROM lineitem WHERE l_discount >= 0.05 GROUP BY l_returnflag, l_linestatus""")
def q1(spark, d):
    return _sql(spark, d, "lineitem", """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n
        FROM df WHERE l_discount >= 0.05 GROUP BY l_returnflag, l_linestatus""")


@query("Q12_sql_after_steps", """
WITH li AS (SELECT l_orderkey, l_quantity, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 10),
j AS (SELECT li.*, o_custkey, o_orderpriority FROM li JOIN orders ON l_orderkey = o_orderkey),
q AS (SELECT o_orderpriority, o_custkey, sum(net) AS net, count(*) AS n,
  rank() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_custkey) AS place FROM j GROUP BY o_orderpriority, o_custkey)
SELECT o_orderpriority AS priority, o_custkey, round(net, 2) AS net, n, place,
  CASE WHEN net > 100000 THEN 'large' ELSE 'small' END AS band FROM q WHERE place <= 20""")
def q12(spark, d):
    # filter, derive and join; SQL over the result; derive and rename after it: one plan
    step = chain(
        lambda t: op.filter_rows(t, "l_quantity > 10"),
        lambda t: op.derive_columns(t, {"net": "l_extendedprice * (1 - l_discount)"}),
        lambda t: op.select_columns(t, "l_orderkey, l_quantity, net"),
        lambda t: op.join(t, _t(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey"),
        lambda t: op.execute_sql(t, """
            SELECT o_orderpriority AS priority, o_custkey, sum(net) AS net, count(*) AS n,
              rank() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_custkey) AS place
            FROM df GROUP BY o_orderpriority, o_custkey"""),
        lambda t: op.filter_rows(t, "place <= 20"),
        lambda t: op.derive_columns(t, {"band": "CASE WHEN net > 100000 THEN 'large' ELSE 'small' END"}),
        lambda t: op.derive_columns(t, {"net": "round(net, 2)"}))
    return step(_t(spark, d, "lineitem")).withColumn("place", F.col("place").cast("bigint"))


@query("Q2_case_projection", """
SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'small' WHEN o_totalprice < 10000 THEN 'medium'
  ELSE 'large' END AS band, upper(o_orderstatus) AS status FROM orders""")
def q2(spark, d):
    return _sql(spark, d, "orders", """
        SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'small' WHEN o_totalprice < 10000 THEN 'medium'
          ELSE 'large' END AS band, upper(o_orderstatus) AS status FROM {df}""")


@query("Q3_where_between_like_in", """
SELECT * FROM part WHERE p_size BETWEEN 10 AND 30 AND p_type LIKE '%SMALL%' AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')""")
def q3(spark, d):
    return _sql(spark, d, "part", """
        SELECT * FROM {df} WHERE p_size BETWEEN 10 AND 30 AND p_type LIKE '%SMALL%'
          AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')""")


@query("Q4_group_having_distinct", """
SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, sum(l_quantity) AS qty FROM lineitem
GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 5""")
def q4(spark, d):
    return _sql(spark, d, "lineitem", """
        SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, sum(l_quantity) AS qty FROM {df}
        GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 5""")


@query("Q5_order_limit_topk", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def q5(spark, d):
    return _sql(spark, d, "orders",
                "SELECT o_orderkey, o_totalprice FROM {df} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")


@query("Q6_intersect_except", """
(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q6(spark, d):
    return op.execute_sql(_t(spark, d, "customer"), """
        (SELECT CAST(c_nationkey AS BIGINT) AS k FROM {df} INTERSECT SELECT s_nationkey FROM {s})
        UNION ALL (SELECT o_custkey FROM {o} EXCEPT SELECT c_custkey FROM {df} WHERE c_mktsegment = 'BUILDING')""",
                          s=_t(spark, d, "supplier"), o=_t(spark, d, "orders"))


@query("Q7_theta_join", """
SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, p.p_size FROM lineitem l JOIN part p
  ON l.l_partkey = p.p_partkey AND l.l_quantity > p.p_size""")
def q7(spark, d):
    return op.execute_sql(_t(spark, d, "lineitem"), """
        SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, p.p_size FROM {df} l JOIN {p} p
          ON l.l_partkey = p.p_partkey AND l.l_quantity > p.p_size""", p=_t(spark, d, "part"))


@query("Q8_exists_semi_anti", """
SELECT c_custkey, 'with_orders' AS kind FROM customer c
  WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')
UNION ALL
SELECT c_custkey, 'without' FROM customer c
  WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')""")
def q8(spark, d):
    return op.execute_sql(_t(spark, d, "customer"), """
        SELECT c_custkey, 'with_orders' AS kind FROM {df} c
          WHERE EXISTS (SELECT 1 FROM {o} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')
        UNION ALL
        SELECT c_custkey, 'without' FROM {df} c
          WHERE NOT EXISTS (SELECT 1 FROM {o} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')""",
                          o=_t(spark, d, "orders"))


@query("Q9_cte_scalar_subquery", """
WITH big AS (SELECT * FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders))
SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus""")
def q9(spark, d):
    return _sql(spark, d, "orders", """
        WITH big AS (SELECT * FROM {df} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {df}))
        SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus""")


@query("Q10_window_frames", """
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id
  ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM events""")
def q10(spark, d):
    return _sql(spark, d, "events", """
        SELECT event_id, round(avg(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id
          ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM {df}""")


@query("Q11_scalar_functions", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
  lower(o_orderpriority) AS prio, CAST(length(o_orderpriority) AS INTEGER) AS prio_len, abs(o_totalprice - 100000) AS dist,
  substr(o_orderpriority, 3, 4) AS prio_word FROM orders""")
def q11(spark, d):
    return _sql(spark, d, "orders", """
        SELECT o_orderkey, year(o_orderdate) AS yr, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS month_start,
          lower(o_orderpriority) AS prio, length(o_orderpriority) AS prio_len,
          abs(o_totalprice - 100000) AS dist, substr(o_orderpriority, 3, 4) AS prio_word FROM {df}""")

# ---------------------------------------------------------------- user functions


@query("F1_table_function", """
SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_orderstatus = 'O'""")
def f1(spark, d):
    def fn(df):
        return df.where("o_orderstatus = 'O'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"))
    return uf.apply_table_function(_t(spark, d, "orders"), fn)


@query("F2_map_batches", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem""")
def f2(spark, d):
    def fn(batches):
        for b in batches:
            yield pd.DataFrame({"l_orderkey": b["l_orderkey"], "l_linenumber": b["l_linenumber"],
                                "net": b["l_extendedprice"] * (1 - b["l_discount"])})
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return uf.map_batches(li, fn, "l_orderkey long, l_linenumber int, net double")


@query("F3_apply_groups", """
SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 6) AS total FROM orders GROUP BY o_custkey""")
def f3(spark, d):
    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.groupby("o_custkey", sort=False)["o_totalprice"]
        return pd.DataFrame({"n": g.size(), "s": g.sum()}).reset_index()
    o = _t(spark, d, "orders").select("o_custkey", "o_totalprice")
    return uf.apply_groups_salted(o, ["o_custkey"], partial, "o_custkey long, n long, s double",
                                  [F.sum("n").alias("n_orders"), F.round(F.sum("s"), 6).alias("total")])


@query("F4_scalar_function", "SELECT c_custkey, upper(c_name) AS name_upper FROM customer")
def f4(spark, d):
    up = uf.scalar_function(lambda s: s.str.upper(), "string")
    return _t(spark, d, "customer").select("c_custkey", up("c_name").alias("name_upper"))

@query("W4_moving_frames", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS k, ts,
    CAST(round(value * 100) AS BIGINT) AS cents FROM events)
SELECT event_id, k, cents, CAST(sum(cents) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS sum_10,
  max(cents) OVER (w ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS max_9,
  lag(cents, 3) OVER w AS back_3, lead(cents, 1) OVER w AS ahead_1
FROM e WINDOW w AS (PARTITION BY k ORDER BY ts, event_id)""")
def w4(spark, d):
    # a third of the rows under one key: it is cut into blocks of 500 rows, all other keys keep the window
    e = _t(spark, d, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS k", "ts",
        "CAST(round(value * 100) AS BIGINT) AS cents")
    out = op.moving_frames(e, "k", ["ts", "event_id"], {
        "sum_10": op.Frame("sum", "cents", 9, 0), "max_9": op.Frame("max", "cents", 4, 4),
        "back_3": op.Frame("lag", "cents", 3, 0), "ahead_1": op.Frame("lead", "cents", 0, 1)},
        max_group_rows=1000, block_rows=500)
    return out.drop("ts")

# ---------------------------------------------------------------- usage and billing


def runlog(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Run-log tables derived from the given tables.

    users <- customer (subscribers: BUILDING and MACHINERY segments);
    workflows <- one per (user, event type); logs <- one run per event
    (errors fail; rows = floor(value * 10)); transactions <- a deposit per
    order.
    """
    cust = _t(spark, d, "customer")
    users = cust.selectExpr("c_custkey AS id", "c_name AS email",
                            "c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_subscribed",
                            "CAST(c_acctbal AS DECIMAL(18,6)) AS balance")
    ev = _t(spark, d, "events")
    workflows = ev.selectExpr("concat('w', user_id, '-', event_type) AS id", "user_id", "event_type AS name",
                              "'Completed' AS status").distinct()
    runs = ev.join(users.selectExpr("id AS user_id", "is_subscribed"), "user_id", "left").selectExpr(
        "CAST(event_id AS STRING) AS id", "concat('w', user_id, '-', event_type) AS workflow_id",
        "ts AS timestamp", "CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Success' END AS status",
        "CAST(floor(value * 10) AS BIGINT) AS rows_processed", "is_subscribed")
    ok = F.col("status") == "Success"
    logs = runs.withColumn("cost", F.when(ok, usage.run_cost("rows_processed", "is_subscribed"))
                           .otherwise(F.lit(0).cast(usage.MONEY))).drop("is_subscribed")
    tx = _t(spark, d, "orders").selectExpr(
        "concat('t', o_orderkey) AS id", "o_custkey AS user_id", "o_orderdate AS timestamp",
        "CAST(o_totalprice AS DECIMAL(18,6)) AS amount", "'deposit' AS type",
        "concat('deposit ', o_orderkey) AS description")
    return {"users": users, "workflows": workflows, "logs": logs, "transactions": tx}


_RUNLOG_SQL = """
WITH users AS (SELECT c_custkey AS id, c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_subscribed FROM customer),
workflows AS (SELECT DISTINCT 'w' || user_id || '-' || event_type AS id, user_id, event_type AS name FROM events),
logs AS (SELECT CAST(event_id AS VARCHAR) AS id, 'w' || user_id || '-' || event_type AS workflow_id,
   ts AS timestamp, CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Success' END AS status,
   CAST(floor(value * 10) AS BIGINT) AS rows_processed,
   CASE WHEN event_type <> 'error' AND coalesce(u.is_subscribed, false)
        THEN round(CAST(floor(value * 10) AS DECIMAL(20,0)) * 0.00001, 6) ELSE 0 END::DECIMAL(18,6) AS cost
   FROM events e LEFT JOIN users u ON e.user_id = u.id),
transactions AS (SELECT 't' || o_orderkey AS id, o_custkey AS user_id, o_orderdate AS timestamp,
   CAST(o_totalprice AS DECIMAL(18,6)) AS amount, 'deposit ' || o_orderkey AS description
   FROM orders),
usage AS (SELECT w.user_id, CAST(l.timestamp AS DATE) AS day, CAST(sum(rows_processed) AS BIGINT) AS rows_used
   FROM logs l JOIN workflows w ON l.workflow_id = w.id WHERE l.status = 'Success' GROUP BY ALL),
ledger AS (SELECT w.user_id, l.id, l.timestamp, -l.cost AS amount, l.status, 'workflow run: ' || w.name AS description
   FROM logs l JOIN workflows w ON l.workflow_id = w.id WHERE l.cost > 0
   UNION ALL SELECT user_id, id, timestamp, amount, 'Success', description FROM transactions)
"""


@query("M1_daily_usage", _RUNLOG_SQL + "SELECT * FROM usage")
def m1(spark, d):
    t = runlog(spark, d)
    return usage.daily_usage(t["logs"], t["workflows"])


@query("M2_quota_check", """
WITH RECURSIVE requests AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, CAST(floor(value * 10) AS BIGINT) AS n,
    event_type <> 'error' AS ok, coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false) AS free,
    row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k
  FROM events LEFT JOIN customer ON user_id = c_custkey),
r AS (SELECT event_id, user_id, day, k, n, 0::BIGINT AS rows_used, free OR n <= 1000 AS allowed,
    CASE WHEN ok AND (free OR n <= 1000) THEN n ELSE 0 END AS after FROM requests WHERE k = 1
  UNION ALL
  SELECT q.event_id, q.user_id, q.day, q.k, q.n, r.after, q.free OR r.after + q.n <= 1000,
    r.after + CASE WHEN q.ok AND (q.free OR r.after + q.n <= 1000) THEN q.n ELSE 0 END
  FROM r JOIN requests q ON q.user_id = r.user_id AND q.day = r.day AND q.k = r.k + 1)
SELECT event_id, user_id, day, n AS rows_requested, CAST(rows_used AS BIGINT) AS rows_used, allowed FROM r""")
def m2(spark, d):
    requests = _t(spark, d, "events").selectExpr(
        "event_id AS id", "user_id", "to_date(ts) AS day", "ts AS timestamp",
        "CAST(floor(value * 10) AS BIGINT) AS rows_requested", "event_type <> 'error' AS succeeds")
    judged = usage.quota_check(requests, runlog(spark, d)["users"])
    return judged.select(F.col("id").alias("event_id"), "user_id", "day", "rows_requested", "rows_used", "allowed")


@query("M3_run_cost", _RUNLOG_SQL + "SELECT id, rows_processed, CAST(cost AS DOUBLE) AS cost FROM logs")
def m3(spark, d):
    return runlog(spark, d)["logs"].select("id", "rows_processed", F.col("cost").cast("double").alias("cost"))


@query("M4_ledger", _RUNLOG_SQL + """
SELECT user_id, id, timestamp, CAST(amount AS DOUBLE) AS amount, status, description FROM ledger""")
def m4(spark, d):
    t = runlog(spark, d)
    led = usage.ledger(t["logs"], t["workflows"], t["transactions"])
    return usage.newest_first(led.withColumn("amount", F.col("amount").cast("double")))


@query("M5_run_history", _RUNLOG_SQL + """
SELECT workflow_id, id, timestamp, status, rows_processed, CAST(cost AS DOUBLE) AS cost FROM logs""")
def m5(spark, d):
    logs = runlog(spark, d)["logs"]
    return usage.run_history(logs).withColumn("cost", F.col("cost").cast("double"))


@query("M6_running_balance", _RUNLOG_SQL + """
SELECT user_id, id, CAST(amount AS DOUBLE) AS amount,
  CAST(sum(amount) OVER (PARTITION BY user_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance_after
FROM ledger""")
def m6(spark, d):
    t = runlog(spark, d)
    led = usage.ledger(t["logs"], t["workflows"], t["transactions"])
    out = usage.running_balance(led)
    return out.select("user_id", "id", F.col("amount").cast("double").alias("amount"),
                      F.col("balance_after").cast("double").alias("balance_after"))


@query("M6b_balances", _RUNLOG_SQL + """
SELECT user_id, CAST(sum(amount) AS DOUBLE) AS balance FROM ledger GROUP BY user_id""")
def m6b(spark, d):
    t = runlog(spark, d)
    b = usage.balances(usage.ledger(t["logs"], t["workflows"], t["transactions"]))
    return b.withColumn("balance", F.col("balance").cast("double"))


@query("M7_workflow_listing", _RUNLOG_SQL + "SELECT user_id, id, name, 'Completed' AS status FROM workflows")
def m7(spark, d):
    return usage.workflow_listing(runlog(spark, d)["workflows"])

@query("M8_usage_sketches", """
SELECT event_type, count(*) AS n, true AS users_within, true AS median_within FROM events GROUP BY event_type""")
def m8(spark, d):
    # A sketch table by day and type, merged by type; its estimates held against the rows, within the stated errors
    ev = _t(spark, d, "events").withColumn("day", F.to_date("ts"))
    table = materialize(sketches.sketch_table(ev, "day, event_type", {"users": "user_id"}, {"value": "value"}), "sketches")
    told = sketches.read_sketches(sketches.merge_sketches(table, "event_type"), [0.5])
    told = told.withColumn("median", F.col("value_quantiles")[0])
    exact = ev.join(F.broadcast(told.select("event_type", "median")), "event_type").groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") <= F.col("median")).alias("upto"),
        F.count_if(F.col("value") < F.col("median")).alias("below"), F.count(F.lit(1)).alias("rows"))
    off = sketches.QUANTILE_ERROR * F.col("rows") + 1
    return told.join(exact, "event_type").select(
        "event_type", "n", (F.abs(F.col("users_distinct") - F.col("users")) <= sketches.DISTINCT_ERROR * F.col("users") + 1)
        .alias("users_within"),
        ((F.col("below") <= 0.5 * F.col("rows") + off) & (F.col("upto") >= 0.5 * F.col("rows") - off)).alias("median_within"))

# ---------------------------------------------------------------- sources, sinks, streams


@query("S1_csv_roundtrip", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def s1(spark, d):
    path = scratch_path(spark, "csv")
    files.save(_t(spark, d, "customer"), path, "csv")
    return files.read_csv(spark, path)


@query("S2_json_roundtrip", "SELECT * FROM orders")
def s2(spark, d):
    o = _t(spark, d, "orders")
    path = scratch_path(spark, "json")
    files.save(o, path, "json")
    return files.read_json(spark, path, schema=o.schema)


@query("S3_csv_sink", "SELECT * FROM lineitem")
def s3(spark, d):
    li = _t(spark, d, "lineitem")
    path = scratch_path(spark, "csv-sink")
    files.save(li, path, "csv")
    return spark.read.schema(li.schema).options(**files.TIMESTAMP_OPTIONS).option("header", True).csv(path)


@query("S4_json_sink", "SELECT * FROM events")
def s4(spark, d):
    ev = _t(spark, d, "events")
    path = scratch_path(spark, "json-sink")
    files.save(ev, path, "json")
    return files.read_json(spark, path, schema=ev.schema, lines=True)


@query("S5_convert_format", "SELECT * FROM events")
def s5(spark, d):
    return op_convert(_t(spark, d, "events"), "csv")


def op_convert(df: DataFrame, fmt: str) -> DataFrame:
    return files.convert_format(df, fmt)


@query("S6_file_arrival", "SELECT * FROM events")
def s6(spark, d):
    schema = _t(spark, d, "events").schema
    sink = scratch_path(spark, "arrived")
    run_available(file_arrival_stream(spark, d, schema, pathGlobFilter="events.parquet"), sink)
    return spark.read.schema(schema).parquet(sink)


@query("T1_stream_filter", "SELECT * FROM events WHERE value > 100")
def t1(spark, d):
    schema = _t(spark, d, "events").schema
    sink = scratch_path(spark, "stream-filter")
    stream = file_arrival_stream(spark, d, schema, pathGlobFilter="events.parquet")
    run_available(stream_filter(stream, "value > 100"), sink)
    return spark.read.schema(schema).parquet(sink)


def _arriving(spark: SparkSession, rows: DataFrame, parts: list, step) -> tuple[DataFrame, DataFrame]:
    """Rows delivered part by part (conditions) into a folder, the stream ``step`` run after each and stopped again:
    what it gave out, and what arrived."""
    folder, sink, checkpoint = (scratch_path(spark, x) for x in ("arriving", "given", "stream-checkpoint"))
    for part in parts:
        rows.where(part).write.mode("append").parquet(folder)
        run_available(step(file_arrival_stream(spark, folder, rows.schema)), sink, checkpoint)
    return spark.read.parquet(sink), spark.read.schema(rows.schema).parquet(folder)


def _by_time(rows: DataFrame, time: str, n: int) -> list:
    """Conditions that cut rows into ``n`` parts along time."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(micros, [i / n for i in range(1, n)])).first()[0] or []
    low = [None, *cuts]
    return [(F.lit(True) if a is None else micros > a) & (F.lit(True) if b is None else micros <= b)
            for a, b in zip(low, [*cuts, None], strict=True)]


@query("T2_event_windows", """
WITH q AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS c, date_trunc('hour', ts) AS w,
    event_id * 4 // ((SELECT max(event_id) FROM events) + 1) AS chunk FROM events),
d AS (SELECT *, CASE WHEN chunk = 0 AND event_id % 50 = 7 THEN 3 ELSE chunk END AS part FROM q),
m AS (SELECT p.part, (SELECT max(ts) FROM d e WHERE e.part < p.part) - INTERVAL 1 HOUR AS mark FROM (SELECT DISTINCT part FROM d) p),
r AS (SELECT d.*, coalesce(w + INTERVAL 1 HOUR <= mark, false) AS late FROM d JOIN m USING (part))
SELECT w AS window_start, event_type, nullif(count(*) FILTER (NOT late), 0) AS n, CAST(sum(c) FILTER (NOT late) AS BIGINT) AS cents,
  count(*) FILTER (late) AS late
FROM r WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM d) - INTERVAL 1 HOUR GROUP BY w, event_type""")
def t2(spark, d):
    # Delivered in four runs; every 50th event of the first quarter comes with the last one, too late for its hour.
    ev = _t(spark, d, "events").select("event_id", "ts", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("c"))
    last = ev.agg(F.max("event_id")).first()[0] or 0
    chunk = F.floor(F.col("event_id") * 4 / (last + 1))
    part = F.when((chunk == 0) & (F.col("event_id") % 50 == 7), 3).otherwise(chunk)
    given, arrived = _arriving(spark, ev, [part == i for i in range(4)], lambda df: event_windows(
        df, "ts", {"n": F.count(F.lit(1)), "cents": F.sum("c")}, "event_type", size="1 hour", delay="1 hour"))
    return late_rows(given, arrived, "ts", "n", "event_type", size="1 hour", delay="1 hour").drop("window_end")


@query("T3_sessions", """
WITH s AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, user_id, count(*) AS n, max(value) AS most
FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 3 HOUR""")
def t3(spark, d):
    ev = _t(spark, d, "events").select("user_id", "ts", "value")
    given, _ = _arriving(spark, ev, _by_time(ev, "ts", 3), lambda df: event_windows(
        df, "ts", {"n": F.count(F.lit(1)), "most": F.max("value")}, "user_id", gap="2 hours", delay="3 hours"))
    return given


@query("T4_quota_stream", ORACLE["M2_quota_check"])
def t4(spark, d):
    requests = _t(spark, d, "events").selectExpr(
        "event_id AS id", "user_id", "to_date(ts) AS day", "CAST(ts AS timestamp) AS timestamp",
        "CAST(floor(value * 10) AS BIGINT) AS rows_requested", "event_type <> 'error' AS succeeds")
    users = runlog(spark, d)["users"]
    given, _ = _arriving(spark, requests, _by_time(requests, "timestamp", 3),
                         lambda df: quota_stream(df, users, usage.FREE_DAILY_LIMIT, delay="2 days"))
    return given.select(F.col("id").alias("event_id"), "user_id", "day", "rows_requested", "rows_used", "allowed")


@query("T5_balance_stream", ORACLE["M6_running_balance"])
def t5(spark, d):
    t = runlog(spark, d)
    ledger = usage.ledger(t["logs"], t["workflows"], t["transactions"]).select("user_id", "id", "timestamp", "amount")
    ledger = materialize(ledger, "ledger")  # its joins run once, not once a part
    given, _ = _arriving(spark, ledger, _by_time(ledger, "timestamp", 3), running_balance_stream)
    return given.select("user_id", "id", F.col("amount").cast("double").alias("amount"),
                        F.col("balance_after").cast("double").alias("balance_after"))
