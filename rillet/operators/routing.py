"""Routing and splitting into several outputs.

Every router computes one ``route`` column in a single projection; the
outputs are ``where(route = name)`` views of the same plan and the rows that
continue are ``where(route is null)``.  :func:`write_routes` writes all
outputs in one pass with ``partitionBy``.  A row whose condition is NULL
counts as "not matching", as in the reference.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.common import StepError, col, require_columns, target_partitions, unique_name
from rillet.operators.windows import row_numbers

ROUTE = "route"


class Routed(NamedTuple):
    """``routed``: rows with a non-null ``route`` column; ``rest``: rows that continue;
    ``tagged``: every row with its ``route`` (null for the rows that continue)."""

    routed: DataFrame
    rest: DataFrame
    tagged: DataFrame | None = None

    def outputs(self, names: Sequence[str] | None = None, route: str = ROUTE,
                max_outputs: int | None = None) -> dict[str, DataFrame]:
        """One lazy DataFrame per output name.

        Without ``names`` the route names are listed (one job; the names, one
        entry of the result each, reach the driver).  ``max_outputs`` raises
        for more names than that.  :func:`write_routes` never lists them.
        """
        if names is None:
            found = self.routed.select(route).distinct()
            if max_outputs is not None:
                found = found.limit(max_outputs + 1)
            names = sorted(r[0] for r in found.toLocalIterator())
            if max_outputs is not None and len(names) > max_outputs:
                raise StepError(f"more than {max_outputs} outputs; write them with write_routes")
        return {n: self.routed.where(F.col(route) == n).drop(route) for n in names}


def _verdict(condition: str | Column) -> Column:
    cond = F.expr(condition) if isinstance(condition, str) else condition
    return F.coalesce(cond, F.lit(False))


def _route(df: DataFrame, expr: Column, route: str) -> Routed:
    tagged = df.withColumn(route, expr)
    return Routed(tagged.where(F.col(route).isNotNull()),
                  tagged.where(F.col(route).isNull()).drop(route), tagged)


def route_on_attribute(df: DataFrame, route_column: str, routes: str | Mapping[str, str],
                       route: str = ROUTE) -> Routed:
    """One output per listed value (compared as text); other values and nulls continue."""
    require_columns(df, [route_column], "route_on_attribute")
    table = json.loads(routes) if isinstance(routes, str) else dict(routes)
    if not table:
        raise StepError("route_on_attribute: no routes")
    text = F.col(route_column).cast("string")
    expr = None
    for value, output in table.items():
        expr = (F.when(text == F.lit(str(value)), F.lit(output)) if expr is None
                else expr.when(text == F.lit(str(value)), F.lit(output)))
    return _route(df, expr, route)


def conditional_split(df: DataFrame, conditions: str | Sequence[Mapping[str, str]],
                      route: str = ROUTE) -> Routed:
    """Ordered conditions, first match wins; unmatched rows continue."""
    specs = json.loads(conditions) if isinstance(conditions, str) else list(conditions)
    if not specs:
        raise StepError("conditional_split: no conditions")
    expr = None
    for s in specs:
        if not s.get("condition") or not s.get("output"):
            raise StepError(f"conditional_split: incomplete spec {s!r}")
        v = _verdict(s["condition"])
        expr = F.when(v, F.lit(s["output"])) if expr is None else expr.when(v, F.lit(s["output"]))
    return _route(df, expr, route)


def branching(df: DataFrame, condition: str | Column, route: str = ROUTE) -> Routed:
    """Rows go to ``true`` or ``false`` (a null verdict is false); nothing continues."""
    tagged = df.withColumn(route, F.when(_verdict(condition), F.lit("true")).otherwise(F.lit("false")))
    return Routed(tagged, df.limit(0), tagged)


def dynamic_split(df: DataFrame, split_key: str, output_prefix: str = "split_",
                  route: str = ROUTE) -> Routed:
    """One output per distinct key value, named ``<prefix><value>``; ``/`` and ``\\`` become ``_``, with a digest where
    that would be the name of another value too.

    Rows with a null key go nowhere; nothing continues.
    """
    require_columns(df, [split_key], "dynamic_split")
    value = col(split_key).cast("string")
    safe = F.regexp_replace(value, r"[/\\]", "_")
    name, keyed = safe, df
    if not df.isStreaming:
        # Values that would share a name: those whose name was changed get a digest of the value.
        own = unique_name(df, "__own")
        key = unique_name(df, "__value")
        values = df.select(value.alias(key), safe.alias("name")).distinct()
        shared = values.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        clashing = values.join(shared, "name", "left_semi").where(F.col("name") != F.col(key)) \
            .select(key, F.concat("name", F.lit("-"), F.substring(F.md5(key), 1, 8)).alias(own))
        keyed = df.join(clashing, value == clashing[key], "left")
        name = F.coalesce(F.col(own), safe)
    tagged = keyed.select(*[col(c) for c in df.columns if c != route], F.concat(F.lit(output_prefix), name).alias(route))
    return Routed(tagged.where(F.col(route).isNotNull()), df.limit(0), tagged)


def split_records(df: DataFrame, max_rows: int = 1000, condition: str | Column | None = None,
                  order_by=None, chunk: str = "chunk", output_prefix: str | None = None, **numbering) -> Routed:
    """Cut the (matching) rows into numbered chunks of at most ``max_rows`` rows.

    ``chunk = (row_number - 1) div max_rows + 1`` over ``order_by`` with a
    distributed row number (no task sees more than one partition of rows).
    The rows that continue are the non-matching ones, or the whole table
    when every row matched or no condition is given.  With ``output_prefix``
    a ``route`` column names each row's output, ``<prefix><chunk>``.
    """
    if int(max_rows) < 1:
        raise StepError("split_records: max_rows must be positive")
    if condition is not None:
        v = _verdict(condition)
        matching, rest = df.where(v), df.where(~v)
        if rest.isEmpty():
            rest = df
    else:
        matching, rest = df, df
    rn = unique_name(df, "__rn")
    numbered = row_numbers(matching, None, order_by, output=rn, **numbering)
    chunks = numbered.withColumn(chunk, (F.floor((F.col(rn) - 1) / int(max_rows)) + 1).cast("bigint")).drop(rn)
    if output_prefix is not None:
        chunks = chunks.withColumn(ROUTE, F.concat(F.lit(output_prefix), F.col(chunk).cast("string")))
    return Routed(chunks, rest)


def write_routes(routed: DataFrame, path: str, fmt: str = "csv", route: str = ROUTE,
                 mode: str = "errorifexists", max_records_per_file: int | None = None) -> None:
    """Write every output in one pass, one directory per route value.

    Rows are range-partitioned on ``(route, row hash)`` first, so each task
    writes few directories and a route holding most rows is still spread
    over many tasks.
    """
    from rillet.sources.files import sink_options

    n = target_partitions(routed)
    spread = F.xxhash64(*[col(c) for c in routed.columns])
    out = routed.repartitionByRange(n, F.col(route), spread)
    writer = out.write.mode(mode).partitionBy(route).format(fmt)
    writer = writer.options(**sink_options(fmt))
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", int(max_records_per_file))
    writer.save(path)
