"""Grouped aggregation and pivot.

Rows whose group key is null are dropped (the reference's grouping rule).
Spark aggregates in two phases (partial per map task, final after the
shuffle), so a key holding a large share of the rows is combined before it
moves and never collects its rows in one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.common import StepError, col, col_list, present, require_columns

#: Parts the values of several pivot columns until the names are made.
_APART = "\x1f"
AGG_FUNCS = ("sum", "mean", "count", "min", "max")


def agg_expr(column: str, func: str) -> Column:
    """The aggregate for one of the reference's five function names.

    ``sum`` of an all-null group is 0, as in the reference (SQL gives NULL).
    """
    c = col(column)
    if func == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if func in ("mean", "avg"):
        return F.avg(c)
    if func == "count":
        return F.count(c)
    if func == "min":
        return F.min(c)
    if func == "max":
        return F.max(c)
    raise StepError(f"aggregate: unsupported function {func!r}; use one of {', '.join(AGG_FUNCS)}")


def _drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = None
    for k in keys:
        c = present(df, k)
        cond = c if cond is None else cond & c
    return df.where(cond)


def aggregate(df: DataFrame, group_by: str | Iterable[str], agg_column: str, agg_func: str) -> DataFrame:
    """One aggregate of one column per group; the result keeps the column's name."""
    keys = col_list(group_by, "group_by")
    require_columns(df, keys + [agg_column], "aggregate")
    if agg_column in keys:
        raise StepError(f"aggregate: {agg_column!r} is also a group key")
    return _drop_null_keys(df, keys).groupBy(*[col(k) for k in keys]).agg(agg_expr(agg_column, agg_func).alias(agg_column))


def aggregate_multiple(df: DataFrame, group_by: str | Iterable[str],
                       aggregations: str | Sequence[Mapping[str, str]]) -> DataFrame:
    """Several ``{column, func, output_column}`` aggregates in one pass.

    Two functions on the same column are allowed (each has its own output name).
    """
    keys = col_list(group_by, "group_by")
    specs = json.loads(aggregations) if isinstance(aggregations, str) else list(aggregations)
    if not specs:
        raise StepError("aggregate_multiple: no aggregations")
    for s in specs:
        if not {"column", "func", "output_column"} <= set(s):
            raise StepError(f"aggregate_multiple: incomplete spec {s!r}")
    require_columns(df, keys + [s["column"] for s in specs], "aggregate_multiple")
    outs = [s["output_column"] for s in specs]
    if len(set(outs)) != len(outs) or set(outs) & set(keys):
        raise StepError("aggregate_multiple: output column names must be distinct from each other and the keys")
    exprs = [agg_expr(s["column"], s["func"]).alias(s["output_column"]) for s in specs]
    return _drop_null_keys(df, keys).groupBy(*[col(k) for k in keys]).agg(*exprs)


def pivot(df: DataFrame, index: str | Iterable[str], columns: str | Iterable[str], values: str,
          aggfunc: str = "mean", pivot_values: Sequence | None = None, sep: str = "_") -> DataFrame:
    """Rows = index keys, one column per distinct pivot value, cells = aggregate.

    Several pivot columns are joined into one name with ``sep``; equal names of different tuples are
    numbered.  The sum of a cell whose values are all null is 0.  Giving
    ``pivot_values`` fixes the output schema and skips the pass that finds
    the distinct values (bounded by ``spark.sql.pivotMaxValues``).  Rows with
    a null index or pivot key are dropped; an absent cell is null.
    ``aggfunc``: sum, mean, count, min, max, and the other order-free pandas
    names that aggregate partially: std and var (sample), nunique.
    """
    idx = col_list(index, "pivot_index")
    pcols = col_list(columns, "pivot_columns")
    require_columns(df, idx + pcols + [values], "pivot")
    extra = {"std": F.stddev_samp, "var": F.var_samp, "nunique": F.count_distinct}
    if aggfunc not in ("sum", "mean", "count", "min", "max", *extra):
        raise StepError(f"pivot: unsupported aggfunc {aggfunc!r}")
    data = _drop_null_keys(df, idx + pcols)
    if len(pcols) == 1:
        pkey = pcols[0]
    else:
        pkey = "__pivot_key"
        inner = sep if pivot_values is not None else _APART
        data = data.withColumn(pkey, F.concat_ws(inner, *[col(c).cast("string") for c in pcols]))
    grouped = data.groupBy(*[col(c) for c in idx])
    grouped = grouped.pivot(pkey, list(pivot_values)) if pivot_values is not None else grouped.pivot(pkey)
    if aggfunc in extra:
        out = grouped.agg(extra[aggfunc](col(values)))
    else:
        out = grouped.agg(agg_expr(values, aggfunc))
    if len(pcols) == 1 or pivot_values is not None:
        return out
    # Different tuples may have one joined name: the later ones (in order of the tuples) get a number.
    names: list[str] = list(idx)
    for c in out.columns[len(idx):]:
        name, i = c.replace(_APART, sep), 1
        while name in names:
            i += 1
            name = f"{c.replace(_APART, sep)}{sep}{i}"
        names.append(name)
    return out.toDF(*names)
