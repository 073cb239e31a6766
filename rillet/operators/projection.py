"""Projection, filter and row selection steps (select, drop, filter, nulls, dedupe, derive)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillet.common import StepError, col, col_list, require_columns, present, total_order, unique_name


def select_columns(df: DataFrame, columns: str | Iterable[str]) -> DataFrame:
    """Keep the listed columns, in the listed order."""
    cols = col_list(columns)
    require_columns(df, cols, "select_columns")
    return df.select(*[col(c) for c in cols])


def drop_columns(df: DataFrame, columns: str | Iterable[str]) -> DataFrame:
    """Remove the listed columns; naming a column that is absent is an error."""
    cols = col_list(columns)
    require_columns(df, cols, "drop_columns")
    return df.select(*[col(c) for c in df.columns if c not in cols])


def filter_rows(df: DataFrame, condition: str | Column, null_as: bool | None = None) -> DataFrame:
    """Keep rows where ``condition`` (a Spark SQL predicate) holds.

    SQL rules apply: a row whose condition is NULL is dropped.  ``null_as``
    replaces a NULL verdict by the given boolean instead.
    """
    if isinstance(condition, str):
        if not condition.strip():
            raise StepError("filter: condition is empty")
        cond = F.expr(condition)
    else:
        cond = condition
    if null_as is not None:
        cond = F.coalesce(cond, F.lit(bool(null_as)))
    return df.where(cond)


def remove_nulls(df: DataFrame, columns: str | Iterable[str]) -> DataFrame:
    """Drop rows with a null (or NaN, as the reference treats it) in any listed column."""
    cols = col_list(columns)
    require_columns(df, cols, "remove_nulls")
    return df.where(reduce(lambda a, b: a & b, [present(df, c) for c in cols]))


def deduplicate(df: DataFrame, columns: str | Iterable[str],
                order_by: str | Sequence[str | Column] | None = None) -> DataFrame:
    """Keep the first row per key; null keys are equal to each other.

    "First" follows ``order_by`` with every other column as tie-break.  The
    plan is ``row_number() = 1`` over the key, which Spark executes with a
    partial ``WindowGroupLimit`` before the shuffle: each map task forwards
    at most one row per key, so a key holding a large share of the rows is
    reduced before it moves.
    """
    keys = col_list(columns)
    require_columns(df, keys, "deduplicate")
    rn = unique_name(df, "__rn")
    order = total_order(df, order_by, exclude=keys) or [col(k) for k in keys]
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
    return df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).drop(rn)


def derive_columns(df: DataFrame, expressions: Mapping[str, str | Column]) -> DataFrame:
    """Add or replace columns from SQL expressions (or Columns), all in one projection."""
    if not expressions:
        raise StepError("derive_columns: no expressions")
    cols = {name: (F.expr(e) if isinstance(e, str) else e) for name, e in expressions.items()}
    return df.withColumns(cols)
