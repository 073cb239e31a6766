"""Data-quality checks: no nulls, unique values.

All listed checks are evaluated in one aggregate pass and reported
together as ``(rule, column, violations)``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.common import col as column_of
from rillet.common import present, StepError, require_columns

RULES = ("no_nulls", "unique")


def _rules(rules: str | Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    table = json.loads(rules) if isinstance(rules, str) else dict(rules)
    pairs = []
    for rule, cols in table.items():
        if rule not in RULES:
            raise StepError(f"data_quality_check: unknown rule {rule!r}")
        for c in ([cols] if isinstance(cols, str) else cols):
            pairs.append((rule, c))
    if not pairs:
        raise StepError("data_quality_check: no rules")
    return pairs


def quality_report(df: DataFrame, rules: str | Mapping[str, Sequence[str]]) -> DataFrame:
    """``(rule, column, violations)`` for every listed check, from one aggregate.

    ``no_nulls``: rows with a null (or NaN).  ``unique``: rows repeating an earlier
    value (two nulls repeat each other) = rows - distinct values.
    """
    pairs = _rules(rules)
    require_columns(df, [c for _, c in pairs], "data_quality_check")
    aggs = []
    for i, (rule, c) in enumerate(pairs):
        value = F.when(present(df, c), column_of(c))
        if rule == "no_nulls":
            aggs.append(F.count_if(~present(df, c)).alias(f"v{i}"))
        else:
            distinct = F.count_distinct(value) + F.when(F.count_if(value.isNull()) > 0, 1).otherwise(0)
            aggs.append((F.count(F.lit(1)) - distinct).alias(f"v{i}"))
    wide = df.agg(*aggs)
    found = [F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column"), F.col(f"v{i}").cast("bigint").alias("violations"))
             for i, (r, c) in enumerate(pairs)]
    return wide.select(F.inline(F.array(*found)))


def data_quality_check(df: DataFrame, rules: str | Mapping[str, Sequence[str]],
                       raise_on_fail: bool = True) -> DataFrame:
    """Run the checks (one job); raise listing every failure, else return ``df`` unchanged."""
    failed = [r for r in quality_report(df, rules).collect() if r["violations"] > 0]
    if failed and raise_on_fail:
        detail = "; ".join(f"{r['rule']} on {r['column']}: {r['violations']} rows" for r in failed)
        raise StepError(f"data_quality_check failed: {detail}")
    return df


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """The values of ``column`` that occur more than once, with their counts (nulls grouped)."""
    require_columns(df, [column], "repeated_values")
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
