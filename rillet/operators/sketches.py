"""Mergeable sketches: distinct counts and quantiles kept by day and merged without reading the rows again.

A sketch table has a row for each group (a day and whatever else is grouped by) with the row count, a HyperLogLog
sketch for each counted column and a KLL sketch for each measured one.  Rows of further days are sketched by
themselves and appended; any coarser grouping is a merge of sketches of some kilobytes each.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.common import StepError, col, col_list, require_columns

#: Registers (as a power of two) and the relative error of distinct counts that three standard errors allow.
DISTINCT_LG, DISTINCT_ERROR = 14, 0.025
#: Size of the quantile sketches, and how far (in rank, as a share of the rows) a quantile is off at most, 99 times of 100.
QUANTILE_K, QUANTILE_ERROR = 800, 0.006


def sketch_table(df: DataFrame, by: str | Iterable[str], distinct: Mapping[str, str] | None = None,
                 quantiles: Mapping[str, str] | None = None) -> DataFrame:
    """``by``, ``n`` (rows), ``<name>_hll`` of each ``distinct`` and ``<name>_kll`` of each ``quantiles`` (name: column).

    Null values are not counted or measured; a group of nulls alone has an empty distinct sketch and a null quantile
    sketch.  Null keys are a group.  Sketches are made per task and merged, so no group comes to one task whole.
    """
    keys = col_list(by, "by")
    distinct, quantiles = dict(distinct or {}), dict(quantiles or {})
    require_columns(df, [*keys, *distinct.values(), *quantiles.values()], "sketch_table")
    if not distinct and not quantiles:
        raise StepError("sketch_table: nothing to sketch")
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, column in distinct.items():
        aggs.append(F.hll_sketch_agg(col(column).cast("string"), F.lit(DISTINCT_LG)).alias(f"{name}_hll"))
    for name, column in quantiles.items():
        sketch = F.kll_sketch_agg_double(col(column).cast("double"), F.lit(QUANTILE_K))
        aggs.append(F.when(F.count(col(column)) > 0, sketch).alias(f"{name}_kll"))
    return df.groupBy(*[col(k) for k in keys]).agg(*aggs)


def _names(table: DataFrame, suffix: str) -> list[str]:
    return [c for c in table.columns if c.endswith(suffix)]


def merge_sketches(table: DataFrame, by: str | Iterable[str] | None = None) -> DataFrame:
    """The sketch table by ``by`` (fewer columns than before, or none: one row), from the sketches alone."""
    keys = col_list(by, "by", allow_empty=True)
    require_columns(table, keys, "merge_sketches")
    aggs = [F.sum("n").cast("bigint").alias("n")]
    aggs += [F.hll_union_agg(c).alias(c) for c in _names(table, "_hll")]
    aggs += [F.when(F.count(c) > 0, F.kll_merge_agg_double(c, F.lit(QUANTILE_K))).alias(c) for c in _names(table, "_kll")]
    return table.groupBy(*[col(k) for k in keys]).agg(*aggs)


def read_sketches(table: DataFrame, probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The table with its estimates: ``<name>_distinct`` (within ``DISTINCT_ERROR`` of the count) and
    ``<name>_quantiles``, an array of the values at ``probabilities`` (within ``QUANTILE_ERROR`` in rank; null without
    values)."""
    out = [col(c) for c in table.columns if not c.endswith(("_hll", "_kll"))]
    out += [F.hll_sketch_estimate(c).alias(c[:-4] + "_distinct") for c in _names(table, "_hll")]
    out += [F.array(*[F.kll_sketch_get_quantile_double(c, F.lit(float(p))) for p in probabilities])
            .alias(c[:-4] + "_quantiles") for c in _names(table, "_kll")]
    return table.select(*out)
