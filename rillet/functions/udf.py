"""User functions, in order of preference.

1. :func:`apply_table_function` — a Python function of a Spark DataFrame;
   stays in the optimised plan (use this whenever the logic is expressible
   with DataFrame operations).
2. :func:`scalar_function` — an Arrow-batched pandas scalar UDF.
3. :func:`map_batches` — pandas over Arrow batches of each partition.
4. :func:`apply_groups` — pandas per group.  The whole group is one pandas
   frame in one task: only for groups of bounded size.
5. :func:`apply_groups_salted` — a decomposable per-group computation:
   pandas runs on ``(keys, salt)`` parts (a hot key is spread over
   ``salts`` tasks) and Spark aggregates combine the partial results per
   key (partial aggregation again).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def apply_table_function(df: DataFrame, fn: Callable[..., DataFrame], *args, **kwargs) -> DataFrame:
    return df.transform(fn, *args, **kwargs)


def scalar_function(fn: Callable[..., pd.Series], return_type: T.DataType | str):
    """Wrap ``fn(pd.Series, ...) -> pd.Series`` as a vectorised pandas UDF."""
    return F.pandas_udf(fn, return_type)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
                schema: T.StructType | str) -> DataFrame:
    return df.mapInPandas(fn, schema)


def apply_groups(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame],
                 schema: T.StructType | str) -> DataFrame:
    return df.groupBy(*keys).applyInPandas(fn, schema)


def apply_groups_salted(df: DataFrame, keys: Sequence[str], partial: Callable[[pd.DataFrame], pd.DataFrame],
                        partial_schema: T.StructType | str, combine: Sequence[Column]) -> DataFrame:
    """Per-group pandas work that never holds a whole group in one task.

    ``partial`` gets one Arrow batch of rows at a time, where they are (no shuffle; the batch size is
    ``spark.sql.execution.arrow.maxRecordsPerBatch``). It returns partial results that include the key
    columns (e.g. a pandas groupby over the keys). ``combine`` holds the Spark aggregates that merge the partial
    rows per key.
    """
    partials = df.mapInPandas(lambda frames: (partial(f) for f in frames if len(f)), partial_schema)
    return partials.groupBy(*keys).agg(*combine)
