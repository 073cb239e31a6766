"""Set operations: union by column name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rillet.common import StepError, col


def union_by_name(*tables: DataFrame) -> DataFrame:
    """Union-all by column name; a column missing from a table is null there.

    No shuffle: the result's partitions are the inputs' partitions side by side.
    """
    if not tables:
        raise StepError("union_by_name: no tables")
    return reduce(_two, tables)


def _two(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two; a column that is text in one and of another plain type in the other becomes text."""
    kinds = [{f.name: f.dataType for f in t.schema.fields} for t in (a, b)]
    mixed = [c for c in kinds[0] if c in kinds[1] and kinds[0][c] != kinds[1][c]
             and T.StringType() in (kinds[0][c], kinds[1][c])
             and isinstance(kinds[0][c], T.AtomicType) and isinstance(kinds[1][c], T.AtomicType)]
    if mixed:
        a, b = (t.withColumns({c: col(c).cast("string") for c in mixed}) for t in (a, b))
    return a.unionByName(b, allowMissingColumns=True)
