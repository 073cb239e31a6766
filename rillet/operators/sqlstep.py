"""SQL step: run a Spark SQL query over the current table, visible as ``df``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from rillet.common import StepError


def execute_sql(df: DataFrame, query: str, **tables: DataFrame) -> DataFrame:
    """Run ``query`` where ``df`` (and any name passed as keyword) is a table; ``{df}`` works too.

    The tables are temporary views while the query is analysed, so names are resolved by Spark and literals stay as
    they are; views of the same names that the session has are put back afterwards.  The query is
    merged into the surrounding plan, so filters and column pruning reach the sources of ``df``.
    """
    if not query or not query.strip():
        raise StepError("execute_sql: query is empty")
    spark = df.sparkSession
    views = {"df": df, **tables}
    # A braced name outside of quotes is the name.
    text = re.sub(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|\{(\w+)\}""",
                  lambda m: m[2] if m[2] in views else m[0], query)
    hidden = {v.name: spark.table(v.name) for v in spark.catalog.listTables() if v.isTemporary and v.name in views}
    try:
        for name, frame in views.items():
            frame.createOrReplaceTempView(name)
        return spark.sql(text)
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
        for name, frame in hidden.items():
            frame.createOrReplaceTempView(name)
