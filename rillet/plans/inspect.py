"""Read the physical plan of a DataFrame (used by plan tests)."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def plan_has(df: DataFrame, text: str) -> bool:
    return text in physical_plan(df)
