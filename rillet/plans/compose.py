"""Compose steps into one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


def chain(*steps: Step) -> Step:
    """``chain(f, g, h)(df) == df.transform(f).transform(g).transform(h)``.

    Nothing runs until an action: the steps become one logical plan, so a
    later filter or projection reaches the scan of an earlier source.
    """
    return lambda df: reduce(lambda acc, step: acc.transform(step), steps, df)
