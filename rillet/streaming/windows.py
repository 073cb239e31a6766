"""Event-time windows: tumbling, sliding and session windows that close by a watermark, with a count of late rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillet.common import StepError, col, col_list, require_columns

_EPOCH = "1970-01-01 00:00:00"


def event_windows(df: DataFrame, time: str, aggregates: Mapping[str, Column], keys: str | Iterable[str] | None = None,
                  size: str | None = None, slide: str | None = None, gap: str | None = None,
                  delay: str | None = None) -> DataFrame:
    """``window_start, window_end``, keys and aggregates of each event-time window and key.

    ``size`` makes tumbling windows (sliding ones with ``slide``); ``gap`` makes sessions, which end that long after
    their last row.  On a stream ``delay`` is required: a window is over, and given out once, when the latest time seen
    in earlier triggers lies ``delay`` past its end; rows that come later still are left out (see :func:`late_rows`).
    Rows without a time are in no window.
    """
    by = col_list(keys, "keys", allow_empty=True)
    require_columns(df, [time, *by], "event_windows")
    if (size is None) == (gap is None):
        raise StepError("event_windows: give either size or gap")
    if df.isStreaming and delay is None:
        raise StepError("event_windows: a stream needs a delay")
    rows = df.where(col(time).isNotNull())
    zoneless = isinstance(df.schema[time].dataType, T.TimestampNTZType)  # watermarks need a point in time: as if in UTC
    if zoneless:
        micros = F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), col(time))
        rows = rows.withColumn(time, F.timestamp_micros(micros))
    if df.isStreaming:
        rows = rows.withWatermark(time, delay)
    window = F.session_window(col(time), gap) if gap else F.window(col(time), size, slide)
    grouped = rows.groupBy(window.alias("__window"), *[col(k) for k in by]).agg(
        *[a.alias(name) for name, a in aggregates.items()])
    start, end = F.col("__window.start"), F.col("__window.end")
    if zoneless:
        start, end = (F.timestamp_add("MICROSECOND", F.unix_micros(x), F.lit(_EPOCH).cast("timestamp_ntz")) for x in (start, end))
    return grouped.select(start.alias("window_start"), end.alias("window_end"),
                          *[col(k) for k in by], *[col(a) for a in aggregates])


def closed(windows: DataFrame, rows: DataFrame, time: str, delay: str) -> DataFrame:
    """Of batch ``windows``, those that a stream over the same ``rows`` has given out at its end."""
    latest = rows.agg((F.max(col(time)) - F.expr(f"INTERVAL {delay}")).alias("__latest"))
    return windows.join(F.broadcast(latest), F.col("window_end") <= F.col("__latest")).drop("__latest")


def late_rows(given: DataFrame, rows: DataFrame, time: str, count: str, keys: str | Iterable[str] | None = None,
              *, size: str, delay: str) -> DataFrame:
    """``given`` (tumbling windows that a stream gave out, with a row count ``count``) and ``late``: how many rows of
    each window came too late, from all ``rows`` that arrived.  Windows of late rows only have a null count."""
    by = ["window_start", "window_end", *col_list(keys, "keys", allow_empty=True)]
    every = closed(event_windows(rows, time, {"__all": F.count(F.lit(1))}, keys, size=size), rows, time, delay)
    same = [given[k].eqNullSafe(every[k]) for k in by]
    joined = every.join(given, same, "left")
    return joined.select(*[every[k] for k in by], *[given[c] for c in given.columns if c not in by],
                         (F.col("__all") - F.coalesce(given[count], F.lit(0))).alias("late"))
