"""Steps along time: moving frames, the last value before, as-of joins and joins of overlapping intervals.

A window by key brings a key's rows to one task.  Keys of bounded size keep
it; rows of hot keys (named by a count, as in :mod:`windows`) are cut:

* frames: rows are numbered along (key, order) over the whole table and cut
  into blocks of consecutive numbers; the rows within reach of a border are
  given to the neighbouring block as well (a halo), so each block has all rows
  that its frames look at;
* the last value before: rows are range-partitioned on (key, order), each part
  is filled by itself, and one row a part, its last key and value, carries the
  value on to the parts after it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillet.common import StepError, col, col_list, require_columns, target_partitions, total_order, unique_name
from rillet.operators.windows import DEFAULT_MAX_GROUP_ROWS, _hot_keys, _same_key, _small_enough, _split_hot, row_numbers
from rillet.session import materialize


class Frame(NamedTuple):
    """``func`` of ``column`` over the rows from ``preceding`` before to ``following`` after the current one.

    ``lag`` and ``lead`` take the row ``preceding`` (``following``) rows away, null where there is none.
    """

    func: str
    column: str
    preceding: int = 0
    following: int = 0


_FUNCS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "first": F.first, "last": F.last}


def _over(frame: Frame, window) -> Column:
    if frame.func == "lag":
        return F.lag(col(frame.column), frame.preceding).over(window)
    if frame.func == "lead":
        return F.lead(col(frame.column), frame.following).over(window)
    return _FUNCS[frame.func](col(frame.column)).over(window.rowsBetween(-frame.preceding, frame.following))


def moving_frames(df: DataFrame, partition_by: str | Iterable[str], order_by, frames: Mapping[str, Frame],
                  method: str = "auto", max_group_rows: int = DEFAULT_MAX_GROUP_ROWS,
                  block_rows: int = 1_000_000) -> DataFrame:
    """Adds a column for each of ``frames``, along ``order_by`` (ties by the other columns) within each group.

    Null keys are a group of their own.  ``method``: ``window``, ``blocks`` (rows cut into blocks with halos) or
    ``auto``: groups above ``max_group_rows`` by blocks, all others by a window.
    """
    keys = col_list(partition_by, "partition_by")
    require_columns(df, [*keys, *(f.column for f in frames.values())], "moving_frames")
    for f in frames.values():
        if f.func not in (*_FUNCS, "lag", "lead") or f.preceding < 0 or f.following < 0:
            raise StepError(f"moving_frames: bad frame {f!r}")
    order = total_order(df, order_by, exclude=keys)

    def by_window(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
        return rows.withColumns({name: _over(f, w) for name, f in frames.items()})

    def by_blocks(rows: DataFrame) -> DataFrame:
        at, block, own = (unique_name(df, x) for x in ("__at", "__block", "__own"))
        before = max((f.preceding for f in frames.values()), default=0)
        after = max((f.following for f in frames.values()), default=0)
        size = max(block_rows, before + after + 1)
        numbered = row_numbers(rows, None, [col(k).asc_nulls_first() for k in keys] + order, output=at)
        # A row is in its own block and in those whose frames reach it.
        halo = F.sequence(F.floor((F.col(at) - after) / size), F.floor((F.col(at) + before) / size))
        dealt = numbered.withColumn(block, F.explode(halo)).withColumn(own, F.floor(F.col(at) / size) == F.col(block))
        w = Window.partitionBy(block, *[col(k) for k in keys]).orderBy(at)
        out = dealt.withColumns({name: _over(f, w) for name, f in frames.items()}).where(F.col(own))
        return out.select(*[col(c) for c in df.columns], *frames)

    return _by_hot_keys(df, keys, method, "blocks", max_group_rows, by_window, by_blocks)


def _by_hot_keys(df: DataFrame, keys: list[str], method: str, spread: str, bound: int, plain, cut) -> DataFrame:
    """``plain`` for groups within the bound, ``cut`` for the others."""
    if method not in ("auto", "window", spread):
        raise StepError(f"unknown method {method!r}")
    if method == spread:
        return cut(df)
    if method == "window" or _small_enough(df, bound):
        return plain(df)
    hot = _hot_keys(df, keys, bound)
    if hot is None:
        return cut(df)
    if not hot:
        return plain(df)
    hot_rows, others = _split_hot(df, keys, hot)
    return plain(others).unionByName(cut(hot_rows))


def last_before(df: DataFrame, partition_by: str | Iterable[str], order_by, value: str, output: str,
                method: str = "auto", max_group_rows: int = DEFAULT_MAX_GROUP_ROWS,
                num_partitions: int | None = None) -> DataFrame:
    """Adds ``output``: the last value of ``value`` that is not null, up to and with the row, along ``order_by`` (ties by
    the other columns) within each group."""
    keys = col_list(partition_by, "partition_by", allow_empty=True)
    require_columns(df, [*keys, value], "last_before")
    order = total_order(df, order_by, exclude=keys)
    key_columns = [col(k) for k in keys]

    def plain(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*key_columns).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(output, F.last(col(value), ignorenulls=True).over(w))

    def cut(rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        rid, part, at, carried, first = (unique_name(df, x) for x in ("__rid", "__p", "__i", "__carried", "__first"))
        sort = [c.asc_nulls_first() for c in key_columns] + order + [F.col(rid).asc()]
        sorted_ = rows.withColumn(rid, F.monotonically_increasing_id()) \
            .repartitionByRange(num_partitions or target_partitions(rows), *sort).sortWithinPartitions(*sort) \
            .withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id())
        w = Window.partitionBy(part, *key_columns).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        filled = materialize(sorted_.withColumn(output, F.last(col(value), ignorenulls=True).over(w)), "last-before")
        key = F.struct(F.lit(0).alias("_"), *key_columns)
        ends = sorted(filled.groupBy(part).agg(
            F.min_by(key, at).alias("first"), F.max_by(key, at).alias("last"),
            F.max_by(F.struct(F.col(output).alias("v")), at).alias("value")).collect(), key=lambda r: r[part])
        held, before = None, []  # the last key so far, and its last value; one row a part
        for r in ends:
            if held is not None and _same_key(held[0], r["first"]):
                before.append((r[part], r["first"], held[1]))
                go_on = held[1] if _same_key(r["first"], r["last"]) else None
            else:
                go_on = None
            held = (r["last"], r["value"]["v"] if r["value"]["v"] is not None else go_on)
        kind = T.StructType([T.StructField(part, T.IntegerType()),
                             T.StructField(first, filled.select(key.alias("k")).schema["k"].dataType),
                             T.StructField(carried, filled.schema[output].dataType)])
        joined = filled.join(F.broadcast(spark.createDataFrame(before, kind)), part, "left")
        same = F.coalesce(key.eqNullSafe(F.col(first)), F.lit(False))
        value_ = F.coalesce(F.col(output), F.when(same, F.col(carried)))
        return joined.select(*[col(c) for c in df.columns if c != output], value_.alias(output))

    if not keys:
        return cut(df)
    return _by_hot_keys(df, keys, method, "distributed", max_group_rows, plain, cut)


def asof_join(left: DataFrame, right: DataFrame, on: str | Iterable[str], left_time: str, right_time: str,
              columns: str | Iterable[str] | None = None, how: str = "left", **options) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` of the same key that is the last at or before its time.

    ``columns`` of ``right`` are added (all but ``on``, by default; ``_y`` is put to a name that ``left`` has).  Null keys
    and null times match nothing; of right rows with one time the last by their other columns counts.  ``how="inner"``
    leaves out rows without a match.  Both sides are laid in one line along (key, time), so no pairs are formed;
    ``options`` are those of :func:`last_before`.
    """
    keys = col_list(on, "on")
    require_columns(left, [*keys, left_time], "asof_join (left)")
    require_columns(right, [*keys, right_time], "asof_join (right)")
    if how not in ("left", "inner"):
        raise StepError(f"asof_join: unknown join {how!r}")
    taken = col_list(columns, "columns") if columns is not None else [c for c in right.columns if c not in keys]
    require_columns(right, taken, "asof_join (right)")
    usable = F.col("t").isNotNull()
    for k in keys:
        usable = usable & col(k).isNotNull()

    def side(df: DataFrame, time: str, number: int, row: Column, found: Column) -> DataFrame:
        return df.select(*[col(k).alias(k) for k in keys], col(time).alias("t"), F.lit(number).alias("side"),
                         row.alias("row"), found.alias("found"))

    row = F.struct(*[col(c) for c in left.columns])
    found = F.struct(*[col(c) for c in right.columns])
    types = [T.StructType(d.schema.fields).simpleString() for d in (left, right)]
    for k in ("t", "side", "row", "found"):
        if k in keys:
            raise StepError(f"asof_join: the key must not be called {k!r}")
    mine = side(left, left_time, 1, row, F.lit(None).cast(types[1]))
    line = mine.where(usable).unionByName(
        side(right, right_time, 0, F.lit(None).cast(types[0]), found).where(usable))
    filled = last_before(line, keys, ["t", "side", "found"], "found", "match", **options).where("side = 1")
    rest = mine.where(~usable).withColumn("match", F.col("found"))
    both = filled.unionByName(rest)
    if how == "inner":
        both = both.where(F.col("match").isNotNull())
    names = {c: c if c not in left.columns else unique_name(left, f"{c}_y") for c in taken}
    return both.select(*[F.col("row")[c].alias(c) for c in left.columns],
                       *[F.col("match")[c].alias(n) for c, n in names.items()])


def interval_join(left: DataFrame, right: DataFrame, left_interval: tuple[str, str], right_interval: tuple[str, str],
                  on: str | Iterable[str] | None = None) -> DataFrame:
    """Pairs of rows whose intervals [start, end] overlap (borders count), with equal keys ``on`` if given.

    Bounds are numbers or times.  Of two intervals that overlap, the one that starts later (the right one, if both start
    at once) starts within the other; so pairs are those of an interval and a start that lies in it, each found once.
    Buckets are a quarter of the median length of the intervals; an interval that is longer is put on a level of wider
    ones (each twice as wide), so that it lies in five buckets at most, and meets there the starts of all lengths:
    a start is in one bucket of each level that has intervals.  Null bounds, null keys and intervals that end before
    they start match nothing.  Columns of ``right`` that ``left`` has get ``_y``.
    """
    keys = col_list(on, "on", allow_empty=True)
    for df, bounds, name in ((left, left_interval, "left"), (right, right_interval, "right")):
        require_columns(df, [*keys, *bounds], f"interval_join ({name})")

    def number(df: DataFrame, name: str) -> Column:
        c = col(name)
        kind = df.schema[name].dataType
        if isinstance(kind, T.TimestampNTZType):
            c = c.cast("timestamp")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.unix_micros(c).cast("double")
        return (F.unix_date(c) if isinstance(kind, T.DateType) else c).cast("double")

    def placed(df: DataFrame, bounds: tuple[str, str]) -> DataFrame:
        rows = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"),
                         *[col(k).alias(f"k{i}") for i, k in enumerate(keys)],
                         number(df, bounds[0]).alias("lo"), number(df, bounds[1]).alias("hi"))
        good = F.col("lo") <= F.col("hi")
        for i in range(len(keys)):
            good = good & F.col(f"k{i}").isNotNull()
        return rows.where(good)

    sides = [placed(left, left_interval), placed(right, right_interval)]
    length = F.col("hi") - F.col("lo")
    width = sides[0].select(length.alias("l")).unionByName(sides[1].select(length.alias("l"))) \
        .where("l > 0").agg(F.percentile_approx("l", 0.5)).first()[0] or 1.0
    # Twice the width until an interval is no longer than a bucket.
    level = F.when(length <= width, F.lit(0)).otherwise(F.ceil(F.log2(length / width))).cast("int")
    sides = [s.withColumn("level", level) for s in sides]
    same = ["level", "bucket", *[f"k{i}" for i in range(len(keys))]]
    wide = F.lit(width / 4) * F.pow(F.lit(2.0), F.col("level"))

    def spans(side: DataFrame, name: str) -> DataFrame:
        """A row for each bucket that an interval touches on its level."""
        buckets = F.sequence(F.floor(F.col("lo") / wide), F.floor(F.col("hi") / wide))
        return side.withColumn("bucket", F.explode(buckets)).select(
            *same, F.col("row").alias(f"row_{name}"), F.col("lo").alias("from"), F.col("hi").alias("to"))

    def starts(side: DataFrame, other: DataFrame, name: str) -> DataFrame:
        """A row for the start of each interval on each level that the other side's intervals are on."""
        levels = sorted(r[0] for r in other.select("level").distinct().collect())  # at most some hundred
        every = side.withColumn("level", F.explode(F.lit(levels).cast("array<int>")))
        return every.withColumn("bucket", F.floor(F.col("lo") / wide)).select(
            *same, F.col("row").alias(f"row_{name}"), F.col("lo").alias("start"))

    a, b = sides
    within = F.col("start") <= F.col("to")
    both = spans(a, "a").join(starts(b, a, "b"), same).where((F.col("start") >= F.col("from")) & within) \
        .select("row_a", "row_b").unionByName(
            spans(b, "b").join(starts(a, b, "a"), same).where((F.col("start") > F.col("from")) & within)
            .select("row_a", "row_b"))
    names = {c: c if c not in left.columns else unique_name(left, f"{c}_y") for c in right.columns if c not in keys}
    return both.select(*[F.col("row_a")[c].alias(c) for c in left.columns],
                       *[F.col("row_b")[c].alias(n) for c, n in names.items()])
