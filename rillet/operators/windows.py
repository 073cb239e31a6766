"""Window steps (rank, row number, running sum) and skew-safe row numbering.

A plain ``Window.partitionBy(k)`` sends every row of a group to one task.
That is fine while groups are bounded, and :func:`row_numbers` proves the
bound first: a row count of the table, else per-key counts that name the
hot keys (groups above the bound).  Rows of hot keys are numbered
distributed, all other rows with the plain window:

1. range-partition on ``(keys, order, tie-breaks, row id)`` — the row id makes
   every sort key unique, so the sampled range bounds can cut a hot group
   across many partitions — and sort inside each partition;
2. tag each row with its partition ``P`` and position ``I``;
3. number rows inside ``(P, keys)`` with a window (no group exceeds a
   partition), then materialise once as a parquet table in the shared
   checkpoint folder (survives executor loss; later passes read only the
   columns they need);
4. one row of boundary statistics per partition (first / last key, size of
   the last run) goes to the driver — bounded by the partition count — and
   gives, per partition, the rows its first key already had in earlier
   partitions;
5. that offset is broadcast back on ``P``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillet.common import (StepError, col, col_list, estimated_bytes, require_columns, target_partitions,
                           total_order, unique_name)
from rillet.session import checkpoint_root, materialize

#: groups up to this many rows are numbered with a plain window
DEFAULT_MAX_GROUP_ROWS = 5_000_000


def _plain(df: DataFrame, keys, order, rn_out, value, sum_out) -> DataFrame:
    """Plain window numbering; only for keyed groups proven to be bounded."""
    w = Window.partitionBy(*keys).orderBy(*order)
    cols = {rn_out: F.row_number().over(w).cast("bigint")}
    if value is not None:
        cols[sum_out] = F.sum(F.col(value)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumns(cols)


def _same_key(a, b) -> bool:
    """Equal keys, where a null equals a null and NaN equals NaN, as in Spark's grouping."""
    return all(x == y or (x is None and y is None) or (x != x and y != y) for x, y in zip(a, b, strict=True))


def _plus(a, b):
    return b if a is None else a if b is None else a + b


def _distributed(df: DataFrame, keys, order, rn_out, value, sum_out, num_partitions,
                 partition_column=None) -> DataFrame:
    spark = df.sparkSession
    checkpoint_root(spark)
    n = num_partitions or target_partitions(df)
    rid, P, I = unique_name(df, "__rid"), unique_name(df, "__p"), unique_name(df, "__i")
    sort = [col(k).asc_nulls_first() for k in keys] + order + [F.col(rid).asc()]
    tagged = (df.withColumn(rid, F.monotonically_increasing_id())
              .repartitionByRange(n, *sort).sortWithinPartitions(*sort)
              .withColumn(P, F.spark_partition_id())
              .withColumn(I, F.monotonically_increasing_id()))
    if keys:
        w = Window.partitionBy(P, *keys).orderBy(I)
        local = {rn_out: F.row_number().over(w).cast("bigint")}
        if value is not None:
            local[sum_out] = F.sum(F.col(value)).over(w.rowsBetween(Window.unboundedPreceding, 0))
        tagged = tagged.withColumns(local)
    else:
        tagged = tagged.withColumn(rn_out, F.col(I) - F.shiftleft(F.col(P).cast("bigint"), 33) + 1)
        if value is not None:
            raise StepError("running sum without partition keys is not supported")
    tagged = materialize(tagged, "numbering")

    kstruct = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    aggs = [F.count(F.lit(1)).alias("total"),
            F.min_by(kstruct, F.col(I)).alias("first"),
            F.max_by(kstruct, F.col(I)).alias("last"),
            F.max_by(F.col(rn_out), F.col(I)).alias("last_run")]
    if value is not None:
        aggs.append(F.max_by(F.col(sum_out), F.col(I)).alias("last_sum"))
    stats = sorted(tagged.groupBy(P).agg(*aggs).collect(), key=lambda r: r[P])

    # rows (and sums) of each partition's first key that precede it
    offsets = []
    prev = None  # (last key, run count, run sum, partition was a single run)
    carry_n, carry_s = 0, None
    for r in stats:
        if keys:
            if prev is not None and _same_key(prev[0], r["first"]):
                before_n, before_s = carry_n, carry_s
            else:
                before_n, before_s = 0, None
            single = _same_key(r["first"], r["last"])
            run_n = r["last_run"] + (before_n if single else 0)
            run_s = _plus(r["last_sum"], before_s if single else None) if value is not None else None
            carry_n, carry_s = run_n, run_s
            prev = (r["last"],)
        else:
            before_n, before_s = carry_n, None
            carry_n += r["total"]
        offsets.append((r[P], before_n, before_s if value is not None else None, r["first"] if keys else None))

    if value is not None:
        stype = tagged.schema[sum_out].dataType
        conv = (float if isinstance(stype, (T.DoubleType, T.FloatType)) else
                Decimal if isinstance(stype, T.DecimalType) else int)
        offsets = [(p, n_, None if s_ is None else conv(s_), f) for p, n_, s_, f in offsets]
    off_n, off_s, first = (unique_name(tagged, x) for x in ("__off_n", "__off_s", "__first"))
    fields = [T.StructField(P, T.IntegerType()), T.StructField(off_n, T.LongType()),
              T.StructField(off_s, tagged.schema[sum_out].dataType if value is not None else T.LongType())]
    if keys:
        fields.append(T.StructField(first, tagged.select(kstruct.alias("k")).schema["k"].dataType))
        rows = offsets
    else:
        rows = [o[:3] for o in offsets]
    off_df = spark.createDataFrame(rows, T.StructType(fields))
    joined = tagged.join(F.broadcast(off_df), P, "left")
    if keys:
        same = F.coalesce(kstruct.eqNullSafe(F.col(first)), F.lit(False))
        add_n = F.when(same, F.col(off_n)).otherwise(F.lit(0))
        cols = {rn_out: F.col(rn_out) + add_n}
        if value is not None:
            # Null until a value comes; then what came before, in earlier partitions too, counts.
            before = F.when(same, F.col(off_s))
            cols[sum_out] = F.coalesce(F.col(sum_out) + before, F.col(sum_out), before)
    else:
        cols = {rn_out: F.col(rn_out) + F.coalesce(F.col(off_n), F.lit(0))}
    extra = [F.col(P).alias(partition_column)] if partition_column else []
    return joined.withColumns(cols).select(*df.columns, rn_out, *([sum_out] if value is not None else []), *extra)


#: at most this many hot keys are listed and split off; more hot keys than that number everything distributed
MAX_HOT_KEYS = 10_000
#: below this estimated size a row count is tried first (cheap); larger inputs go straight to per-key counts
COUNT_FIRST_BYTES = 1 << 30


def _small_enough(df: DataFrame, bound: int) -> bool:
    """A cheap proof for small inputs: the table's row count is within the bound.

    Only tried when the optimizer's size estimate (no job) is small; a large
    input skips it, because the per-key counts that follow decide anyway.
    """
    return estimated_bytes(df) <= COUNT_FIRST_BYTES and df.count() <= bound


def _hot_keys(df: DataFrame, keys: Sequence[str], bound: int) -> list | None:
    """Keys whose group exceeds ``bound`` rows (None: more than ``MAX_HOT_KEYS`` of them)."""
    hot = (df.groupBy(*keys).count().where(F.col("count") > bound).select(*keys)
           .limit(MAX_HOT_KEYS + 1).collect())
    return None if len(hot) > MAX_HOT_KEYS else hot


def _split_hot(df: DataFrame, keys: Sequence[str], hot: list) -> tuple[DataFrame, DataFrame]:
    """``(rows of hot keys, all other rows)`` via a broadcast of the (bounded) hot-key list."""
    hot_df = F.broadcast(df.sparkSession.createDataFrame(hot, df.select(*keys).schema))
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(hot_df[k])
        cond = c if cond is None else cond & c
    return df.join(hot_df, cond, "left_semi"), df.join(hot_df, cond, "left_anti")


def row_numbers(df: DataFrame, partition_by: str | Iterable[str] | None, order_by,
                output: str = "row_number", value: str | None = None, sum_output: str | None = None,
                max_group_rows: int | None = DEFAULT_MAX_GROUP_ROWS, num_partitions: int | None = None,
                method: str = "auto", partition_column: str | None = None) -> DataFrame:
    """1-based row number (and optional running sum of ``value``) per group.

    Order is ``order_by`` then every other column.  ``method``: ``"window"``
    (plain window), ``"distributed"`` (skew-safe, see module notes) or
    ``"auto"``: a table of at most ``max_group_rows`` rows is numbered with a
    plain window; otherwise the per-key counts find the hot keys (groups
    above the bound), whose rows are numbered distributed while all other
    rows take the plain window (bounded groups), and the two are unioned.
    Without partition keys the numbering is always distributed (a global
    window would move every row to one task).  ``partition_column`` keeps the
    range partition of each row (distributed method; for inspection).
    """
    keys = col_list(partition_by, "partition_by", allow_empty=True)
    require_columns(df, keys, "row_numbers")
    order = total_order(df, order_by, exclude=keys)
    sum_out = sum_output or f"{value}_running_sum"
    if not keys or method == "distributed" or (method == "auto" and max_group_rows is None):
        return _distributed(df, keys, order, output, value, sum_out, num_partitions, partition_column)
    if method == "window" or _small_enough(df, max_group_rows):
        return _plain(df, keys, order, output, value, sum_out)
    hot = _hot_keys(df, keys, max_group_rows)
    if hot is None:
        return _distributed(df, keys, order, output, value, sum_out, num_partitions)
    if not hot:
        return _plain(df, keys, order, output, value, sum_out)
    hot_rows, other_rows = _split_hot(df, keys, hot)
    return (_plain(other_rows, keys, order, output, value, sum_out)
            .unionByName(_distributed(hot_rows, keys, order, output, value, sum_out, num_partitions)))


def ordered_rank(df: DataFrame, partition_by: str | Iterable[str], order_by: str | Sequence[str],
                 output: str = "rank", ties: str = "average", method: str = "auto",
                 max_group_rows: int | None = DEFAULT_MAX_GROUP_ROWS, num_partitions: int | None = None) -> DataFrame:
    """Rank of ``order_by`` inside each partition (pandas ``groupby(k)[o].rank``).

    Ties get the average of their positions (``ties="average"``, pandas'
    default) or the lowest (``"min"``, SQL ``RANK``).  Rows with a null key or
    a null order value get null and are left out of the ranking.

    Bounded groups (proven as in :func:`row_numbers`) use ``rank()`` and a
    tie count over ``(keys, order)`` — both windows share the key
    partitioning, so one pass.  Rows of hot keys are counted by tie group
    instead (partial aggregation); a skew-safe running sum of the counts gives
    each tie group its last position, joined back on the tie group.  So only
    the tie groups are put in order: the rows move once, for that join, and
    not at all where the tie groups are few enough to be broadcast.
    """
    keys = col_list(partition_by, "partition_by")
    order = col_list(order_by, "order_by")
    require_columns(df, keys + order, "ordered_rank")
    if ties not in ("average", "min"):
        raise StepError(f"ordered_rank: unknown ties {ties!r}")
    tie = keys + order
    present = " AND ".join(f"`{c}` IS NOT NULL" for c in tie)
    ranked_rows = df.where(present)

    def window_rank(rows: DataFrame) -> DataFrame:
        low = F.rank().over(Window.partitionBy(*keys).orderBy(*[F.col(c) for c in order]))
        if ties == "average":
            n_ties = F.count(F.lit(1)).over(Window.partitionBy(*tie))
            return rows.withColumn(output, low + (n_ties - 1) / 2.0)
        return rows.withColumn(output, low.cast("double"))

    def distributed_rank(rows: DataFrame) -> DataFrame:
        n, last, place = (unique_name(df, x) for x in ("__n", "__last", "__rn"))
        counts = materialize(rows.groupBy(*[col(c) for c in tie]).agg(F.count(F.lit(1)).alias(n)), "ties")
        ends = row_numbers(counts, keys, order, output=place, value=n, sum_output=last,
                           max_group_rows=max_group_rows or DEFAULT_MAX_GROUP_ROWS, num_partitions=num_partitions)
        value = F.col(last) - (F.col(n) - 1) / 2.0 if ties == "average" else (F.col(last) - F.col(n) + 1).cast("double")
        ranks = materialize(ends.select(*[col(c) for c in tie], value.alias(output)), "tie-ranks")
        return rows.join(ranks, tie, "inner").select(*[col(c) for c in df.columns], output)

    if method == "window" or (method == "auto" and max_group_rows is not None
                              and _small_enough(ranked_rows, max_group_rows)):
        ranked = window_rank(ranked_rows)
    elif method == "distributed" or max_group_rows is None:
        ranked = distributed_rank(ranked_rows)
    else:
        hot = _hot_keys(ranked_rows, keys, max_group_rows)
        if hot is None:
            ranked = distributed_rank(ranked_rows)
        elif not hot:
            ranked = window_rank(ranked_rows)
        else:
            hot_rows, other_rows = _split_hot(ranked_rows, keys, hot)
            ranked = window_rank(other_rows).select(*df.columns, output).unionByName(distributed_rank(hot_rows))
    rest = df.where(f"NOT ({present})").withColumn(output, F.lit(None).cast("double"))
    return ranked.select(*df.columns, output).unionByName(rest)


def window_function(df: DataFrame, function: str, partition_by: str, output_column: str | None = None,
                    order_by=None, **numbering) -> DataFrame:
    """The reference's window step over one partition column.

    * ``rank``: rank of the partition column inside its own partition.  Every
      row ties, so the value is the average rank ``(n + 1) / 2``; computed as
      a grouped count joined back (partial aggregation, no group in one task).
      With ``order_by``, the rank of that order instead (:func:`ordered_rank`).
    * ``row_number``: position within the partition in ``order_by`` order.
    * ``cumsum``: running sum of the partition column itself, i.e. ``k * row_number``.

    A null partition key gives null.
    """
    keys = col_list(partition_by, "partition_by")
    if len(keys) != 1:
        raise StepError("window_function: partition_by takes one column")
    k = keys[0]
    require_columns(df, [k], "window_function")
    out = output_column or f"{function}_result"
    if function == "rank" and order_by is not None:
        return ordered_rank(df, [k], order_by, output=out, **numbering)
    if function == "rank":
        cnt = unique_name(df, "__n")
        counts = df.where(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias(cnt))
        joined = df.join(counts, on=k, how="left")
        return joined.withColumn(out, (F.col(cnt) + 1) / 2.0).select(*df.columns, out)
    if function in ("row_number", "cumsum"):
        if order_by is None:
            raise StepError("window_function: row_number and cumsum need order_by")
        if function == "cumsum" and not isinstance(df.schema[k].dataType, T.NumericType):
            raise StepError("window_function: cumsum needs a numeric partition column")
        rn = unique_name(df, "__rn")
        nonnull = df.where(F.col(k).isNotNull())
        numbered = row_numbers(nonnull, [k], order_by, output=rn, **numbering)
        val = F.col(rn) if function == "row_number" else F.col(k) * F.col(rn)
        numbered = numbered.withColumn(out, val).drop(rn)
        nulls = df.where(F.col(k).isNull()).withColumn(out, F.lit(None).cast(numbered.schema[out].dataType))
        return numbered.unionByName(nulls)
    raise StepError(f"window_function: unknown function {function!r}")
