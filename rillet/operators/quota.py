"""Time-ordered daily quota: each run is judged by what the runs before it have used.

A refused run uses nothing, so every verdict depends on the ones before it and
no window sum gives them.  The rule is a fold along ``(user, day, time)``.
Requests are range-partitioned and sorted; each task folds its rows, the
first run of rows with one key as if nothing was used before.  Whether that
holds is only known when the partitions before are: a run of requests is a map
from what was used before it to what is used after it, such maps compose, and
one summary row a partition gives every partition the rows its first key has
used.  Only first runs that began earlier are folded again, so a user with most
of the requests is spread over partitions like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillet.common import require_columns, target_partitions, total_order
from rillet.session import materialize

#: A usage map: pieces (start, shift); usage u from a piece's start on (up to the next one's) becomes u + shift.
Pieces = list[tuple[int, int]]

_KEY, _BODY = ("user_id", "day"), ("rows_requested", "succeeds", "limit")


def verdict(used: int, rows: int, succeeds: bool, limit: int | None) -> tuple[bool, int]:
    """Whether a run of ``rows`` is allowed after ``used`` rows, and what is used after it (no limit: None)."""
    allowed = limit is None or used + rows <= limit
    return allowed, used + rows if allowed and succeeds else used


def then(pieces: Pieces, rows: int, succeeds: bool, limit: int | None) -> Pieces:
    """The map ``pieces`` followed by one run."""
    if not succeeds or rows == 0:
        return pieces
    out: Pieces = []

    def add(start: int, shift: int) -> None:
        if not out or out[-1][1] != shift:
            out.append((start, shift))

    for i, (start, shift) in enumerate(pieces):
        if limit is None:
            add(start, shift + rows)
            continue
        most = limit - rows - shift  # the largest usage of the piece that is still allowed
        end = pieces[i + 1][0] if i + 1 < len(pieces) else None
        if start <= most:
            add(start, shift + rows)
        if end is None or most + 1 < end:
            add(max(start, most + 1), shift)
    return out


def apply_pieces(pieces: Pieces, used: int) -> int:
    shift = 0
    for start, piece in pieces:
        if start > used:
            break
        shift = piece
    return used + shift


def _folded(rows: list[tuple], used: int) -> tuple[list[int], list[bool], int]:
    """Usage before and verdict of each of the rows (rows, succeeds, limit) of one key."""
    before, allowed = [], []
    for n, succeeds, limit in rows:
        ok, after = verdict(used, n, succeeds, limit)
        before.append(used)
        allowed.append(ok)
        used = after
    return before, allowed, used


def _rows_of(batch: pa.RecordBatch | pa.Table, *columns: str) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))


def _first_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds a sorted partition; ``first_run`` marks the rows of its first key."""
    first = last = None
    used = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, body = _rows_of(batch, *_KEY), _rows_of(batch, *_BODY)
        if first is None:
            first = last = keys[0]
        before: list[int] = []
        allowed: list[bool] = []
        runs: list[bool] = []
        for key, group in groupby(zip(keys, body, strict=True), key=lambda x: x[0]):
            rows = [x[1] for x in group]
            if key != last:
                used, last = 0, key
            some, ok, used = _folded(rows, used)
            before += some
            allowed += ok
            runs += [key == first] * len(rows)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(before, pa.int64()), pa.array(allowed, pa.bool_()), pa.array(runs, pa.bool_())],
            [*batch.schema.names, "rows_used", "allowed", "first_run"])


def _summary(key: tuple, rows: pa.Table) -> pa.Table:
    """The usage map of a partition's first run (its rows in order)."""
    pieces: Pieces = [(0, 0)]
    for n, succeeds, limit in _rows_of(rows.sort_by("place"), *_BODY):
        pieces = then(pieces, n, succeeds, limit)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()),
                     "starts": pa.array([[s for s, _ in pieces]], pa.list_(pa.int64())),
                     "shifts": pa.array([[d for _, d in pieces]], pa.list_(pa.int64()))})


def quota_check(requests: DataFrame, users: DataFrame, limit: int, num_partitions: int | None = None) -> DataFrame:
    """Decide each requested run in order of (timestamp, id): adds ``rows_used`` and ``allowed``.

    ``requests`` has ``user_id, day, timestamp, id, rows_requested, succeeds`` (further columns stay).  ``rows_used``
    are the rows of the user's earlier allowed and successful runs of the day.  A run is refused when these and its
    own rows pass ``limit``; a refused or failed run uses nothing.  Subscribers (``users``: ``id, is_subscribed``)
    have no limit; unknown users have one.  A null user or day is a user or day of its own, null rows count as 0,
    null ``succeeds`` as false, and ties in time and id go by the other columns.  Rows must not be negative.
    """
    wanted = ["user_id", "day", "timestamp", "id", "rows_requested", "succeeds"]
    require_columns(requests, wanted, "quota_check")
    u = users.select(F.col("id").alias("user_id"), F.coalesce("is_subscribed", F.lit(False)).alias("__free")) \
        .groupBy("user_id").agg(F.max("__free").alias("__free"))
    rows = requests.join(u, "user_id", "left").select(
        *[F.col(f"`{c}`") for c in requests.columns],
        F.when(F.coalesce("__free", F.lit(False)), F.lit(None)).otherwise(F.lit(limit)).cast("bigint").alias("__limit"))
    order = [F.col(c).asc_nulls_first() for c in _KEY] + total_order(
        requests, ["timestamp", "id"], exclude=list(_KEY))
    body = rows.repartitionByRange(num_partitions or target_partitions(requests), *order).sortWithinPartitions(*order)
    inner = body.select(
        F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("row"), *_KEY,
        F.coalesce(F.col("rows_requested").cast("bigint"), F.lit(0)).alias("rows_requested"),
        F.coalesce("succeeds", F.lit(False)).alias("succeeds"), F.col("__limit").alias("limit"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    schema = T.StructType([*inner.schema.fields, T.StructField("rows_used", T.LongType()),
                           T.StructField("allowed", T.BooleanType()), T.StructField("first_run", T.BooleanType())])
    folded = materialize(inner.mapInArrow(_first_fold, schema), "quota")

    # Which partitions go on with the key of the one before: one row a partition, its first and last key.
    key = F.struct(*_KEY)
    ends = folded.groupBy("part").agg(F.min_by(key, "place").alias("first"), F.max_by(key, "place").alias("last"),
                                      F.max_by("first_run", "place").alias("single"),
                                      F.max_by(F.struct("rows_used", "allowed", *_BODY), "place").alias("end")).collect()
    ends.sort(key=lambda r: r["part"])
    goes_on = {b["part"] for a, b in zip(ends, ends[1:]) if a["last"] == b["first"]}
    if not goes_on:
        return folded.select("row.*", "rows_used", "allowed")
    again = folded.where("first_run").where(F.col("part").isin(sorted(goes_on)))
    maps = {r["part"]: list(zip(r["starts"], r["shifts"], strict=True)) for r in again.groupBy("part").applyInArrow(
        _summary, "part int, starts array<bigint>, shifts array<bigint>").collect()}
    used_before, carried = {}, 0
    for r in ends:  # what the first key of each partition has used, and its last key after it
        if r["part"] in goes_on:
            used_before[r["part"]] = carried
        if r["part"] in goes_on and r["single"]:
            carried = apply_pieces(maps[r["part"]], carried)
        else:
            end = r["end"]
            carried = end["rows_used"] + (end["rows_requested"] if end["allowed"] and end["succeeds"] else 0)

    names = schema.names

    def refold(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        before, allowed, _ = _folded(_rows_of(rows, *_BODY), used_before[key[0].as_py()])
        return rows.set_column(names.index("rows_used"), "rows_used", pa.array(before, pa.int64())) \
            .set_column(names.index("allowed"), "allowed", pa.array(allowed, pa.bool_()))

    stay = folded.where(~(F.col("first_run") & F.col("part").isin(sorted(goes_on))))
    return stay.unionByName(again.groupBy("part").applyInArrow(refold, schema)).select("row.*", "rows_used", "allowed")
