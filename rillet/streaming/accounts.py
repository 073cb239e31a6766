"""Running balances and daily quotas on streams: state by user that lives across triggers and restarts.

Rows of a trigger are taken in order of time, after those of all earlier triggers.  A stream that delivers rows in
order of time gives what the batch steps give over the whole table.

Users are dealt into buckets by a hash, and a bucket's users are held in one state: each has its own numbers there, but
the cost of a call of Python is met once a bucket, not once a user.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillet.common import col, require_columns
from rillet.operators.quota import verdict

#: Money is summed in whole millionths.
_SCALE = 1_000_000
#: Milliseconds of a day, and a day's end that no watermark passes.
_DAY, _NEVER = 86_400_000, (1 << 63) - 1
#: Buckets of users; as the state is kept by them, the number must stay for the life of a checkpoint.
BUCKETS = 512


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A bucket's rows of one trigger, by time and id (bounded by what a trigger takes in)."""
    return pd.concat(list(frames)).sort_values(["timestamp", "id"], kind="stable")


def _bucket(buckets: int) -> Column:
    """A user's bucket; the null user has its own."""
    return F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(buckets))).cast("int")


def _longs(df: DataFrame) -> dict[str, str]:
    """Names of the bigint columns, with those of their null marks: pandas would make doubles of them where one is null."""
    return {f.name: f"__null_{f.name}" for f in df.schema.fields if isinstance(f.dataType, T.LongType)}


def _sent(df: DataFrame) -> list[Column]:
    """The columns as Python gets them: nulls of bigint columns marked, and the user as text."""
    longs = _longs(df)
    return [*[F.coalesce(col(c), F.lit(0)).alias(c) if c in longs else col(c) for c in df.columns],
            *[col(c).isNull().alias(mark) for c, mark in longs.items()],
            F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("__user")]


def _sent_schema(df: DataFrame) -> list[T.StructField]:
    return [*df.schema.fields, *[T.StructField(mark, T.BooleanType()) for mark in _longs(df).values()]]


def _received(out: DataFrame, df: DataFrame, *added: str) -> DataFrame:
    """The columns of ``df`` and those ``added``, with the nulls of bigint columns again."""
    longs = _longs(df)
    return out.select(*[F.when(~col(longs[c]), col(c)).alias(c) if c in longs else col(c) for c in df.columns],
                      *[col(c) for c in added])


def running_balance_stream(ledger: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Each row of a ledger stream (``user_id, id, timestamp, amount``) with ``seq`` and ``balance_after`` of its user.

    The state is one number of rows and one sum a user.  Null amounts count as 0.
    """
    require_columns(ledger, ["user_id", "id", "timestamp", "amount"], "running_balance_stream")
    rows = ledger.select(
        *_sent(ledger), _bucket(buckets).alias("__bucket"),
        F.coalesce((F.col("amount") * _SCALE).cast("bigint"), F.lit(0)).alias("__micros"))
    fields = _sent_schema(ledger)
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("seq", T.LongType()), T.StructField("__after", T.LongType())])

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {user: (n, total) for user, n, total in zip(*state.get, strict=True)} if state.exists else {}
        rows = _in_order(frames)
        seq, after = [], []
        for user, micros in zip(rows["__user"].tolist(), rows["__micros"].tolist(), strict=True):
            n, total = held.get(user, (0, 0))
            held[user] = n, total = n + 1, total + micros
            seq.append(n)
            after.append(total)
        state.update((list(held), [n for n, _ in held.values()], [total for _, total in held.values()]))
        yield rows[names].assign(seq=seq, __after=after)

    out = rows.groupBy("__bucket").applyInPandasWithState(
        advance, schema, "users array<string>, seq array<long>, total array<long>", "append", GroupStateTimeout.NoTimeout)
    money = ledger.schema["amount"].dataType
    out = out.withColumn("balance_after", (F.col("__after").cast("decimal(38,6)") / _SCALE).cast(money))
    return _received(out, ledger, "seq", "balance_after")


def quota_stream(requests: DataFrame, users: DataFrame, limit: int, delay: str | None = None,
                 buckets: int = BUCKETS) -> DataFrame:
    """Each request of a stream with ``rows_used`` and ``allowed``, by the rule of :func:`rillet.operators.quota.quota_check`.

    The state is the rows used by user and day.  With ``delay`` a day's state goes when the watermark has passed its
    end by then, and requests later than that are dropped; without one the state of every day stays.
    """
    require_columns(requests, ["user_id", "day", "timestamp", "id", "rows_requested", "succeeds"], "quota_stream")
    free = users.select(F.col("id").alias("user_id"), F.coalesce("is_subscribed", F.lit(False)).alias("__free")) \
        .groupBy("user_id").agg(F.max("__free").alias("__free"))
    rows = requests.withWatermark("timestamp", delay) if delay else requests
    rows = rows.join(free, "user_id", "left").select(
        *_sent(requests), _bucket(buckets).alias("__bucket"),
        F.coalesce(F.col("rows_requested").cast("bigint"), F.lit(0)).alias("__rows"),
        F.coalesce("succeeds", F.lit(False)).alias("__ok"), F.coalesce("__free", F.lit(False)).alias("__free"),
        F.col("day").cast("string").alias("__day"),
        F.coalesce((F.unix_date(F.col("day").try_cast("date")).cast("bigint") + 1) * _DAY, F.lit(_NEVER)).alias("__over"))
    fields = _sent_schema(requests)
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("rows_used", T.LongType()), T.StructField("allowed", T.BooleanType())])

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(user, day, over): used for user, day, over, used in zip(*state.get, strict=True)} if state.exists else {}
        given, last = [], {}
        if not state.hasTimedOut:
            rows = _in_order(frames)
            before, allowed = [], []
            for user, day, over, n, ok, free in zip(*(rows[c].tolist() for c in (
                    "__user", "__day", "__over", "__rows", "__ok", "__free")), strict=True):
                at = (user, day, over)
                used = held.get(at, 0)
                before.append(used)
                good, last[at] = verdict(used, n, ok, None if free else limit)
                held[at] = last[at]
                allowed.append(good)
            given.append(rows[names].assign(rows_used=before, allowed=allowed))
        if delay:  # a day that had rows now stays until the watermark moves
            mark = state.getCurrentWatermarkMs()
            held = {at: used for at, used in held.items() if at in last or at[2] > mark}
        if held:
            users, days, overs = zip(*held, strict=True)
            state.update((list(users), list(days), list(overs), list(held.values())))
            if delay and min(overs) < _NEVER:
                state.setTimeoutTimestamp(max(min(overs), mark + 1))
        else:
            state.remove()
        yield from given

    timeout = GroupStateTimeout.EventTimeTimeout if delay else GroupStateTimeout.NoTimeout
    out = rows.groupBy("__bucket").applyInPandasWithState(
        decide, schema, "users array<string>, days array<string>, overs array<long>, used array<long>", "append", timeout)
    return _received(out, requests, "rows_used", "allowed")
