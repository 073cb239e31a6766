"""Joins: equi-joins with null-safe keys, lookup enrichment, bounded cross join,
n-way merge and keyed lookup.

Null keys match null keys in every join type (the reference semantics).  A
``<=>`` condition still plans as a hash or sort-merge join: Spark rewrites it
to an equi-join on ``(coalesce(k, default), isnull(k))``.  The physical
strategy is left to Catalyst and AQE: a side whose runtime size falls under
the broadcast threshold is broadcast, anything larger is shuffled on the
keys, and AQE splits skewed shuffle partitions.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rillet.common import StepError
from rillet.common import col as column
from rillet.common import col_list, estimated_bytes, key_family, require_columns, unique_name

_HOW = {
    "inner": "inner", "left": "left", "right": "right", "outer": "full_outer",
    "full": "full_outer", "full_outer": "full_outer",
}


def _suffix_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str],
                    suffixes: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rename non-key columns present on both sides with the suffixes."""
    overlap = [c for c in left.columns if c in right.columns and c not in keys]
    if overlap:
        left = left.withColumnsRenamed({c: c + suffixes[0] for c in overlap})
        right = right.withColumnsRenamed({c: c + suffixes[1] for c in overlap})
    names = left.columns + [c for c in right.columns if c not in keys]
    dup = sorted({c for c in names if names.count(c) > 1})
    if dup:
        raise StepError(f"join: column names clash after suffixing: {', '.join(dup)}")
    return left, right


def _check_key_types(left: DataFrame, right: DataFrame, keys: Sequence[str], step: str) -> None:
    lt = {f.name: f.dataType for f in left.schema.fields}
    rt = {f.name: f.dataType for f in right.schema.fields}
    for k in keys:
        if key_family(lt[k]) != key_family(rt[k]):
            raise StepError(f"{step}: key {k!r} has type {lt[k].simpleString()} on the left "
                            f"and {rt[k].simpleString()} on the right")


def _broadcastable(df: DataFrame) -> bool:
    threshold = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    text = str(threshold).strip().lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    limit = int(float(text[:-1]) * units[text[-1]]) if text and text[-1] in units else int(text)
    return limit > 0 and estimated_bytes(df) <= limit


def _has_null_key(df: DataFrame, keys: Sequence[str]) -> bool:
    """Does any row have a null key?  The ``IS NULL`` filter reaches the scan,
    where parquet row-group null counts skip every group without nulls."""
    cond = None
    for k in keys:
        c = column(k).isNull()
        cond = c if cond is None else cond | c
    return not df.where(cond).select(*[column(k) for k in keys]).isEmpty()


def join(left: DataFrame, right: DataFrame, on: str | Iterable[str], how: str = "inner",
         suffixes: tuple[str, str] = ("_x", "_y"), null_safe: bool = True, probe: bool = False) -> DataFrame:
    """Equi-join on same-named keys (inner, left, right, outer).

    Keys appear once: from the left for inner/left, from the right for right,
    merged with ``coalesce`` for outer.  Other columns present on both sides
    get ``suffixes``.  Null keys match each other unless ``null_safe=False``.

    The step is lazy.  ``probe=True`` looks at the smaller side's keys first, if it is too large to broadcast: without
    a null key there, ``=`` gives exactly the result of ``<=>`` for every join type, and the plain equi-join is used.
    Catalyst then filters the other side's null keys at the scan (inner joins) instead of hashing them all into one
    shuffle partition, which AQE has to split.  Worth its job where very many keys of a large table are null.
    """
    keys = col_list(on, "join_key")
    if how not in _HOW:
        raise StepError(f"join: unknown join_type {how!r}")
    require_columns(left, keys, "join (left)")
    require_columns(right, keys, "join (right)")
    _check_key_types(left, right, keys, "join")
    left, right = _suffix_overlap(left, right, keys, suffixes)

    if null_safe and probe:
        sides = [d for d in (right, left) if not d.isStreaming]  # a stream cannot be probed up front
        if sides:
            smaller = min(sides, key=estimated_bytes)
            if not _broadcastable(smaller):  # only shuffle joins gain: null keys would share one partition
                null_safe = _has_null_key(smaller, keys)
    rnames = {k: unique_name(left, f"__r_{k}") for k in keys}
    right = right.withColumnsRenamed(rnames)
    cond = None
    for k in keys:
        l, r = column(k), column(rnames[k])
        c = l.eqNullSafe(r) if null_safe else l == r
        cond = c if cond is None else cond & c
    kind = _HOW[how]
    batch = not (left.isStreaming or right.isStreaming)
    if batch and kind in ("right", "full_outer") and not (_broadcastable(left) or _broadcastable(right)):
        joined = _decomposed(left, right, keys, rnames, cond, kind)
    else:
        joined = left.join(right, cond, kind)

    def key_col(k: str):
        if kind == "right":
            return column(rnames[k]).alias(k)
        if kind == "full_outer":
            return F.coalesce(column(k), column(rnames[k])).alias(k)
        return column(k)

    out = [key_col(c) if c in keys else column(c) for c in left.columns]
    out += [column(c) for c in right.columns if c not in rnames.values()]
    return joined.select(*out)


def _decomposed(left: DataFrame, right: DataFrame, keys: Sequence[str], rnames: Mapping[str, str], cond,
                kind: str) -> DataFrame:
    """A right or full outer join as an inner or left join and the right rows without a match.

    Spark cannot split a hot left key in a right join, nor any hot key in a full outer one.  An inner and a
    left join can be split on the left, and the unmatched right rows only need the left side's distinct
    keys, which are combined before they move.
    """
    matched = left.join(right, cond, "inner" if kind == "right" else "left")
    seen = left.select(*[column(k).alias(f"__seen_{i}") for i, k in enumerate(keys)]).distinct()
    absent = None
    for i, k in enumerate(keys):
        c = seen[f"__seen_{i}"].eqNullSafe(right[rnames[k]])
        absent = c if absent is None else absent & c
    lone = right.join(seen, absent, "left_anti")
    types = {f.name: f.dataType for f in left.schema.fields}
    lone = lone.select(*[F.lit(None).cast(types[c]).alias(c) for c in left.columns],
                       *[column(c) for c in right.columns])
    return matched.unionByName(lone)


def enrich_data(df: DataFrame, lookup: DataFrame, on: str | Iterable[str],
                columns: str | Iterable[str]) -> DataFrame:
    """Left join bringing only the listed lookup columns."""
    keys = col_list(on, "join_key")
    cols = col_list(columns)
    require_columns(df, keys, "enrich_data")
    require_columns(lookup, keys + cols, "enrich_data (lookup)")
    return join(df, lookup.select(*keys, *[c for c in cols if c not in keys]), keys, "left")


def cross_join(left: DataFrame, right: DataFrame, max_right_rows: int | None = None,
               max_right_bytes: int | None = None, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Cartesian product of two tables.

    Spark broadcasts a side under its size threshold and pairs partitions otherwise; no side is refused.  A
    caller who wants a guard names ``max_right_rows`` or ``max_right_bytes`` (of the rows as JSON text):
    the right side is then measured first, refused above the bound and broadcast below it.
    """
    guarded = max_right_rows is not None or max_right_bytes is not None
    if guarded:
        n, size = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(
            F.to_json(F.struct(*[column(c) for c in right.columns])))), F.lit(0))).first()
        if n > (max_right_rows if max_right_rows is not None else n) \
                or size > (max_right_bytes if max_right_bytes is not None else size):
            raise StepError(f"cross_join: right side has {n} rows / {size} bytes; the bound is "
                            f"{max_right_rows} rows and {max_right_bytes} bytes")
    left, right = _suffix_overlap(left, right, [], suffixes)
    return left.crossJoin(F.broadcast(right) if guarded else right)


def merge_records(tables: Sequence[DataFrame], merge_type: str = "concat",
                  on: str | Iterable[str] | None = None) -> DataFrame:
    """Combine several tables: ``concat`` unions by name, ``merge`` outer-joins on keys."""
    from rillet.operators.sets import union_by_name

    if not tables:
        raise StepError("merge_records: no input tables")
    if merge_type == "concat":
        return union_by_name(*tables)
    if merge_type == "merge":
        if not on:
            raise StepError("merge_records: merge needs join_key")
        keys = col_list(on, "join_key")
        for t in tables:
            require_columns(t, keys, "merge_records")
        return reduce(lambda a, b: join(a, b, keys, "outer", probe=False), tables)
    raise StepError(f"merge_records: unknown merge_type {merge_type!r}")


def keyed_lookup(df: DataFrame, key_column: str, output_columns: str | Iterable[str],
                 provider: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add response columns looked up once per distinct key.

    Without ``provider`` the response for column ``c`` is the text
    ``c_<key>`` (the reference's stand-in service); it is a pure function of
    the key, so it is evaluated in the projection with no shuffle.  With a
    ``provider`` (``DataFrame[key] -> DataFrame[key, outputs...]``) the
    distinct non-null keys are handed over once and the answers joined back;
    a null key gets null.
    """
    outs = col_list(output_columns, "output_columns")
    require_columns(df, [key_column], "keyed_lookup")
    key = column(key_column)
    if provider is None:
        return df.withColumns({
            c: F.when(key.isNotNull(), F.concat(F.lit(f"{c}_"), key.cast("string"))) for c in outs})
    keys = df.select(key).where(key.isNotNull()).distinct()
    answers = provider(keys)
    require_columns(answers, [key_column, *outs], "keyed_lookup (provider)")
    return join(df.drop(*[c for c in outs if c in df.columns]),
                answers.select(key, *[column(c) for c in outs]), [key_column], "left", null_safe=False)


def batched_provider(fetch: Callable[[list], Mapping], outputs: Mapping[str, str], batch_size: int = 500,
                     attempts: int = 3, pause: float = 0.5) -> Callable[[DataFrame], DataFrame]:
    """A provider for :func:`keyed_lookup` that asks a service for at most ``batch_size`` keys at a time.

    ``fetch(keys)`` runs in the tasks and returns ``{key: {column: value}}``; keys and columns it leaves out are null.
    ``outputs`` names the columns and their types.  A call that raises is tried ``attempts`` times, with a pause that
    doubles from ``pause`` seconds, and then fails the task, which Spark tries again; so ``fetch`` must be safe to repeat.
    """
    if batch_size < 1 or attempts < 1:
        raise StepError("batched_provider: batch_size and attempts must be positive")

    def ask(keys: list) -> Mapping:
        for attempt in range(attempts):
            try:
                return fetch(keys)
            except Exception:  # noqa: BLE001 - whatever the service raises
                if attempt == attempts - 1:
                    raise
                time.sleep(pause * 2 ** attempt)
        raise AssertionError("unreachable")

    def provider(keys: DataFrame) -> DataFrame:
        name = keys.columns[0]
        types = [T._parse_datatype_string(t) for t in outputs.values()]
        places = [f"a{i}" for i in range(len(outputs))]  # plain names on the way: columns may be called anything
        schema = T.StructType([T.StructField("k", keys.schema.fields[0].dataType), *map(T.StructField, places, types)])

        def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, batch_size):
                    part = batch.slice(at, batch_size)
                    asked = part.column(0).to_pylist()
                    found = ask(asked)
                    rows = [found.get(k) or {} for k in asked]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), *[pa.array([r.get(c) for r in rows], to_arrow_type(t)) for c, t in zip(outputs, types, strict=True)]],
                        ["k", *places])

        return keys.toDF("k").mapInArrow(answers, schema).toDF(name, *outputs)

    return provider
