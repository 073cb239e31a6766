"""Helpers shared by the steps: column lists, checks, ordering, renames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class StepError(ValueError):
    """A step was configured wrongly or its input lacks what it needs."""


def col_list(columns: str | Iterable[str] | None, what: str = "columns",
             allow_empty: bool = False) -> list[str]:
    """Parse a comma list (or a sequence) of names, stripping blanks.

    Blank items are refused; so is an empty list unless ``allow_empty``.
    """
    if columns is None:
        items: list[str] = []
    elif isinstance(columns, str):
        items = [c.strip() for c in columns.split(",")] if columns.strip() else []
    else:
        items = [str(c).strip() for c in columns]
    if any(not c for c in items):
        raise StepError(f"{what}: blank name in {columns!r}")
    if not items and not allow_empty:
        raise StepError(f"{what}: at least one name is required")
    return items


def require_columns(df: DataFrame, columns: Iterable[str], step: str) -> None:
    """Raise naming every listed column that ``df`` does not have."""
    have = set(df.columns)
    missing = [c for c in columns if c not in have]
    if missing:
        raise StepError(f"{step}: columns not found: {', '.join(missing)}")


def _orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return False
    if isinstance(dtype, T.ArrayType):
        return _orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_orderable(f.dataType) for f in dtype.fields)
    return True


def col(name: str) -> Column:
    """The column of exactly that name (dots and backquotes in it are part of the name)."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """Whether a value is there: not null, and not NaN (the one rule of all steps)."""
    c = col(name)
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return c.isNotNull() & ~F.isnan(c) if floating else c.isNotNull()


def total_order(df: DataFrame, order_by: str | Sequence[str | Column] | None,
                exclude: Iterable[str] = ()) -> list[Column]:
    """Sort expressions: the given order, then every other column as a tie-break.

    Spark rows have no input order, so steps whose reference result depends
    on row order take an explicit ``order_by``; breaking ties by all
    remaining (orderable) columns makes the outcome deterministic.
    """
    given: list[Column] = []
    used: set[str] = set(exclude)
    if isinstance(order_by, str):
        order_by = col_list(order_by, "order_by")
    for item in order_by or []:
        if isinstance(item, Column):
            given.append(item)
        else:
            given.append(col(item).asc_nulls_first())
            used.add(item)
    rest = [col(f.name).asc_nulls_first() for f in df.schema.fields
            if f.name not in used and _orderable(f.dataType)]
    return given + rest


def key_family(dtype: T.DataType) -> str:
    """Coarse type family, used to refuse joins of e.g. text keys to numbers."""
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return dtype.simpleString()


def unique_name(df: DataFrame, base: str) -> str:
    """A column name not yet used in ``df``."""
    name, i = base, 0
    while name in df.columns:
        i += 1
        name = f"{base}_{i}"
    return name


def estimated_bytes(df: DataFrame, unknown: int = 1 << 62) -> int:
    """The optimizer's size estimate of ``df`` (file sizes for scans); no job runs."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(size if isinstance(size, int) else size.toString())  # py4j may convert BigInt
    except Exception:  # noqa: BLE001 - estimate unavailable (e.g. remote session)
        return unknown


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of the files (and other leaves) that ``df`` is made from, where known; no job runs.

    Estimates of joins multiply their inputs, so the leaves are added up instead.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(leaves.apply(i).stats().sizeInBytes().toString()) for i in range(leaves.size())]
    except Exception:  # noqa: BLE001 - estimate unavailable (e.g. remote session)
        return 0
    unknown = int(df.sparkSession.conf.get("spark.sql.defaultSizeInBytes", str((1 << 63) - 1)))
    return sum(s for s in sizes if s < unknown)


def target_partitions(df: DataFrame, minimum: int | None = None) -> int:
    """Partition count for a shuffle of ``df``: ``spark.sql.shuffle.partitions``, or more when the files it is
    made from hold more than the advisory partition size for each."""
    spark = df.sparkSession
    conf = int(minimum or spark.conf.get("spark.sql.shuffle.partitions"))
    advisory = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    text = advisory.strip().lower().rstrip("b")
    target = int(float(text[:-1]) * units[text[-1]]) if text and text[-1] in units else int(text)
    return max(conf, -(-scanned_bytes(df) // max(target, 1)))
