"""Column steps: value and regex replacement, normalisation, masking, JSON flattening.

All are projections built from Spark SQL functions, evaluated inside
whole-stage code generation; none runs Python per row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillet.common import StepError, col, col_list, require_columns


def replace_values(df: DataFrame, column: str, old_value, new_value) -> DataFrame:
    """Replace whole cells equal to ``old_value`` by ``new_value`` in one column.

    Both values are cast to the column's type, so ``"2"`` matches the number 2
    in a numeric column; a value that does not cast matches nothing.  A null
    ``old_value`` replaces nulls.
    """
    require_columns(df, [column], "replace_values")
    dtype = df.schema[column].dataType
    c = F.col(column)
    old = F.lit(old_value).try_cast(dtype) if old_value is not None else F.lit(None).cast(dtype)
    new = F.lit(new_value).cast(dtype) if new_value is not None else F.lit(None).cast(dtype)
    if old_value is not None:
        hit = c == old
    else:
        hit = c.isNull()
    return df.withColumn(column, F.when(F.coalesce(hit, F.lit(False)), new).otherwise(c))


def python_replacement(repl: str) -> str:
    """Translate a Python ``re.sub`` replacement (``\\1``, ``\\g<name>``) to Java (``$1``)."""
    out, i = [], 0
    while i < len(repl):
        ch = repl[i]
        if ch == "$":
            out.append("\\$")
        elif ch == "\\" and i + 1 < len(repl):
            nxt = repl[i + 1]
            m = re.match(r"g<(\w+)>", repl[i + 1:])
            if nxt.isdigit():
                j = i + 1
                while j < len(repl) and repl[j].isdigit() and j - i <= 2:
                    j += 1
                out.append("$" + repl[i + 1:j])
                i = j
                continue
            if m:
                name = m.group(1)
                out.append("$" + name if name.isdigit() else "${" + name + "}")
                i += 1 + m.end()
                continue
            escapes = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\\\"}
            out.append(escapes.get(nxt, "\\" + nxt))
            i += 2
            continue
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def replace_text(df: DataFrame, column: str, pattern: str, replacement: str,
                 python_groups: bool = True) -> DataFrame:
    """Regex replace-all on the text form of a column (a null stays null).

    ``replacement`` uses Python's group syntax (``\\1``) by default; pass
    ``python_groups=False`` for Java's (``$1``).
    """
    require_columns(df, [column], "replace_text")
    repl = python_replacement(replacement) if python_groups else replacement
    return df.withColumn(column, F.regexp_replace(F.col(column).cast("string"), F.lit(pattern), F.lit(repl)))


def normalize_data(df: DataFrame, columns: str | Iterable[str], method: str) -> DataFrame:
    """Scale columns over the whole table: ``min_max`` to [0, 1], or ``z_score``.

    The statistics for all columns come from one global aggregate (partial
    per task, one row per task to the final step) used as a scalar subquery,
    so the per-row division stays a projection.  A constant column gives
    null (0/0); z-score uses the sample standard deviation.
    """
    cols = col_list(columns)
    require_columns(df, cols, "normalize_data")
    if method not in ("min_max", "z_score"):
        raise StepError(f"normalize_data: unknown method {method!r}")
    stats = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        if method == "min_max":
            stats += [F.min(x).alias(f"a{i}"), (F.max(x) - F.min(x)).alias(f"b{i}")]
        else:
            stats += [F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"b{i}")]
    row = df.agg(F.struct(*stats).alias("s")).scalar()
    return df.withColumns({
        c: F.try_divide(F.col(c).cast("double") - row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(cols)})


def mask_expr(c: Column, method: str) -> Column:
    text = c.cast("string")
    if method == "hash":
        return F.substring(F.sha2(text, 256), 1, 10)
    if method == "mask":
        return F.repeat(F.lit("*"), F.length(text))
    raise StepError(f"data_masking: unknown method {method!r}")


def data_masking(df: DataFrame, columns: str | Iterable[str], method: str) -> DataFrame:
    """``hash``: first 10 hex digits of SHA-256 of the text; ``mask``: one ``*`` per character."""
    cols = col_list(columns)
    require_columns(df, cols, "data_masking")
    return df.withColumns({c: mask_expr(F.col(c), method) for c in cols})


def _variant_schema_to_ddl(text: str) -> str:
    ddl = text.replace("OBJECT<", "STRUCT<")
    ddl = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", ddl)
    return re.sub(r"\bVOID\b", "STRING", ddl)


def infer_json_schema(df: DataFrame, column: str, strict: bool = True) -> T.DataType:
    """Merged schema of every JSON document in ``column`` (one aggregate pass); malformed ones fail, or are left
    out when not ``strict``."""
    parse = F.parse_json if strict else F.try_parse_json
    text = df.select(F.schema_of_variant_agg(parse(col(column)))).first()[0]
    if text is None:
        return T.StructType([])
    return T._parse_datatype_string(_variant_schema_to_ddl(text))


def _leaves(dtype: T.StructType, path: list[str]):
    for f in dtype.fields:
        p = path + [f.name]
        if isinstance(f.dataType, T.StructType) and f.dataType.fields:
            yield from _leaves(f.dataType, p)
        else:
            yield p


def json_flatten(df: DataFrame, column: str, prefix: str | None = None,
                 schema: T.StructType | str | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Parse a JSON text column into columns ``<prefix>_<dotted.path>``.

    Nested objects are flattened, arrays stay whole, absent paths are null
    and the JSON column is dropped.  Without ``schema`` the merged schema of
    all documents is inferred in one aggregate pass; a streaming input needs
    ``schema``.  Malformed JSON fails the step (``mode="PERMISSIVE"`` gives
    nulls instead).
    """
    require_columns(df, [column], "json_flatten")
    pre = column if prefix is None else prefix
    if schema is None:
        if df.isStreaming:
            raise StepError("json_flatten: a stream needs an explicit schema")
        schema = infer_json_schema(df, column, strict=mode.upper() != "PERMISSIVE")
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if not isinstance(schema, T.StructType):
        raise StepError("json_flatten: the JSON documents are not objects")
    parsed = "__json_parsed"
    out = df.withColumn(parsed, F.from_json(col(column), schema, {"mode": mode}))
    leaves = list(_leaves(schema, []))
    cols = [col(c) for c in df.columns if c != column]
    for p in leaves:
        ref = F.col(parsed)
        dtype: T.DataType = schema
        for name in p:
            ref = ref.getField(name)
            dtype = dtype[name].dataType
        if isinstance(dtype, T.VariantType):  # mixed types: a JSON null is a SQL null
            ref = F.when(~F.is_variant_null(ref), ref)
        cols.append(ref.alias(f"{pre}_{'.'.join(p)}"))
    return out.select(*cols)
