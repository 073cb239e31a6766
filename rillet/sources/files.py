"""File sources and sinks.

CSV is read as text, the pandas NA spellings become null, and column types
are then inferred from the values in one aggregate pass (integer, then
floating point, then boolean, else text) — dates stay text as in the
reference.  JSON accepts one array-of-records document or JSON lines.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillet.common import StepError, col
from rillet.operators.sets import union_by_name
from rillet.session import scratch_path
from rillet.sources import splits

# The text spellings pandas' CSV reader treats as missing by default.
NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Text forms of timestamps written by the sinks: full microsecond precision, so a
# round trip through CSV or JSON keeps every timestamp exactly.
TIMESTAMP_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                     "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
# One set of CSV rules for writing and reading: quotes are doubled, padding and line feeds in a cell stay.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "lineSep": "\n",
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# For reading back what the sink wrote: an empty cell is null, a quoted empty one is the empty text.
_OWN_CSV = {**CSV_OPTIONS, "nullValue": "\x00", "emptyValue": ""}
# Number forms of the reference's reader (no type suffixes such as 12D).
_INTEGER = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i)inf(inity)?$"
# The spellings pandas reads as booleans.
TRUE_VALUES = ("True", "TRUE", "true")
FALSE_VALUES = ("False", "FALSE", "false")


def _normalise_na(df: DataFrame, na_values) -> DataFrame:
    na = list(na_values)
    return df.select(*[F.when(~col(c).isin(na), col(c)).alias(c) for c in df.columns])


def infer_types(df: DataFrame) -> T.StructType:
    """Narrowest of bigint / double / boolean / string holding every non-null value (one pass)."""
    checks = []
    for i, c in enumerate(df.columns):
        x = F.trim(col(c))
        present = col(c).isNotNull()
        checks += [F.count_if(present & ~(x.rlike(_INTEGER) & x.try_cast("bigint").isNotNull())).alias(f"l{i}"),
                   F.count_if(present & ~(x.rlike(_NUMBER) & x.try_cast("double").isNotNull())).alias(f"d{i}"),
                   F.count_if(present & ~col(c).isin(*TRUE_VALUES, *FALSE_VALUES)).alias(f"b{i}"),
                   F.count_if(present).alias(f"n{i}")]
    row = df.agg(*checks).first()
    fields = []
    for i, c in enumerate(df.columns):
        if row[f"n{i}"] == 0:
            t: T.DataType = T.StringType()
        elif row[f"l{i}"] == 0:
            t = T.LongType()
        elif row[f"d{i}"] == 0:
            t = T.DoubleType()
        elif row[f"b{i}"] == 0:
            t = T.BooleanType()
        else:
            t = T.StringType()
        fields.append(T.StructField(c, t, True))
    return T.StructType(fields)


def _apply_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    cols = []
    for f in schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            cols.append(F.when(c.isin(*TRUE_VALUES), True).when(c.isin(*FALSE_VALUES), False).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(c)
        else:
            cols.append(F.trim(c).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def larger_than_a_split(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a file is larger than what Spark gives one task (looks at the files' lengths only)."""
    sizes = spark.read.format("binaryFile").load(path).select("length")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    limit = int(most[:-1]) * units[most[-1]] if most[-1] in units else int(most)
    return not sizes.where(F.col("length") > limit).isEmpty()


def _ddl(schema: T.StructType) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in schema.fields)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             na_values=NA_VALUES, multiline: bool = True, split: bool | None = None) -> DataFrame:
    """CSV with a header row; NA spellings become null; types from ``schema`` or inferred.

    Cells may hold line feeds.  Files are split all the same (see :mod:`splits`: a pass over the quotes comes first)
    if one is larger than a split; ``split`` says so without a look at the sizes.  The rows are the same either way.
    ``multiline=False`` leaves that pass out for files whose cells are known to hold none.
    """
    raw = spark.read.options(**{**CSV_OPTIONS, "multiLine": multiline, "inferSchema": False}).csv(path)
    if multiline and (larger_than_a_split(spark, path) if split is None else split):
        # The reader gives the names; the records are parsed one by one.
        names = T.StructType([T.StructField(c, T.StringType()) for c in raw.columns])
        kept = {k: v for k, v in CSV_OPTIONS.items() if k != "header"}
        rows = splits.csv_records(spark, path).where("NOT first")
        raw = rows.select(F.from_csv("value", _ddl(names), {
            k: str(v).lower() if isinstance(v, bool) else v for k, v in kept.items()}).alias("row")).select("row.*")
    raw = _normalise_na(raw, na_values)
    if schema is None:
        schema = infer_types(raw)
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    return _apply_types(raw, schema)


def _read_json_columns(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One column-oriented object per file: ``{"col": {"<row>": value, ...}, ...}``.

    Each file is parsed once as a variant and exploded into
    ``(column, row, value)`` cells; each column's type comes from the merged
    schema of its values, and the cells are pivoted back to rows (ordered by
    row label).  A whole document is one task: the format is not splittable.
    """
    docs = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.parse_json("value").alias("v"))
    cols = docs.select("file", F.explode(F.col("v").cast("map<string, variant>")).alias("col", "cells"))
    cells = cols.select("file", "col", F.explode(F.col("cells").cast("map<string, variant>")).alias("row", "value"))
    types = {r["col"]: r["t"] for r in cells.groupBy("col").agg(
        F.expr("schema_of_variant_agg(value)").alias("t")).collect()}
    names = sorted(types)
    wide = cells.groupBy("file", "row").pivot("col", names).agg(F.first("value"))
    typed = []
    for c in names:
        ddl = types[c] or "STRING"
        ddl = ddl.replace("OBJECT<", "STRUCT<")
        if ddl.startswith("DECIMAL"):
            ddl = "DOUBLE"
        typed.append(F.col(f"`{c}`").cast(ddl).alias(c) if ddl != "VARIANT" else F.col(f"`{c}`"))
    order = F.coalesce(F.col("row").try_cast("bigint"), F.lit(None).cast("bigint"))
    return wide.orderBy("file", order, "row").select(*typed)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              lines: bool | None = None, orient: str = "records", split: bool | None = None) -> DataFrame:
    """JSON lines, or one document a file holding an array of records (``lines=False``); many tasks read a document
    that is larger than a split (``split`` says so without a look at the sizes; the rows are the same either way).

    With ``lines=None`` each file is looked at: one that begins with ``[`` is an array document, one whose
    first line is a whole JSON value holds JSON lines, and any other is a column-oriented object
    (``{"col": {"0": v, "1": w}}``); a folder may mix them.  A column-oriented object on one line is taken for one
    only if all files of the folder are column-oriented and its row labels are 0, 1, …; else it is a record.  That
    look reads all files once; name ``lines`` for large inputs.  ``orient="columns"`` reads every file as a column-oriented object.  Malformed JSON
    fails the read.
    """
    if orient == "columns":
        return _read_json_columns(spark, path)
    if orient != "records":
        raise StepError(f"read_json: unknown orient {orient!r}")
    def records(paths, multi: bool) -> DataFrame:
        reader = spark.read.option("multiLine", multi).option("mode", "FAILFAST").options(**TIMESTAMP_OPTIONS)
        if schema is not None:
            reader = reader.schema(schema)
        elements = None
        if multi and (larger_than_a_split(spark, paths) if split is None else split):
            elements = splits.array_elements(spark, paths)
        return reader.json(paths) if elements is None else _json_texts(reader, elements)

    if lines is not None:
        return records(path, not lines)
    kinds = _json_kinds(spark, path)
    parts = [records(kinds[k], k == "array") for k in ("lines", "array") if k in kinds]
    if "columns" in kinds:
        parts.append(_read_json_columns(spark, kinds["columns"]))
    if not parts:
        return records(path, False)
    return parts[0] if len(parts) == 1 else union_by_name(*parts)


def _json_texts(reader, texts: DataFrame) -> DataFrame:
    """The table of a column of JSON records (the reader's own form of this, which Python offers for RDDs only)."""
    encoder = texts.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING()
    return DataFrame(reader._jreader.json(getattr(texts._jdf, "as")(encoder)), texts.sparkSession)


def _json_kinds(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by what they hold: ``array``, ``lines`` or ``columns`` (one name a file goes to the driver)."""
    text = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    first = text.where(F.trim("value") != "").groupBy("file").agg(F.min_by(F.trim("value"), "at").alias("line"))
    kind = F.when(F.col("line").startswith("["), "array").when(
        F.try_parse_json("line").isNotNull(), "lines").otherwise("columns")
    # A whole object in a file of one line may be column-oriented: all its values are objects with labels 0, 1, ...
    lone = text.where(F.trim("value") != "").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    cells = F.try_variant_get(F.try_parse_json("line"), "$", "map<string, map<string, variant>>")

    def labelled(rows):
        return (F.size(rows) > 0) & F.forall(F.map_keys(rows), lambda k: (
            k.try_cast("bigint").cast("string") == k) & k.try_cast("bigint").between(0, F.size(rows) - 1))

    table = (F.col("n") == 1) & (kind == "lines") & (F.size(cells) > 0) & F.forall(F.map_values(cells), labelled)
    found = first.join(lone, "file").select(
        "file", kind.alias("kind"), F.coalesce(table, F.lit(False)).alias("table")).orderBy("file").collect()
    # Records of a nested column look the same in one file, so all files of the folder must be of that form.
    tables = all(row["table"] or row["kind"] == "columns" for row in found)
    out: dict[str, list[str]] = {}
    for row in found:
        out.setdefault("columns" if tables else row["kind"], []).append(row["file"])
    return out


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _format_of(path: str, fmt: str | None) -> str:
    if fmt:
        return fmt
    ext = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if ext in ("csv", "json", "parquet"):
        return ext
    raise StepError(f"unsupported file type: {path!r}")


def load(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read by extension (or ``fmt``): csv, json, parquet."""
    kind = _format_of(path, fmt)
    return {"csv": read_csv, "json": read_json, "parquet": read_parquet}[kind](spark, path, **options)


def sink_options(kind: str) -> dict:
    """Writer options of a format: exact timestamps, and CSV cells as :func:`read_csv` reads them."""
    if kind == "csv":
        return {**TIMESTAMP_OPTIONS, **{k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}}
    return dict(TIMESTAMP_OPTIONS) if kind == "json" else {}


def save(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists",
         max_records_per_file: int | None = None, **options) -> None:
    """Write csv (header, no index), JSON lines or parquet; ``options`` are the writer's."""
    kind = _format_of(path, fmt)
    writer = df.write.mode(mode).format(kind)
    writer = writer.options(**{**sink_options(kind), **options})
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", int(max_records_per_file))
    writer.save(path)


def convert_format(df: DataFrame, fmt: str, path: str | None = None) -> DataFrame:
    """Write the table as ``fmt`` and continue from the re-read files (same schema).

    The files go to ``path`` or a fresh folder under the shared checkpoint
    folder; reading them back also cuts the lineage.
    """
    if fmt not in ("csv", "json", "parquet"):
        raise StepError(f"convert_format: unsupported format {fmt!r}")
    target = path or scratch_path(df.sparkSession, f"convert-{fmt}")
    alone = fmt == "csv" and len(df.columns) == 1  # a null row would be a blank line, which readers skip
    save(df, target, fmt, **({"nullValue": "\x00"} if alone else {}))
    reader = df.sparkSession.read.schema(df.schema).options(**TIMESTAMP_OPTIONS)
    if fmt == "csv":
        return reader.options(**_OWN_CSV).csv(target)
    return reader.format(fmt).load(target)
