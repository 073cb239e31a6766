"""Incremental ingest of arriving files and streaming filters.

``file_arrival_stream`` replaces a polling sensor: the file source lists the
folder each trigger and picks up only new files; the checkpoint records
which files were processed, so a rerun adds nothing twice and a lost
executor's work is replayed from the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from rillet.operators.projection import filter_rows
from rillet.session import scratch_path


def file_arrival_stream(spark: SparkSession, path: str, schema: T.StructType | str,
                        fmt: str = "parquet", max_files_per_trigger: int | None = None,
                        **options) -> DataFrame:
    """A streaming DataFrame over the files arriving in ``path`` (schema required)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def stream_filter(df: DataFrame, condition: str | Column) -> DataFrame:
    """The filter step on a stream (same semantics as the batch filter)."""
    return filter_rows(df, condition)


def run_available(df: DataFrame, sink_path: str, checkpoint: str | None = None,
                  fmt: str = "parquet", output_mode: str = "append") -> str:
    """Process everything available now into ``sink_path`` and stop; returns the checkpoint path."""
    ckpt = checkpoint or scratch_path(df.sparkSession, "stream-checkpoint")
    q = (df.writeStream.format(fmt).outputMode(output_mode)
         .option("checkpointLocation", ckpt).option("path", sink_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return ckpt
