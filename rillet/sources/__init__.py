"""Sources and sinks: CSV, JSON, parquet; format round trip."""

from rillet.sources.files import (NA_VALUES, convert_format, load, read_csv, read_json,
                                  read_parquet, save)

__all__ = ["NA_VALUES", "convert_format", "load", "read_csv", "read_json", "read_parquet", "save"]
