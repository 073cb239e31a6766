"""Table steps.  Each is a function ``DataFrame -> DataFrame`` (or a dict of them)."""

from rillet.operators.aggregates import aggregate, aggregate_multiple, pivot
from rillet.operators.columns import (data_masking, json_flatten, normalize_data,
                                      replace_text, replace_values)
from rillet.operators.fuzzy import fuzzy_match
from rillet.operators.joins import batched_provider, cross_join, enrich_data, join, keyed_lookup, merge_records
from rillet.operators.projection import (deduplicate, derive_columns, drop_columns, filter_rows,
                                         remove_nulls, select_columns)
from rillet.operators.quality import data_quality_check, quality_report
from rillet.operators.routing import (branching, conditional_split, dynamic_split,
                                      route_on_attribute, split_records)
from rillet.operators.sets import union_by_name
from rillet.operators.sqlstep import execute_sql
from rillet.operators.temporal import Frame, asof_join, interval_join, last_before, moving_frames
from rillet.operators.windows import ordered_rank, row_numbers, window_function

__all__ = [
    "aggregate", "aggregate_multiple", "pivot", "data_masking", "json_flatten",
    "normalize_data", "replace_text", "replace_values", "fuzzy_match", "batched_provider", "cross_join",
    "enrich_data", "join", "keyed_lookup", "merge_records", "deduplicate", "derive_columns",
    "drop_columns", "filter_rows", "remove_nulls", "select_columns", "data_quality_check",
    "quality_report", "branching", "conditional_split", "dynamic_split", "route_on_attribute",
    "Frame", "asof_join", "interval_join", "last_before", "moving_frames",
    "split_records", "union_by_name", "execute_sql", "ordered_rank", "row_numbers", "window_function",
]
