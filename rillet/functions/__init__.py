"""User-function surfaces: table functions, pandas batch / group / scalar functions."""

from rillet.functions.udf import (apply_groups, apply_groups_salted, apply_table_function, map_batches,
                                  scalar_function)

__all__ = ["apply_groups", "apply_groups_salted", "apply_table_function", "map_batches", "scalar_function"]
