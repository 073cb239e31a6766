"""rillet: table preparation steps as plain Spark DataFrame functions.

Every step takes a DataFrame (plus configuration) and returns a DataFrame
or, for routing steps, a mapping of named DataFrames.  Steps are lazy: a
chain of them forms one logical plan that Catalyst optimises as a whole.
"""

from rillet.common import StepError

__all__ = ["StepError"]
__version__ = "0.1.0"
