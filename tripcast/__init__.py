"""tripcast: next-trip destination prediction as Spark DataFrame operators.

Every operator takes and returns DataFrames and is built from built-in
Catalyst expressions, joins, windows and aggregates, so one lazy plan runs
from the input files to the stored results.
"""

__all__ = ["session"]
