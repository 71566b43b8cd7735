"""Point-in-time analytics on Spark DataFrames.

Every public function takes and returns DataFrames (or Columns) and stays lazy,
except where an operator's docstring says that it writes a checkpoint.
"""

__version__ = "0.1.0"
