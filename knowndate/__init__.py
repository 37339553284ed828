"""Point-in-time risk analytics as PySpark DataFrame operators.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing is executed while a plan is built, except where a docstring
says "eager": those steps bring back a bounded number of scalars.
"""

__version__ = "0.1.0"
