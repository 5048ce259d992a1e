"""Event enrichment and job review as Spark DataFrame jobs.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns). Nothing here keeps session state, so the same function serves a batch
job and, where it is row-local, a stream.
"""

__version__ = "0.1.0"
