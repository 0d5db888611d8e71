"""Calendar-history analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns), stays lazy
and accepts ``keys``: the columns that separate one calendar from another.
``keys=()`` treats the whole input as one calendar.
"""
