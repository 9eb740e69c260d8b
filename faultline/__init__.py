"""faultline: reliability analytics over machine logs, written as Spark DataFrame jobs.

``sources`` and ``sinks`` read and write tables, ``functions`` are column
expressions, ``operators`` are single DataFrame steps and ``plans`` are whole jobs.
Every function takes and returns DataFrames (or Columns) and holds no state.
"""
