"""tessera: a PySpark-native engine for building and monitoring classifier ensembles.

Layout:
  sources/    readers for the input tables, derived views, sinks (logs, predictions, bundles)
  functions/  column-expression helpers (hash-uniforms, scalar math, text formatting)
  operators/  fitted feature operators, sampling, metrics, models, ensemble algebra,
              log analytics; every fit is one distributed aggregation
  plans/      registered queries (Spark DataFrame + DuckDB oracle SQL) over the test tables
  streaming/  Structured Streaming twins of the log operators
"""

__version__ = "0.1.0"
