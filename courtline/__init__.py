"""courtline: schedule and interval analytics as distributed Spark DataFrame operators.

Layout:
  sources/    typed ingest, key checks, table sinks, views over the driver tables
  functions/  column expressions (exact rounding, clock text, colour buckets, ...)
  operators/  reusable relational operators (role explode, global rank, islands, pivot, ...)
  plans/      the user-visible queries, each a function returning a lazy DataFrame
  streaming/  incremental maintenance of team records over a stream of games
"""

__version__ = "0.1.0"
