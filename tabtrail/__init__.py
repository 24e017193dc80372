"""tabtrail: browsing-session analytics as Spark DataFrame operators.

Subpackages: ``functions`` (Column expressions), ``sources`` (tables, fixtures, sinks),
``operators`` (merges, statistics, categorisation, capture, retrieval), ``streaming``
(Structured Streaming variants) and ``plans`` (named queries with DuckDB oracles).
"""

__version__ = "0.1.0"
