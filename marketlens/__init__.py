"""marketlens: Spark-native trade-stream analytics.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
native Spark SQL expressions, so Catalyst sees (and optimises) the whole
plan.  Sub-packages:

* ``sources``   – batch tables and stream readers (S1-S3, S10)
* ``functions`` – column-level parsers, normalisers and classifiers (P*, C*, R9)
* ``operators`` – statistics, indicators, arbitrage, rules, alerts, serving
* ``plans``     – the registered queries and their DuckDB oracles
* ``streaming`` – sinks, stream jobs and keyed-state processors (S4-S9, T*)
"""

from marketlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
