"""Era-panel analytics on Spark.

A panel has one row per (id, era). The sub-packages are:

* ``functions``  - Column expressions and ranking transforms
* ``operators``  - DataFrame -> DataFrame operators (projection, joins, checks, scores, counts, models)
* ``sources``    - Parquet / JSON sources and sinks
* ``plans``      - multi-step jobs (prepare a panel, rank features, train and evaluate)
* ``streaming``  - the same counts and scores kept up to date with Structured Streaming
* ``workloads``  - the registered queries over the test tables and their SQL checks
"""

__version__ = "0.1.0"
