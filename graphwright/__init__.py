"""Spark-native knowledge-graph curation engine.

Everything is DataFrame in, DataFrame out.  ``functions`` holds pure Column
builders, ``operators`` the batch operators, ``plans`` the mutation-plan
compilers, ``sources`` the readers and append-only sinks, ``streaming`` the
Structured Streaming variants and ``queries`` the query catalogue.
"""

__version__ = "0.1.0"
