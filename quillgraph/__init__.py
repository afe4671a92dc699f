"""Spark-native document-graph analytics.

``sources`` reads and writes the graph's tables, ``functions`` holds column
expressions, ``operators`` the relational and iterative operators,
``streaming`` metering over streams, and ``plans`` the registered queries.
"""
