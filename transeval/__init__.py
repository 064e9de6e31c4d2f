"""transeval: Spark-native scoring of machine translations of programs.

Layers: ``functions`` (column expressions), ``operators`` (DataFrame -> DataFrame jobs),
``sources`` (readers, writers and test-data bindings), ``plans`` (registered queries and
their SQL twins), ``streaming`` (incremental scoring of execution logs).
"""

__version__ = "0.1.0"
