"""quirelake: document and visit analytics expressed as Spark DataFrames.

The package is split by role: ``sources`` read and write, ``functions`` are column
expressions, ``operators`` take and return DataFrames, ``plans`` hold the registered
queries with their SQL twins, ``streaming`` holds Structured Streaming operators.
"""
