"""ledgerline: date-anchored banking analytics and column lineage on Spark.

Operators take and return DataFrames.  Nothing here runs a query engine of its
own: every operator is a logical plan built from Spark expressions, joins,
aggregates and windows, so Catalyst and AQE choose the physical strategy.
"""

__version__ = "0.1.0"
