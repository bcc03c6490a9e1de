"""footfall — behavioural-event and crowd-context analytics on Spark.

Every operator is a DataFrame -> DataFrame function built from Catalyst
expressions, joins, aggregates and windows (see README.md).
"""

__all__ = ["session"]
