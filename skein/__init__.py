"""Event-correlation analytics on Spark DataFrames."""
