"""Multi-level graph embedding on Spark DataFrames."""
