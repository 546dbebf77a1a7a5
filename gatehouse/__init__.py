"""Permission-aware retrieval and data processing on Spark DataFrames."""
