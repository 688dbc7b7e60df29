"""Contest analytics as Spark DataFrames."""
