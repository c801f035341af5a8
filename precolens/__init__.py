"""Price-collection analytics on Spark DataFrames."""
