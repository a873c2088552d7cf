"""Vector analytics on Spark DataFrames."""
