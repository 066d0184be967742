"""lattica: graph analytics on Spark DataFrames."""
