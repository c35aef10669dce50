"""Set-based cricket analytics on Spark DataFrames."""
