"""Log-analytics jobs on Spark DataFrames."""
