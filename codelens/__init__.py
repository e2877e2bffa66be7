"""Source-code and patch-validation analytics on Spark DataFrames."""
