"""Trial, event and signal analytics on Spark DataFrames."""
