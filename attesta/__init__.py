"""Record-audit analytics on Spark DataFrames."""
