"""Property screening and as-of back-testing on Spark DataFrames."""
