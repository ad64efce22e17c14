"""Property valuation and market analytics on Spark DataFrames."""
