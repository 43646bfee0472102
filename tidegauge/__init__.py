"""Data-quality and business analytics on Spark DataFrames."""
