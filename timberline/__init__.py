"""A log review engine on Spark DataFrames."""
