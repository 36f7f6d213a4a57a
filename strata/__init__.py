"""strata: byte-level storage analytics on Spark DataFrames."""
