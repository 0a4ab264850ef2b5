"""Document-provenance and record analytics on Spark DataFrames."""
