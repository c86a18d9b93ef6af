"""A query engine for program debug-symbol catalogs on Spark DataFrames."""
