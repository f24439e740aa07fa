"""Privacy analytics, retrieval and governance operators for Spark DataFrames."""
