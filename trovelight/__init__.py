"""Evidence retrieval and corpus processing over Spark DataFrames."""
