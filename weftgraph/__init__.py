"""Graph-augmented retrieval analytics on Spark DataFrames."""
