"""Search and passage-retrieval analytics on Spark DataFrames."""
